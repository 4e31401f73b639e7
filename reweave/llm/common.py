"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reweave.storage import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """`text` with A-Z lower-cased and every other character unchanged; null becomes the empty string."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def own_columns(df: DataFrame, **columns: str) -> DataFrame:
    """`df` with only the named columns, renamed to our own names: extra columns with clashing names drop out."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def unique_ids(df: DataFrame, id_col: str) -> bool:
    """Whether no two rows have the same id (nulls count as the same). Reads the id column only."""
    return df.groupBy(id_col).count().filter("count > 1").isEmpty()


def row_ids(df: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """`df` and a column of it that tells its rows apart: the id, or where ids repeat, a row number in a written copy."""
    if unique_ids(df, id_col):
        return df, id_col
    name = "row_number"
    while name in df.columns:
        name = "_" + name
    return written(df.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def maybe_among(rows: DataFrame, column: str, ids: DataFrame, bits: int = 1 << 25) -> DataFrame:
    """The rows whose `column` is among `ids` (one column; null is an id too), and some others, without a shuffle of `rows`.

    The ids are marked in a bitmap of `bits` bits in pieces of 4 KB, so what is broadcast has at most 4 MB at any size. The
    fuller the map, the more other rows stay: the caller's own join must drop them.
    """
    place = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(bits)) + 1
    name = ids.columns[0]
    maps = ids.select(place(name).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("piece")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bitmap")
    )
    at = F.bitmap_bit_position(place(column))
    byte = F.conv(F.hex(F.substring("bitmap", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    joined = rows.join(F.broadcast(maps), F.bitmap_bucket_number(place(column)) == F.col("piece"))
    return joined.filter(F.bit_get(byte, (at % 8).cast("int")) == 1).select(*[F.col(c) for c in rows.columns])
