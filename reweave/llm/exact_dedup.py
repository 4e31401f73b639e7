"""Exact duplicates by deterministic block naming, in DataFrame operations only.

Each normalised text is cut into blocks of fixed size. The distinct blocks are sorted and numbered, so that
two blocks share a number exactly if they hold the same bytes. Then adjacent numbers are paired and the distinct
pairs are sorted and numbered in turn, until one number is left for each document: its identity. Texts with the
same number of rounds and the same identity are equal, by construction and not by a hash.

A 64-bit hash of the block finds a block's number again without moving its bytes a second time. Where one hash
stands for two different blocks (checked on every run), blocks are looked up by their bytes instead.

Cost: the text is shuffled once, after equal blocks have been merged on the map side; all later rounds move a
few integers for each block and halve from round to round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reweave.llm.common import ascii_lower, own_columns, unique_ids, written


def _blocks(text: Column, size: int) -> Column:
    data = text.cast("binary")
    count = F.greatest(F.lit(1), F.ceil(F.octet_length(data) / F.lit(size))).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(data, i * size + 1, F.lit(size)))


def _numbered(distinct: DataFrame, *keys: str) -> DataFrame:
    """A number for each row; rows must be distinct. Each partition is sorted, so numbers follow from the content."""
    return distinct.sortWithinPartitions(*keys).withColumn("number", F.monotonically_increasing_id())


def text_identity(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, block_bytes: int = 4096, hash_bits: int = 64
) -> DataFrame:
    """A row for each row of `docs`: row_id, doc_id, text_sha256, rounds and identity.

    Rows have the same (rounds, identity) exactly if their texts are equal after lower-casing A-Z; null counts as
    the empty text. `hash_bits` narrows the look-up hash and only serves to test the path for equal hashes.
    """
    rows = own_columns(docs, doc_id=id_col, text=text_col).select("doc_id", ascii_lower(F.col("text")).alias("text"))

    def key(block: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(block), 64 - hash_bits) if hash_bits < 64 else F.xxhash64(block)

    pieces = rows.select(F.explode(_blocks(F.col("text"), block_bytes)).alias("block"))
    distinct = pieces.select(key(F.col("block")).alias("h"), "block").distinct()
    numbers = written(_numbered(distinct, "block").select("h", "number"), "block-numbers")
    clash = not numbers.groupBy("h").count().filter("count > 1").isEmpty()
    kept = _blocks(F.col("text"), block_bytes) if clash else F.transform(_blocks(F.col("text"), block_bytes), key)
    heads = written(
        rows.select(
            F.monotonically_increasing_id().alias("row_id"),
            "doc_id",
            F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
            kept.alias("blocks"),
        ).withColumn("n_blocks", F.size("blocks")),
        "blocks",
    )
    places = heads.select("row_id", "n_blocks", F.posexplode("blocks").alias("pos", "b"))
    if clash:
        numbers = written(_numbered(pieces.distinct().withColumnRenamed("block", "b"), "b"), "block-numbers")
    else:
        numbers = numbers.withColumnRenamed("h", "b")
    level = written(places.join(numbers, "b").select("row_id", "n_blocks", "pos", "number"), "level")
    longest = heads.agg(F.max("n_blocks")).first()[0] or 1
    found = level.filter("n_blocks = 1").select("row_id", F.lit(0).alias("rounds"), F.col("number").alias("identity"))
    rounds, left = 0, level.filter("n_blocks > 1")
    while longest > 1:
        rounds, longest = rounds + 1, (longest + 1) // 2
        pairs = left.groupBy("row_id", "n_blocks", (F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("number"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("number"))), F.lit(-1)).alias("b"),
        )
        numbers = _numbered(pairs.select("a", "b").distinct(), "a", "b")
        level = written(
            pairs.join(numbers, ["a", "b"]).select(
                "row_id", F.ceil(F.col("n_blocks") / 2).cast("int").alias("n_blocks"), "pos", "number"
            ),
            "level",
        )
        found = found.unionByName(
            level.filter("n_blocks = 1").select("row_id", F.lit(rounds).alias("rounds"), F.col("number").alias("identity"))
        )
        left = level.filter("n_blocks > 1")
    return heads.select("row_id", "doc_id", "text_sha256").join(found, "row_id")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """One row for each row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Of rows with equal texts (A-Z lower-cased, null as empty) the one with the largest id stays; a null id is the
    smallest. Of repeated rows with the same id and text, one has kept = true. Empty tables give no rows.
    """
    named = text_identity(docs, id_col, text_col, **options)
    groups = named.groupBy("rounds", "identity").agg(
        F.max(F.struct("doc_id", "row_id")).alias("best"), F.count(F.lit(1)).alias("group_size")
    )
    groups = written(groups, "groups")  # so that both sides of the join are shuffles, which Spark can split for a hot group
    return named.join(groups, ["rounds", "identity"]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_id") == F.col("best.row_id")).alias("kept"),
        "text_sha256",
    )


def keep_unique(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows whose text another keeps; columns unchanged, whatever their names. Where ids repeat, rows are
    told apart by id and text; of rows repeated in both any one stays."""
    kept = written(exact_dedup(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias("kept_id"), "text_sha256"), "kept-ids")
    key = F.col(f"`{id_col}`")
    if unique_ids(docs, id_col):
        return docs.join(kept.select("kept_id"), key.eqNullSafe(kept["kept_id"]), "left_semi")
    name = "sha"
    while name in docs.columns:
        name = "_" + name
    both = docs.withColumn(name, F.sha2(ascii_lower(F.col(f"`{text_col}`")).cast("binary"), 256))
    both = both.join(kept, both[id_col].eqNullSafe(kept["kept_id"]) & (both[name] == kept["text_sha256"]), "left_semi")
    return both.dropDuplicates([id_col, name]).drop(name)
