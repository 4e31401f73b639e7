"""Exact order statistics by ranges and prefix sums: no task holds all values, of all rows or of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reweave.storage import written


def ranked(df: DataFrame, column: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """`df` (`keys`, `column`, n) with `before`, the sum of `n` of the key's rows in partitions before, `own`, that up to the
    row in its own partition, and `all`, that of the whole key.

    Rows are dealt by ranges of (`keys`, `column`); only one number for each partition and key in it meets in one place, so
    a key with many values spreads over many tasks."""
    order = [*keys, column]
    df = written(df, "counted")  # dealing by ranges reads it twice
    dealt = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "ranges")
    own = Window.partitionBy(*keys)
    sums = dealt.groupBy("part", *keys).agg(F.sum("n").alias("of_part"))
    before = F.coalesce(F.sum("of_part").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("part").alias("of"), *[F.col(k).alias(f"of_{k}") for k in keys], before.alias("before"), F.sum("of_part").over(own).alias("all"))
    same = F.col("part") == F.col("of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    rows = dealt.join(sums if keys else F.broadcast(sums), same).drop("of", *[f"of_{k}" for k in keys])  # without keys, a row for each partition
    return rows.withColumn("own", F.sum("n").over(Window.partitionBy("part", *keys).orderBy(column)))


def quantiles(df: DataFrame, column: str, fractions: dict[str, float], keys: tuple[str, ...] = ()) -> DataFrame:
    """`keys`, low, a column for each of `fractions`, high and n over the values of each key that are not null.

    A quantile lies between the two values next to its place, in proportion; keys without values are left out, but without
    keys there is always one row."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))
    rows = ranked(counts, column, keys)
    end = F.col("before") + F.col("own")
    value = F.col(column).cast("double")

    def at(fraction: float):
        place = (F.col("all") - 1) * fraction
        under = lambda p: F.max(F.when((end - F.col("n") <= p) & (p < end), value))
        low, high = under(F.floor(place)), under(F.ceil(place))
        return low + (high - low) * F.max(place - F.floor(place))

    return rows.groupBy(*keys).agg(
        F.min(column).alias("low"), *[at(f).alias(name) for name, f in fractions.items()], F.max(column).alias("high"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
    )
