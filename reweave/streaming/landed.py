"""Landed pages as a stream: each (seed, id) counts once, and seeds already exported are left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pending(seeds: DataFrame, exported: DataFrame) -> DataFrame:
    """Seeds without an export."""
    return seeds.join(exported.select("seed").distinct(), "seed", "left_anti")


def new_citations(spark: SparkSession, folder: str, schema: str, delay: str | None = None) -> DataFrame:
    """A stream of the landed pages' rows without repeated (seed, id). With `delay` (and a column landed_at) the state is
    bounded: a repeat later than that counts anew."""
    rows = spark.readStream.schema(schema).json(folder)
    if delay:
        return rows.withWatermark("landed_at", delay).dropDuplicatesWithinWatermark(["seed", "id"])
    return rows.dropDuplicates(["seed", "id"])


def export(stream: DataFrame, out: str, checkpoint: str):
    """Append what is new to `out`, for all pages that have landed; a rerun goes on where the last one ended."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def export_batches(pages: DataFrame, out: str, checkpoint: str):
    """Merge the stream's new (seed, id) into the table at `out`, a folder for each batch; rows without either are left out.

    What is known is told from the table itself, so no state grows in the stream. A batch that is run again, after a
    failure, replaces its own folder only and compares with the batches before it: its rows are the same."""
    spark = pages.sparkSession
    spark.createDataFrame([], pages.schema).write.mode("overwrite").parquet(f"{out}/batch=-1")  # the table exists before the first batch

    def merge(rows: DataFrame, batch: int) -> None:
        own = rows.sparkSession
        before = own.read.schema(f"seed {dict(rows.dtypes)['seed']}, id {dict(rows.dtypes)['id']}, batch long").parquet(out).filter(F.col("batch") < batch)
        new = rows.filter("seed IS NOT NULL AND id IS NOT NULL").dropDuplicates(["seed", "id"])
        new.join(before.select("seed", "id"), ["seed", "id"], "left_anti").write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return pages.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def carried_counts(seeds: DataFrame, out: str) -> DataFrame:
    """Each seed (columns unchanged) with citation_count, from all batches exported so far; 0 without any."""
    counts = seeds.sparkSession.read.parquet(out).groupBy(F.col("seed").alias("of")).agg(F.count(F.lit(1)).alias("citation_count"))
    rows = seeds.join(counts, F.col("seed") == F.col("of"), "left")
    return rows.select(*seeds.columns, F.coalesce("citation_count", F.lit(0)).alias("citation_count"))
