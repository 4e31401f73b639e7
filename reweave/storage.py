"""Tables written between the steps of a job."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`; a local run without it gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str, most_rows: int | None = None, rows_a_task: int = 250_000) -> DataFrame:
    """`df` as a table written to the shared folder and read again, which cuts its lineage.

    Tables lie under `<shared folder>/tables/<application>/`, to be removed with the application. A caller that knows a
    bound of the rows gives `most_rows`: a small table then is written by few tasks, in few files, and Spark sees from its
    size when it can broadcast it. Larger tables keep their partitions.
    """
    spark = df.sparkSession
    if most_rows is not None:
        df = df.coalesce(most_rows // rows_a_task + 1)
    path = f"{shared_folder(spark)}/tables/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
