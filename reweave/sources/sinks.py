"""Where results go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reweave.operators.reports import threshold_token


def write_table(df: DataFrame, path: str, columns: list[str], csv: bool = False) -> None:
    """Parquet, or CSV with a header, with the columns in this order."""
    out = df.select(*columns).write.mode("overwrite")
    out.option("header", True).csv(path) if csv else out.parquet(path)


def write_runs(df: DataFrame, path: str) -> None:
    """Results of several runs below backend=/thr=/edits=; the runs written replace only themselves."""
    keyed = df.withColumn("thr", threshold_token(F.col("threshold")))
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("backend", "thr", "edits").parquet(path)


def write_datasets(members: DataFrame, path: str) -> None:
    """Members of threshold datasets below dataset=; datasets written replace only themselves."""
    members.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset").parquet(path)


def write_works(works: DataFrame, path: str) -> None:
    """Works as CSV (authors joined) and as JSON lines."""
    joined = works.withColumn("authors", F.array_join("authors", "; "))
    joined.select([c for c, t in joined.dtypes if t in ("string", "int", "bigint", "boolean", "double")]).write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    works.write.mode("overwrite").json(f"{path}/json")


def union_all(frames: list[DataFrame], first: list[str]) -> DataFrame:
    """All rows with the columns of any frame; `first` come first."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.select(*[c for c in first if c in out.columns], *[c for c in out.columns if c not in first])


def write_statistics(statistics: DataFrame, path: str) -> None:
    """A table of metric, key and value as JSON lines and as one CSV folder for each metric."""
    statistics.write.mode("overwrite").json(f"{path}/json")
    statistics.write.mode("overwrite").partitionBy("metric").option("header", True).csv(f"{path}/csv")


def write_citing(rows: DataFrame, path: str) -> None:
    """Citing works as CSV below seed_year=."""
    rows.write.mode("overwrite").partitionBy("seed_year").option("header", True).csv(path)


def write_classified(rows: DataFrame, path: str) -> None:
    """Classified rows as CSV, a folder NAME-classified for each file (column `file`) that they come from: `read_papers` with
    the pattern of the CSV files below such folders reads them again. Other folders stay as they are."""
    name = F.concat(F.regexp_replace(F.substring_index("file", "/", -1), r"(?<=.)\.[^.]*$", ""), F.lit("-classified"))
    out = rows.withColumn("classified", name).drop("file")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("classified").option("header", True).csv(path)
