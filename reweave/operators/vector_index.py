"""A partition index of vectors: cells around centres, searched near the query and checked exactly.

Centres are fitted on a bounded sample; every vector is then dealt to its nearest one. A query looks into the cells whose
centres are nearest to it, and all vectors there are compared with it. Pairs that lie in other cells are missed: `probes`
weighs work against recall, and as many probes as cells compare everything.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reweave.operators.simjoin import meeting, unit
from reweave.storage import written


def fit_centres(vectors: DataFrame, cells: int | None = None, *, key: str = "vec_id", sample: int = 20_000, rounds: int = 10) -> np.ndarray:
    """Centres of unit length from the `sample` vectors with the smallest hashes of their key, by k-means on angles.

    Without `cells` there is a centre for the root of the number of vectors, and no more than one for 40 sampled ones."""
    rows = vectors.filter("embedding IS NOT NULL").select("embedding", F.xxhash64(key).alias("order"))
    known = rows.orderBy("order").limit(sample).collect()
    if not known:
        return np.zeros((0, 0))
    points = unit(np.array([r["embedding"] for r in known], float))
    cells = min(len(points), cells or max(1, min(int(rows.count() ** 0.5), len(points) // 40)))
    rng = np.random.RandomState(0)
    centres = points[rng.choice(len(points), cells, replace=False)]
    for _ in range(rounds):
        nearest = np.argmax(points @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        centres = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, unit(sums), centres)
    return centres


def nearest_cells(embedding: Column, centres: np.ndarray, probes: int) -> Column:
    """The `probes` cells nearest to a vector, the nearest first."""

    @F.pandas_udf("array<int>")
    def near(column: pd.Series) -> pd.Series:
        if not len(column):
            return pd.Series([], dtype=object)
        sims = unit(np.stack(column.to_numpy()).astype(float)) @ centres.T
        return pd.Series(list(np.argsort(-sims, axis=1, kind="stable")[:, :probes].astype(np.int32)))

    return near(embedding)


def indexed(vectors: DataFrame, centres: np.ndarray, *, key: str = "vec_id") -> DataFrame:
    """`key`, embedding and cell of every vector that is not null: the index, to be written and searched many times."""
    rows = vectors.filter("embedding IS NOT NULL").select(key, "embedding")
    return rows.withColumn("cell", nearest_cells(F.col("embedding"), centres, 1)[0])


def search(queries: DataFrame, index: DataFrame, centres: np.ndarray, threshold: float, *, key: str = "vec_id", probes: int = 8, block: int = 2048, chunk: int = 32_768) -> DataFrame:
    """query_id, `key`, similarity of queries (`key`, embedding) and indexed vectors in their `probes` nearest cells with a
    cosine of `threshold` or more; similarities are exact.

    A cell of more than about `chunk` vectors is split by hash, and so are its queries above `block`; each pair of parts meets
    in a task of its own."""
    sizes = {r["cell"]: r["count"] for r in index.groupBy("cell").count().collect()}  # a row for each cell
    if not sizes:
        return queries.limit(0).select(F.col(key).alias("query_id"), F.col(key), F.lit(0.0).alias("similarity"))
    blocks = max(1, -(-queries.count() // block))
    parts = F.element_at(F.array(*[F.lit(max(1, -(-sizes.get(c, 0) // chunk))) for c in range(len(centres))]), F.col("cell") + 1)
    asked = queries.filter("embedding IS NOT NULL").select(F.col(key).alias("query_id"), F.col("embedding").alias("query"))
    q = asked.withColumn("cell", F.explode(nearest_cells(F.col("query"), centres, probes))).withColumns(
        {"i": F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"), "j": F.explode(F.sequence(F.lit(0), parts - 1))}
    )
    v = index.select(F.col(key), F.col("embedding").alias("vector"), "cell", F.pmod(F.xxhash64(key), parts).cast("int").alias("j"))
    v = v.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    kind = dict(index.dtypes)[key]
    meet = meeting(key, threshold)
    return q.groupBy("cell", "i", "j").cogroup(v.groupBy("cell", "i", "j")).applyInPandas(meet, f"query_id {kind}, {key} {kind}, similarity double")


def indexed_join(queries: DataFrame, vectors: DataFrame, threshold: float, *, key: str = "vec_id", cells: int | None = None, probes: int = 8) -> DataFrame:
    """`search` of `queries` in an index of `vectors` made for it."""
    centres = fit_centres(vectors, cells, key=key)
    return search(queries, written(indexed(vectors, centres, key=key), "index"), centres, threshold, key=key, probes=probes)


def work(queries: DataFrame, index: DataFrame, centres: np.ndarray, probes: int) -> int:
    """How many pairs a search compares."""
    sizes = index.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    cells = queries.filter("embedding IS NOT NULL").select(F.explode(nearest_cells(F.col("embedding"), centres, probes)).alias("cell"))
    return cells.join(sizes, "cell").agg(F.sum("n")).first()[0] or 0
