"""Reuse percentages for each pattern file, collapsed by pattern name, and for the union of files with one name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reweave.functions.labels import local_name, normalize_label, percent
from reweave.operators.triples import graph_reuse, normalised, of_patterns
from reweave.storage import written

PAIR = ["ontology_id", "pattern_id"]
KINDS = {"class": "classes", "object": "object_properties", "datatype": "datatype_properties"}


def reuse_rows(pairs: DataFrame, by_graph: DataFrame, by_label: DataFrame) -> DataFrame:
    """reused_* and label_reused_* for each pair and kind, and their totals."""
    out = pairs
    for rows, prefix in ((by_graph, "reused"), (by_label, "label_reused")):
        counts = rows.groupBy(*PAIR).agg(
            *[F.count_if(F.col("kind") == k).alias(f"{prefix}_{n}") for k, n in KINDS.items()], F.count(F.lit(1)).alias(f"{prefix}_total")
        )
        out = out.join(counts, PAIR, "left")
    return out.na.fill(0)


def enriched(reuse: DataFrame, counts: DataFrame) -> DataFrame:
    """Reuse rows with the pattern's and the ontology's counts, joined by graph, and percentages; null without a whole."""
    for side, prefix in (("ontology", "ontology_"), ("pattern", "pattern_")):
        own = counts.select(F.col("graph_id").alias(f"{side}_id"), *[F.col(c).alias(f"{prefix}{c}") for c in counts.columns if c != "graph_id"])
        reuse = reuse.join(own, f"{side}_id", "left")
    parts = [*KINDS.values(), "total"]
    return reuse.withColumns({f"pct_{p}_{n}": percent(F.col(f"{p}_{n}"), F.col(f"pattern_n_{n}")) for p in ("reused", "label_reused") for n in parts})


def collapsed(rows: DataFrame) -> DataFrame:
    """Enriched rows (with pattern_name) summed by ontology and pattern name, with percentages of the sums."""
    sums = ["reused_total", "label_reused_total", "pattern_n_total"]
    out = rows.groupBy("ontology_id", "pattern_name").agg(*[F.sum(c).alias(c) for c in sums])
    return out.withColumns({f"pct_{c}": percent(F.col(c), F.col("pattern_n_total")) for c in sums[:2]})


def union_by_name(pairs: DataFrame, found: DataFrame, used: DataFrame) -> DataFrame:
    """Reuse of the union of the entities of all pattern files with one name. pairs has pattern_name too.

    Labels are those of local names only, of the same kind, and counted once each: names that two IRIs share collapse. Ontologies
    that have the same patterns under a name have the same union, which is counted once. Rows of `used` may repeat.
    """
    key = ["ontology_id", "pattern_name"]
    names = pairs.select(*PAIR, "pattern_name").distinct()
    declared = of_patterns(pairs, found)

    unions = names.groupBy(*key).agg(F.sort_array(F.collect_set("pattern_id")).alias("patterns"))
    members = unions.select("patterns").distinct().select("patterns", F.explode("patterns").alias("graph_id"))
    sizes = members.join(declared, "graph_id").groupBy("patterns").agg(F.count_distinct("kind", "iri").alias("union_n_total"))
    totals = unions.join(written(sizes, "unions"), "patterns").select(*key, "union_n_total")

    reused = graph_reuse(pairs, declared, used).join(names, PAIR).select(*key, "kind", "iri").distinct()
    reused = reused.groupBy(*key).agg(F.count(F.lit(1)).alias("union_reused_total"))

    named = lambda rows: normalised(rows.withColumn("name", local_name(F.col("iri"))), normalize_label)
    mine = written(named(declared).select(F.col("graph_id").alias("pattern_id"), "kind", "label").distinct(), "mine")
    theirs = named(found).join(mine.select("kind", "label").distinct(), ["kind", "label"], "left_semi")
    theirs = theirs.select(F.col("graph_id").alias("ontology_id"), "kind", "label").distinct()
    labels = theirs.join(mine, ["kind", "label"]).join(names, PAIR).select(*key, "kind", "label").distinct()
    labels = labels.groupBy(*key).agg(F.count(F.lit(1)).alias("union_label_reused_total"))

    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [totals, reused, labels]).groupBy(*key)
    out = out.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("union_n_total", "union_reused_total", "union_label_reused_total")])
    return out.withColumns({f"pct_{c}": percent(F.col(c), F.col("union_n_total")) for c in ("union_reused_total", "union_label_reused_total")})


def unique_patterns(union: DataFrame) -> DataFrame:
    """The largest of every number for each pattern name, over all ontologies."""
    numbers = [c for c in union.columns if c not in ("ontology_id", "pattern_name")]
    return union.groupBy("pattern_name").agg(*[F.max(c).alias(c) for c in numbers])


def average_by_ontology(rows: DataFrame) -> DataFrame:
    """Average percentages for each ontology; nulls don't count."""
    return rows.groupBy("ontology_id").agg(
        F.avg("pct_reused_total").alias("avg_pct_reused_graph"), F.avg("pct_label_reused_total").alias("avg_pct_reused_labels"), F.count(F.lit(1)).alias("n_patterns")
    )
