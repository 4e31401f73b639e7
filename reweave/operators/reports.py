"""Summary tables over pair metrics, constructs and usage forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reweave.functions.labels import percent
from reweave.operators.constructs import CONSTRUCTS
from reweave.operators.order import quantiles, ranked
from reweave.storage import written

THRESHOLDS = [100, 90, 80, 70, 60, 50, 25, 10]
BANDS = [("eq_100", 100, None), ("ge95_lt100", 95, 100), ("ge90_lt95", 90, 95), ("ge85_lt90", 85, 90), ("ge80_lt85", 80, 85)]


def unpivot(df: DataFrame, keys: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    """One row for each of `columns`, as long or double as the columns are."""
    return df.unpivot(keys, columns, name, value)


def threshold_counts(df: DataFrame, column: str, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """How many values reach each threshold; a threshold that none reaches stays with 0. One pass over the rows."""
    counts = df.agg(*[F.count_if(F.col(column) >= t).alias(str(t)) for t in thresholds])
    return unpivot(counts, [], [str(t) for t in thresholds], "threshold", "count_ge").withColumn("threshold", F.col("threshold").cast("int"))


def band_counts(df: DataFrame, column: str) -> DataFrame:
    """How many values lie in each band of BANDS."""
    c = F.col(column)
    of = lambda lo, hi: (c == lo) if hi is None else (c >= lo) & (c < hi)
    counts = df.agg(*[F.count_if(of(lo, hi)).alias(n) for n, lo, hi in BANDS])
    return unpivot(counts, [], [n for n, _, _ in BANDS], "bin", "count")


def threshold_datasets(df: DataFrame, column: str, thresholds: list[float]) -> DataFrame:
    """Each row once for every threshold it reaches, in the column `dataset`; write it partitioned by that."""
    reached = F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: F.col(column) >= t)
    return df.withColumn("dataset", F.explode(reached))


def dataset_members(datasets: DataFrame, triples: DataFrame) -> DataFrame:
    """The triples of both graphs of each dataset's pairs, once for each dataset."""
    ids = datasets.select("dataset", F.explode(F.array("ontology_id", "pattern_id")).alias("graph_id")).distinct()
    return triples.join(ids, "graph_id")


def threshold_token(value: Column) -> Column:
    """Two digits of ten times the value, from 00 to 10."""
    return F.lpad(F.greatest(F.lit(0), F.least(F.lit(10), F.bround(value * 10).cast("int"))).cast("string"), 2, "0")


def histogram(df: DataFrame, column: str, edges: list[int]) -> DataFrame:
    """bin, count over [edge, next edge); values outside all bins, also below the first, go to `last+`."""
    c = F.col(column)
    label = reduce(lambda w, ab: w.when((c >= ab[0]) & (c < ab[1]), f"{ab[0]}-{ab[1] - 1}"), zip(edges, edges[1:]), F)
    return df.groupBy(label.otherwise(f"{edges[-1]}+").alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def equal_width(df: DataFrame, column: str, bins: int) -> DataFrame:
    """bucket (from 1), count over equal parts of the range of values; the largest value is in the last part."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts, "counts")  # read twice, for the ends and for the parts; `df` is worked out once
    ends = counts.agg(F.struct(F.min(column).alias("low"), F.max(column).alias("high"))).scalar()
    low, high = ends["low"], ends["high"]
    at = F.when(low < high, F.least(F.floor((F.col(column) - low) / (high - low) * bins) + 1, F.lit(bins))).otherwise(1)
    return counts.withColumn("bucket", at.cast("int")).groupBy("bucket").agg(F.sum("n").alias("count"))


def pair_complexity(pairs: DataFrame, constructs: DataFrame) -> DataFrame:
    """metric, value: pairs, and mean complexity and axioms of either side over all pairs."""
    c = constructs.select("graph_id", "dl_complexity_score", "n_axioms")
    for side in ("ontology", "pattern"):
        pairs = pairs.join(c.toDF(f"{side}_id", f"{side}_constructs", f"{side}_axioms"), f"{side}_id", "left")
    names = [f"{side}_{m}" for side in ("ontology", "pattern") for m in ("constructs", "axioms")]
    out = pairs.agg(F.count(F.lit(1)).cast("double").alias("pairs"), *[F.avg(F.coalesce(n, F.lit(0))).alias(f"mean_{n}") for n in names])
    return unpivot(out, [], out.columns, "metric", "value")


def cumulative_share(df: DataFrame, column: str) -> DataFrame:
    """Each distinct value with its count and the share of values up to it."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return ranked(counts, column).select(column, "n", ((F.col("before") + F.col("own")) / F.col("all")).alias("share"))


def empirical_cdf(df: DataFrame, column: str) -> DataFrame:
    """A row for each value, ties too, with its rank / n."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    rows = ranked(counts, column).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return rows.select(column, ((F.col("before") + F.col("own") - F.col("n") + F.col("k")) / F.col("all")).alias("share"))


def figure_bins(n: Column) -> Column:
    """How many bins a figure of n values has: the root of n, at least 5 and at most 20."""
    return F.greatest(F.lit(5), F.least(F.lit(20), F.floor(F.sqrt(n)))).cast("int")


def usage_averages(df: DataFrame, forms: list[str]) -> DataFrame:
    """metric, value: the mean of every numeric column but keys, and each form's percentage of all uses."""
    numbers = [c for c, t in df.dtypes if t in ("int", "bigint", "double")]
    total = reduce(lambda a, b: a + b, (F.coalesce(F.sum(f), F.lit(0)) for f in forms))
    of_all = F.when(total == 0, 1).otherwise(total)
    out = df.agg(
        *[F.avg(c).alias(f"avg_{c}") for c in numbers],
        *[(F.coalesce(F.sum(f), F.lit(0)) / of_all * 100).cast("double").alias(f"{f}_pct") for f in forms],
    )
    return unpivot(out, [], out.columns, "metric", "value")


def reuse_summary(extent: DataFrame) -> DataFrame:
    """One row over the ontologies of `reuse_extent`: how many, how many with reuse and in percent, and mean patterns."""
    n, hit = F.count(F.lit(1)), F.count_if(F.col("any_reuse_label"))
    return extent.agg(
        n.alias("ontologies"), hit.alias("ontologies_with_reuse"), F.coalesce(hit / F.nullif(n, F.lit(0)) * 100, F.lit(0.0)).alias("pct_with_reuse"),
        F.coalesce(F.avg("n_patterns"), F.lit(0.0)).alias("avg_patterns"), F.coalesce(F.avg("n_label"), F.lit(0.0)).alias("avg_patterns_with_reuse"),
    )


def pair_summary(pairs: DataFrame, constructs: DataFrame) -> DataFrame:
    """metric, value over all pairs: mean complexity of both sides, mean axioms of the ontology, and for each construct the
    percentage of pairs whose ontology or pattern uses it (null as false)."""
    for side in ("ontology", "pattern"):
        mine = constructs.select(F.col("graph_id").alias(f"{side}_id"), F.struct("dl_complexity_score", "n_axioms", *CONSTRUCTS).alias(side))
        pairs = pairs.join(mine, f"{side}_id", "left")
    share = lambda side, c: (F.avg(F.coalesce(f"{side}.{c}", F.lit(False)).cast("int")) * 100).alias(f"{c}_{side}_pct")
    out = pairs.agg(
        F.avg("ontology.dl_complexity_score").alias("mean_ontology_constructs"), F.avg("pattern.dl_complexity_score").alias("mean_pattern_constructs"),
        F.avg("ontology.n_axioms").alias("mean_ontology_axioms"), *[share(side, c) for c in CONSTRUCTS for side in ("ontology", "pattern")],
    )
    return unpivot(out, [], out.columns, "metric", "value")


def five_numbers(df: DataFrame, column: str) -> DataFrame:
    """low, q1, median, q3, high and n of the values, exactly."""
    return quantiles(df, column, {"q1": 0.25, "median": 0.5, "q3": 0.75})


def construct_summary(df: DataFrame) -> DataFrame:
    """construct, count and percent of graphs that use it."""
    sums = df.select(*[F.col(c).cast("long").alias(c) for c in CONSTRUCTS])
    rows = unpivot(sums, [], CONSTRUCTS, "construct", "used")
    return rows.groupBy("construct").agg(F.sum("used").alias("count"), (F.avg("used") * 100).alias("percent"))


def by_name(df: DataFrame, name: str) -> DataFrame:
    """For each pattern name the constructs that any of its files uses."""
    return df.groupBy(name).agg(*[F.bool_or(c).alias(c) for c in CONSTRUCTS])


def expressivity_distribution(df: DataFrame) -> DataFrame:
    counts = df.groupBy(F.coalesce("expressivity", F.lit("UNKNOWN")).alias("expressivity")).agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("percent", percent(F.col("count"), F.sum("count").over(Window.partitionBy())))


def richest(df: DataFrame, name: str, tie: str) -> DataFrame:
    """For each pattern name the expressivity of its file with the highest score; ties go to the larger `tie`."""
    return df.groupBy(name).agg(F.max_by("expressivity", F.struct("dl_complexity_score", tie)).alias("expressivity"))


def form_distribution(df: DataFrame, forms: list[str]) -> DataFrame:
    """form, count and percent of all usage counts."""
    rows = unpivot(df.select(*[F.col(f).cast("long").alias(f) for f in forms]), [], forms, "form", "n")
    sums = rows.groupBy("form").agg(F.sum("n").alias("count"))
    return sums.withColumn("percent", F.col("count") / F.greatest(F.sum("count").over(Window.partitionBy()), F.lit(1)) * 100)


def form_presence(df: DataFrame, pattern: str, forms: list[str]) -> DataFrame:
    """form and the number of patterns with any use of that form."""
    of_pattern = df.groupBy(pattern).agg(*[F.sum(F.col(f).cast("long")).alias(f) for f in forms])
    rows = unpivot(of_pattern, [pattern], forms, "form", "n")
    return rows.groupBy("form").agg(F.count_if(F.col("n") > 0).alias("patterns"), F.count(F.lit(1)).alias("of"))


def reuse_extent(df: DataFrame) -> DataFrame:
    """For each ontology: patterns, those reused by graph and by label, and the largest and average label percentage.

    any_reuse follows graph reuse; any_reuse_label is its alias and has the same value.
    """
    hit = lambda c: F.count_distinct(F.when(F.col(c) > 0, F.col("pattern_id")))
    out = df.groupBy("ontology_id").agg(
        F.count_distinct("pattern_id").alias("n_patterns"), hit("reused_total_label").alias("n_label"), hit("reused_total_graph").alias("n_graph"),
        F.max("label_reuse_pct").alias("max_pct"), F.avg("label_reuse_pct").alias("avg_pct"),
    )
    return out.withColumn("any_reuse", F.col("n_graph") > 0).withColumn("any_reuse_label", F.col("n_graph") > 0)


def pattern_profile(df: DataFrame, forms: list[str]) -> DataFrame:
    """For each pattern: pairs, ontologies that use it, average and largest percentage, form counts and shares."""
    total = reduce(lambda a, b: a + b, (F.col(f) for f in forms))
    out = df.groupBy("pattern_id").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_distinct(F.when(F.col("reused_total_graph") > 0, F.col("ontology_id"))).alias("used_by"),
        F.avg("label_reuse_pct").alias("avg_pct"), F.max("label_reuse_pct").alias("max_pct"), *[F.sum(f).alias(f) for f in forms],
    )
    return out.withColumns({f"{f}_share": F.col(f) / F.greatest(total, F.lit(1)) for f in forms})


def with_and_without(df: DataFrame) -> DataFrame:
    """Graphs with and without reuse (0/1 in `reuse`): number, mean constructs and axioms, modal expressivity (the
    smallest of several), and how much the means differ in percent of those without."""
    mean = lambda c, k: F.avg(F.when(F.col("reuse") == k, F.col(c)))
    out = df.agg(
        *[F.count_if(F.col("reuse") == k).alias(f"n_{n}") for k, n in ((1, "with"), (0, "without"))],
        *[mean(c, k).alias(f"{a}_{n}") for c, a in (("dl_complexity_score", "constructs"), ("n_axioms", "axioms")) for k, n in ((1, "with"), (0, "without"))],
        *[F.mode(F.when(F.col("reuse") == k, F.col("expressivity")), True).alias(f"expressivity_{n}") for k, n in ((1, "with"), (0, "without"))],
    )
    return out.withColumns({f"{a}_delta_pct": percent(F.col(f"{a}_with") - F.col(f"{a}_without"), F.col(f"{a}_without")) for a in ("constructs", "axioms")})


def expressivity_by_reuse(df: DataFrame) -> DataFrame:
    return df.groupBy("expressivity").agg(F.count_if(F.col("reuse") == 1).alias("with_reuse"), F.count_if(F.col("reuse") == 0).alias("without_reuse"))


def construct_differences(df: DataFrame) -> DataFrame:
    """construct, its percentage with and without reuse, and the difference in percentage points."""
    rows = unpivot(df.select("reuse", *[F.col(c).cast("long").alias(c) for c in CONSTRUCTS]), ["reuse"], CONSTRUCTS, "construct", "used")
    mean = lambda k: F.avg(F.when(F.col("reuse") == k, F.col("used"))) * 100
    out = rows.groupBy("construct").agg(mean(1).alias("pct_with"), mean(0).alias("pct_without"))
    return out.withColumn("diff_pp", F.col("pct_with") - F.col("pct_without"))


def pair_constructs(pairs: DataFrame, constructs: DataFrame) -> DataFrame:
    """construct with the numbers of pairs where the ontology, the pattern, both, or only one of them uses it."""
    for side in ("ontology", "pattern"):
        mine = constructs.select(F.col("graph_id").alias(f"{side}_id"), F.struct(*[F.coalesce(c, F.lit(False)).alias(c) for c in CONSTRUCTS]).alias(side))
        pairs = pairs.join(mine, f"{side}_id", "left")
    rows = pairs.select(F.explode(F.array(*[F.struct(F.lit(c).alias("construct"), F.coalesce(f"ontology.{c}", F.lit(False)).alias("o"), F.coalesce(f"pattern.{c}", F.lit(False)).alias("p")) for c in CONSTRUCTS])).alias("x")).select("x.*")
    o, p = F.col("o"), F.col("p")
    out = rows.groupBy("construct").agg(
        F.count_if(o).alias("ontology"), F.count_if(p).alias("pattern"), F.count_if(o & p).alias("both"),
        F.count_if(o & ~p).alias("only_ontology"), F.count_if(p & ~o).alias("only_pattern"), F.count(F.lit(1)).alias("pairs"),
    )
    return out.withColumn("both_pct", percent(F.col("both"), F.col("pairs")))


def wide(df: DataFrame, name: str, metrics: list[str]) -> DataFrame:
    """One row with a column `<name>_<metric>` for each row and metric."""
    return df.groupBy().pivot(name, CONSTRUCTS).agg(*[F.first(m).alias(m) for m in metrics])
