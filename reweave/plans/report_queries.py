"""Queries for the summary tables over pairs, constructs and usage forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reweave.operators import constructs as co
from reweave.operators import reports as rp
from reweave.operators import triples as tr
from reweave.operators import usage as us
from reweave.operators.constructs import CONSTRUCTS
from reweave.plans import graph_queries as gq
from reweave.plans.bindings import CTE, Triples
from reweave.storage import written
from reweave.vocab import SHORT


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c, t in df.dtypes if t == "double"})


def pair_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = gq.Graphs(spark, sf_dir).coverage()
    return out.withColumn("label_reuse_pct", F.col("coverage_label") * 100)


def with_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gq.Graphs(spark, sf_dir)
    found, used = g.found, g.terms
    reused = written(tr.graph_reuse(g.pairs, found, used), "reused")
    metrics = tr.coverage(g.pairs, found, reused, g.label_reuse()).withColumn("label_reuse_pct", F.col("coverage_label") * 100)
    forms = us.usage(g.pairs, g.triples, SHORT, found=found, used=used, reused=reused)
    return metrics.join(forms.select(*us.PAIR, *us.FORMS), us.PAIR)


def role_constructs(spark: SparkSession, sf_dir: str, role: str) -> DataFrame:
    return gq.graph_constructs(spark, sf_dir).filter(F.col("graph_id").startswith(role))


def named_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constructs of pattern graphs under names that several of them share."""
    return role_constructs(spark, sf_dir, "pat").withColumn("name", F.char_length("graph_id") % 3)


def with_reuse(view: Triples) -> DataFrame:
    """Constructs of ontologies with a 0/1 flag for graph reuse of any pattern; without pairs it is 0. Without n_axioms, for
    which all triples have to be made distinct."""
    hit = view.reusing.withColumn("reuse", F.lit(1))
    return co.constructs(view.forms, SHORT).drop("n_axioms").join(hit, "graph_id", "left").na.fill(0, ["reuse"])


def with_and_without(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = Triples(spark, sf_dir)
    return rounded(rp.with_and_without(with_reuse(view).join(view.sizes, "graph_id")))


def pair_construct_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gq.Graphs(spark, sf_dir)
    return rounded(rp.pair_constructs(g.pairs, written(co.constructs(g.triples, SHORT), "constructs")))


def pair_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gq.Graphs(spark, sf_dir)
    return rounded(rp.pair_complexity(g.pairs, co.constructs(g.triples, SHORT)))


def job_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = pair_metrics(spark, sf_dir)
    return m.agg(
        F.count(F.lit(1)).alias("pairs"), F.count_distinct("ontology_id").alias("ontologies"), F.count_distinct("pattern_id").alias("patterns"),
        F.sum("reused_total_graph").alias("reused_graph"), F.sum("reused_total_label").alias("reused_label"),
        F.count_if(F.col("reused_total_graph") > 0).alias("pairs_with_reuse"),
    )


def pair_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gq.Graphs(spark, sf_dir)
    return rounded(rp.pair_summary(g.pairs, written(co.constructs(g.triples, SHORT), "constructs")))


def dataset_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of the members of each threshold dataset, counted by graph."""
    g = gq.Graphs(spark, sf_dir)
    metrics = g.coverage().withColumn("pct", F.col("coverage_label") * 100)
    members = rp.dataset_members(rp.threshold_datasets(metrics, "pct", [50, 100]), g.triples)
    return members.groupBy("dataset", "graph_id").agg(F.count(F.lit(1)).alias("triples"))


QUERIES = {
    "report_threshold_counts": lambda s, d: rp.threshold_counts(pair_metrics(s, d), "label_reuse_pct"),
    "report_band_counts": lambda s, d: rp.band_counts(pair_metrics(s, d), "label_reuse_pct"),
    "report_threshold_datasets": lambda s, d: rp.threshold_datasets(pair_metrics(s, d), "label_reuse_pct", [25, 50, 75, 100]).groupBy("dataset").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("ontology_id").alias("ontologies")),
    "report_graph_datasets": lambda s, d: rp.threshold_datasets(pair_metrics(s, d).filter("pattern_total > 0").withColumn("pct", F.col("coverage_graph") * 100), "pct", [10, 50, 100]).select("dataset", "ontology_id", "pattern_id"),
    "report_histogram": lambda s, d: rp.histogram(pair_metrics(s, d), "reused_total_label", [0, 1, 2, 5, 10]),
    "report_equal_width": lambda s, d: rp.equal_width(pair_metrics(s, d), "reused_total_label", 7),
    "report_cumulative_share": lambda s, d: rounded(rp.cumulative_share(pair_metrics(s, d), "reused_total_label")),
    "report_five_numbers": lambda s, d: rounded(rp.five_numbers(pair_metrics(s, d), "reused_total_label")),
    "report_construct_summary": lambda s, d: rounded(rp.construct_summary(role_constructs(s, d, "ont"))),
    "report_pattern_constructs": lambda s, d: rounded(rp.construct_summary(rp.by_name(role_constructs(s, d, "pat"), "graph_id"))),
    "report_expressivity": lambda s, d: rounded(rp.expressivity_distribution(role_constructs(s, d, "ont"))),
    "report_pattern_expressivity": lambda s, d: rounded(rp.expressivity_distribution(rp.richest(role_constructs(s, d, "pat"), "graph_id", "graph_id"))),
    "report_name_constructs": lambda s, d: rounded(rp.construct_summary(rp.by_name(named_patterns(s, d), "name"))),
    "report_name_expressivity": lambda s, d: rounded(rp.expressivity_distribution(rp.richest(named_patterns(s, d), "name", "graph_id"))),
    "report_form_distribution": lambda s, d: rounded(rp.form_distribution(with_forms(s, d), us.FORMS)),
    "report_form_presence": lambda s, d: rp.form_presence(with_forms(s, d), "pattern_id", us.FORMS),
    "report_reuse_extent": lambda s, d: rounded(rp.reuse_extent(pair_metrics(s, d))),
    "report_pattern_profile": lambda s, d: rounded(rp.pattern_profile(with_forms(s, d), us.FORMS)),
    "report_with_and_without": with_and_without,
    "report_expressivity_by_reuse": lambda s, d: rp.expressivity_by_reuse(with_reuse(Triples(s, d))),
    "report_construct_differences": lambda s, d: rounded(rp.construct_differences(with_reuse(Triples(s, d)))),
    "report_pair_constructs": pair_construct_table,
    "report_pair_complexity": pair_complexity,
    "report_job_summary": job_summary,
    "report_usage_averages": lambda s, d: rounded(rp.usage_averages(with_forms(s, d).select("pattern_total", "reused_total_label", *us.FORMS), us.FORMS)),
    "report_reuse_summary": lambda s, d: rounded(rp.reuse_summary(rp.reuse_extent(pair_metrics(s, d)))),
    "report_pair_summary": pair_summary,
    "report_empirical_cdf": lambda s, d: rounded(rp.empirical_cdf(pair_metrics(s, d), "reused_total_label")),
    "report_dataset_members": dataset_members,
    "report_top_patterns": lambda s, d: rounded(pair_metrics(s, d).orderBy(F.desc("label_reuse_pct"), F.desc("reused_total_graph"), "ontology_id", "pattern_id").limit(10).select("ontology_id", "pattern_id", "reused_total_graph", "label_reuse_pct")),
}

_M = CTE + gq.COVERAGE_CTE + ", m AS (SELECT *, CASE WHEN pattern_total > 0 THEN reused_total_graph / pattern_total ELSE 0 END AS coverage_graph, CASE WHEN pattern_total > 0 THEN reused_total_label / pattern_total * 100 ELSE 0 END AS label_reuse_pct FROM cov) "
_MF = CTE + gq.COVERAGE_CTE + gq.USAGE_CTE + ", mf AS (SELECT cov.*, CASE WHEN pattern_total > 0 THEN reused_total_label / pattern_total * 100 ELSE 0 END AS label_reuse_pct, us.* EXCLUDE (ontology_id, pattern_id) FROM cov JOIN us USING (ontology_id, pattern_id)) "
_C = CTE + gq.CONSTRUCT_CTE
_CR = _C + ", cr AS (SELECT cs.*, CASE WHEN graph_id IN (SELECT ontology_id FROM ru) THEN 1 ELSE 0 END AS reuse FROM cs WHERE graph_id LIKE 'ont%') "
_FORM_ROWS = lambda rel, value: " UNION ALL ".join(f"SELECT '{f}' AS form, {value.format(f=f)} FROM {rel}" for f in us.FORMS)
_CON_ROWS = lambda rel, value: " UNION ALL ".join(f"SELECT '{c}' AS construct, " + value.format(c=f'"{c}"') + f" FROM {rel}" for c in CONSTRUCTS)
_SUMMARY = "SELECT construct, sum(v)::BIGINT AS count, round(avg(v) * 100, 6) AS percent FROM ({rows}) GROUP BY construct"
_DIST = "SELECT expressivity, count(*) AS count, round(count(*) / sum(count(*)) OVER () * 100, 6) AS percent FROM cs WHERE graph_id LIKE '{role}%' GROUP BY expressivity"
ORACLE_SQL = {
    "report_threshold_counts": _M + " UNION ALL ".join(f"SELECT {t} AS threshold, count(*) FILTER (label_reuse_pct >= {t}) AS count_ge FROM m" for t in rp.THRESHOLDS),
    "report_band_counts": _M + " UNION ALL ".join(f"SELECT '{n}' AS bin, count(*) FILTER ({f'label_reuse_pct = {lo}' if hi is None else f'label_reuse_pct >= {lo} AND label_reuse_pct < {hi}'}) AS count FROM m" for n, lo, hi in rp.BANDS),
    "report_threshold_datasets": _M + "SELECT x.d AS dataset, count(*) AS pairs, count(DISTINCT ontology_id) AS ontologies FROM m, (VALUES (25),(50),(75),(100)) x(d) WHERE label_reuse_pct >= x.d GROUP BY x.d",
    "report_graph_datasets": _M + "SELECT x.d AS dataset, ontology_id, pattern_id FROM m, (VALUES (10),(50),(100)) x(d) WHERE pattern_total > 0 AND coverage_graph * 100 >= x.d",
    "report_histogram": _M + "SELECT CASE WHEN reused_total_label < 1 THEN '0-0' WHEN reused_total_label < 2 THEN '1-1' WHEN reused_total_label < 5 THEN '2-4' WHEN reused_total_label < 10 THEN '5-9' ELSE '10+' END AS bin, count(*) AS count FROM m GROUP BY 1",
    "report_equal_width": _M + ", x AS (SELECT min(reused_total_label) AS lo, max(reused_total_label) AS hi FROM m) SELECT CASE WHEN hi = lo THEN 1 ELSE least(7, floor((reused_total_label - lo) / (hi - lo) * 7)::INT + 1) END AS bucket, count(*) AS count FROM m, x GROUP BY 1",
    "report_cumulative_share": _M + "SELECT reused_total_label, n, round(sum(n) OVER (ORDER BY reused_total_label) / sum(n) OVER (), 6) AS share FROM (SELECT reused_total_label, count(*) AS n FROM m GROUP BY 1)",
    "report_five_numbers": _M + "SELECT min(reused_total_label) AS low, quantile_cont(reused_total_label, 0.25) AS q1, median(reused_total_label) AS median, quantile_cont(reused_total_label, 0.75) AS q3, max(reused_total_label) AS high, count(*) AS n FROM m",
    "report_construct_summary": _C + _SUMMARY.format(rows=_CON_ROWS("cs WHERE graph_id LIKE 'ont%'", "{c}::INT AS v")),
    "report_pattern_constructs": _C + _SUMMARY.format(rows=_CON_ROWS("cs WHERE graph_id LIKE 'pat%'", "{c}::INT AS v")),
    "report_expressivity": _C + _DIST.format(role="ont"),
    "report_pattern_expressivity": _C + _DIST.format(role="pat"),
    "report_name_constructs": _C + ", bn AS (SELECT length(graph_id) % 3 AS name, " + ", ".join(f'bool_or("{c}") AS "{c}"' for c in CONSTRUCTS)
    + " FROM cs WHERE graph_id LIKE 'pat%' GROUP BY 1) " + _SUMMARY.format(rows=_CON_ROWS("bn", "{c}::INT AS v")),
    "report_name_expressivity": _C + """, rn AS (SELECT expressivity FROM cs WHERE graph_id LIKE 'pat%'
        QUALIFY row_number() OVER (PARTITION BY length(graph_id) % 3 ORDER BY dl_complexity_score DESC, graph_id DESC) = 1)
        SELECT expressivity, count(*) AS count, round(count(*) / sum(count(*)) OVER () * 100, 6) AS percent FROM rn GROUP BY expressivity""",
    "report_form_distribution": _MF + f"SELECT form, sum(n)::BIGINT AS count, round(sum(n) / greatest(sum(sum(n)) OVER (), 1) * 100, 6) AS percent FROM ({_FORM_ROWS('mf', '{f} AS n')}) GROUP BY form",
    "report_form_presence": _MF + f"SELECT form, count(*) FILTER (n > 0) AS patterns, count(*) AS \"of\" FROM ({_FORM_ROWS('mf GROUP BY pattern_id', 'sum({f}) AS n')}) GROUP BY form",
    "report_reuse_extent": _M + """SELECT ontology_id, count(DISTINCT pattern_id) AS n_patterns, count(DISTINCT CASE WHEN reused_total_label > 0 THEN pattern_id END) AS n_label,
        count(DISTINCT CASE WHEN reused_total_graph > 0 THEN pattern_id END) AS n_graph, round(max(label_reuse_pct), 6) AS max_pct, round(avg(label_reuse_pct), 6) AS avg_pct,
        bool_or(reused_total_graph > 0) AS any_reuse, bool_or(reused_total_graph > 0) AS any_reuse_label FROM m GROUP BY ontology_id""",
    "report_pattern_profile": _MF + "SELECT pattern_id, count(*) AS pairs, count(DISTINCT CASE WHEN reused_total_graph > 0 THEN ontology_id END) AS used_by, round(avg(label_reuse_pct), 6) AS avg_pct, round(max(label_reuse_pct), 6) AS max_pct, "
    + ", ".join(f"sum({f})::BIGINT AS {f}, round(sum({f}) / greatest({' + '.join(f'sum({x})' for x in us.FORMS)}, 1), 6) AS {f}_share" for f in us.FORMS) + " FROM mf GROUP BY pattern_id",
    "report_with_and_without": _CR + """, md AS (SELECT reuse, expressivity, row_number() OVER (PARTITION BY reuse ORDER BY count(*) DESC, expressivity) AS k FROM cr GROUP BY reuse, expressivity),
        x AS (SELECT count(*) FILTER (reuse = 1) AS n_with, count(*) FILTER (reuse = 0) AS n_without, avg(dl_complexity_score) FILTER (reuse = 1) AS a, avg(dl_complexity_score) FILTER (reuse = 0) AS b,
          avg(n_axioms) FILTER (reuse = 1) AS c, avg(n_axioms) FILTER (reuse = 0) AS d FROM cr)
        SELECT n_with, n_without, round(a, 6) AS constructs_with, round(b, 6) AS constructs_without, round(c, 6) AS axioms_with, round(d, 6) AS axioms_without,
          (SELECT expressivity FROM md WHERE reuse = 1 AND k = 1) AS expressivity_with, (SELECT expressivity FROM md WHERE reuse = 0 AND k = 1) AS expressivity_without,
          round(CASE WHEN b <> 0 THEN (a - b) / b * 100 END, 6) AS constructs_delta_pct, round(CASE WHEN d <> 0 THEN (c - d) / d * 100 END, 6) AS axioms_delta_pct FROM x""",
    "report_expressivity_by_reuse": _CR + "SELECT expressivity, count(*) FILTER (reuse = 1) AS with_reuse, count(*) FILTER (reuse = 0) AS without_reuse FROM cr GROUP BY expressivity",
    "report_construct_differences": _CR + f"SELECT construct, round(w, 6) AS pct_with, round(wo, 6) AS pct_without, round(w - wo, 6) AS diff_pp FROM (SELECT construct, avg(v) FILTER (reuse = 1) * 100 AS w, avg(v) FILTER (reuse = 0) * 100 AS wo FROM ({_CON_ROWS('cr', '{c}::INT AS v, reuse')}) GROUP BY construct)",
    "report_pair_constructs": _C + "SELECT construct, count(*) FILTER (o) AS ontology, count(*) FILTER (p) AS pattern, count(*) FILTER (o AND p) AS both, count(*) FILTER (o AND NOT p) AS only_ontology, count(*) FILTER (p AND NOT o) AS only_pattern, count(*) AS pairs, round(count(*) FILTER (o AND p) / count(*) * 100, 6) AS both_pct FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS construct, coalesce(a.\"{c}\", false) AS o, coalesce(b.\"{c}\", false) AS p FROM pr LEFT JOIN cs a ON a.graph_id = ontology_id LEFT JOIN cs b ON b.graph_id = pattern_id" for c in CONSTRUCTS) + ") GROUP BY construct",
    "report_pair_complexity": _C + """, x AS (SELECT count(*)::DOUBLE AS pairs, avg(a.dl_complexity_score) AS mean_ontology_constructs, avg(a.n_axioms) AS mean_ontology_axioms,
        avg(b.dl_complexity_score) AS mean_pattern_constructs, avg(b.n_axioms) AS mean_pattern_axioms FROM pr LEFT JOIN cs a ON a.graph_id = ontology_id LEFT JOIN cs b ON b.graph_id = pattern_id)
        """ + " UNION ALL ".join(f"SELECT '{m}' AS metric, round({m}, 6) AS value FROM x" for m in ("pairs", "mean_ontology_constructs", "mean_ontology_axioms", "mean_pattern_constructs", "mean_pattern_axioms")),
    "report_job_summary": _M + "SELECT count(*) AS pairs, count(DISTINCT ontology_id) AS ontologies, count(DISTINCT pattern_id) AS patterns, sum(reused_total_graph)::BIGINT AS reused_graph, sum(reused_total_label)::BIGINT AS reused_label, count(*) FILTER (reused_total_graph > 0) AS pairs_with_reuse FROM m",
    "report_usage_averages": _MF + ", a AS (SELECT " + ", ".join(f"avg({c})::DOUBLE AS avg_{c}" for c in ("pattern_total", "reused_total_label", *us.FORMS))
    + ", " + ", ".join(f"(sum({f}) / greatest({' + '.join(f'sum({x})' for x in us.FORMS)}, 1) * 100)::DOUBLE AS {f}_pct" for f in us.FORMS) + " FROM mf) "
    + " UNION ALL ".join(f"SELECT '{c}' AS metric, round({c}, 6) AS value FROM a" for c in (*(f"avg_{c}" for c in ("pattern_total", "reused_total_label", *us.FORMS)), *(f"{f}_pct" for f in us.FORMS))),
    "report_reuse_summary": _M + """, x AS (SELECT ontology_id, count(DISTINCT pattern_id) AS n, count(DISTINCT CASE WHEN reused_total_label > 0 THEN pattern_id END) AS l, bool_or(reused_total_graph > 0) AS hit FROM m GROUP BY ontology_id)
        SELECT count(*) AS ontologies, count(*) FILTER (hit) AS ontologies_with_reuse, round(count(*) FILTER (hit) / count(*) * 100, 6) AS pct_with_reuse, round(avg(n), 6) AS avg_patterns, round(avg(l), 6) AS avg_patterns_with_reuse FROM x""",
    "report_pair_summary": _C + ", x AS (SELECT avg(a.dl_complexity_score) AS mean_ontology_constructs, avg(b.dl_complexity_score) AS mean_pattern_constructs, avg(a.n_axioms) AS mean_ontology_axioms, "
    + ", ".join(f'avg(coalesce({k}."{c}", false)::INT) * 100 AS "{c}_{side}_pct"' for c in CONSTRUCTS for k, side in (("a", "ontology"), ("b", "pattern")))
    + " FROM pr LEFT JOIN cs a ON a.graph_id = ontology_id LEFT JOIN cs b ON b.graph_id = pattern_id) "
    + " UNION ALL ".join(f"SELECT '{m}' AS metric, round(\"{m}\", 6) AS value FROM x" for m in ("mean_ontology_constructs", "mean_pattern_constructs", "mean_ontology_axioms", *(f"{c}_{side}_pct" for c in CONSTRUCTS for side in ("ontology", "pattern")))),
    "report_empirical_cdf": _M + "SELECT reused_total_label, round(row_number() OVER (ORDER BY reused_total_label) / count(*) OVER (), 6) AS share FROM m",
    "report_dataset_members": _M + ", ds AS (SELECT x.d AS dataset, ontology_id, pattern_id FROM m, (VALUES (50),(100)) x(d) WHERE label_reuse_pct >= x.d), g2 AS (SELECT dataset, ontology_id AS graph_id FROM ds UNION SELECT dataset, pattern_id FROM ds) SELECT dataset, graph_id, count(*) AS triples FROM g2 JOIN t USING (graph_id) GROUP BY ALL",
    "report_top_patterns": _M + "SELECT ontology_id, pattern_id, reused_total_graph, round(label_reuse_pct, 6) AS label_reuse_pct FROM m ORDER BY m.label_reuse_pct DESC, reused_total_graph DESC, ontology_id, pattern_id LIMIT 10",
}
