"""Queries for reuse percentages by file, by name and for unions by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reweave.operators import stats as st
from reweave.operators import triples as tr
from reweave.plans import graph_queries as gq
from reweave.plans.bindings import CTE
from reweave.plans.report_queries import rounded
from reweave.vocab import SHORT

def with_name(df: DataFrame) -> DataFrame:
    """Pattern files share a name if the first five letters of their ids agree."""
    return df.withColumn("pattern_name", F.substring("pattern_id", 1, 5))


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gq.Graphs(spark, sf_dir)
    reuse = st.reuse_rows(g.pairs, g.reuse(), g.label_reuse(by_kind=True))
    return with_name(st.enriched(reuse, tr.entity_counts(g.found)))


def union(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gq.Graphs(spark, sf_dir)
    return st.union_by_name(with_name(g.pairs), tr.entity_rows(g.triples, SHORT), tr.term_rows(g.triples))


COLUMNS = ["ontology_id", "pattern_id", "reused_total", "label_reused_total", "pattern_n_total", "ontology_n_total", "pct_reused_classes", "pct_reused_total", "pct_label_reused_total"]
QUERIES = {
    "stats_enriched": lambda s, d: rounded(enriched(s, d).select(*COLUMNS)),
    "stats_collapsed": lambda s, d: rounded(st.collapsed(enriched(s, d))),
    "stats_union_by_name": lambda s, d: rounded(union(s, d)),
    "stats_unique_patterns": lambda s, d: rounded(st.unique_patterns(union(s, d))),
    "stats_average_by_ontology": lambda s, d: rounded(st.average_by_ontology(enriched(s, d))),
}
_E = CTE + """, lk AS (SELECT DISTINCT ontology_id, pattern_id, p.kind, p.iri FROM pr JOIN lb p ON p.graph_id = pattern_id JOIN lb o ON o.graph_id = ontology_id AND o.label = p.label AND o.kind = p.kind),
n AS (SELECT graph_id, count(*) AS total, count(*) FILTER (kind = 'class') AS classes FROM e GROUP BY graph_id),
g AS (SELECT ontology_id, pattern_id, count(*) AS reused_total, count(*) FILTER (kind = 'class') AS reused_classes FROM ru GROUP BY ALL),
l AS (SELECT ontology_id, pattern_id, count(*) AS label_reused_total FROM lk GROUP BY ALL),
en AS (SELECT pr.ontology_id, pr.pattern_id, substr(pr.pattern_id, 1, 5) AS pattern_name, coalesce(reused_total, 0) AS reused_total, coalesce(label_reused_total, 0) AS label_reused_total,
  b.total AS pattern_n_total, a.total AS ontology_n_total, coalesce(reused_classes, 0) / nullif(b.classes, 0) * 100 AS pct_reused_classes,
  coalesce(reused_total, 0) / b.total * 100 AS pct_reused_total, coalesce(label_reused_total, 0) / b.total * 100 AS pct_label_reused_total
  FROM pr LEFT JOIN g USING (ontology_id, pattern_id) LEFT JOIN l USING (ontology_id, pattern_id) LEFT JOIN n a ON a.graph_id = pr.ontology_id LEFT JOIN n b ON b.graph_id = pr.pattern_id)
"""
_LABEL = "lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_extract({iri}, '([^#]*)$', 1), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')))"
_U = CTE + f""", own AS (SELECT DISTINCT ontology_id, substr(pattern_id, 1, 5) AS pattern_name, kind, iri FROM pr JOIN e ON graph_id = pattern_id),
uc AS (SELECT ontology_id, pattern_name, count(*) AS union_n_total, count(*) FILTER (EXISTS (SELECT 1 FROM tm WHERE tm.graph_id = ontology_id AND term = iri)) AS union_reused_total FROM own GROUP BY ALL),
ul AS (SELECT ontology_id, pattern_name, count(*) AS c FROM (SELECT DISTINCT own.ontology_id, pattern_name, own.kind, {_LABEL.format(iri='own.iri')} AS label FROM own) m
  WHERE label <> '' AND EXISTS (SELECT 1 FROM e WHERE e.graph_id = m.ontology_id AND e.kind = m.kind AND {_LABEL.format(iri='e.iri')} = m.label) GROUP BY ALL),
u AS (SELECT ontology_id, pattern_name, union_n_total, union_reused_total, coalesce(c, 0) AS union_label_reused_total, union_reused_total / union_n_total * 100 AS pct_union_reused_total,
  coalesce(c, 0) / union_n_total * 100 AS pct_union_label_reused_total FROM uc LEFT JOIN ul USING (ontology_id, pattern_name))
"""
_UN = ["union_n_total", "union_reused_total", "union_label_reused_total"]
_UP = ["pct_union_reused_total", "pct_union_label_reused_total"]
ORACLE_SQL = {
    "stats_enriched": _E + "SELECT * REPLACE (round(pct_reused_classes, 6) AS pct_reused_classes, round(pct_reused_total, 6) AS pct_reused_total, round(pct_label_reused_total, 6) AS pct_label_reused_total) FROM (SELECT " + ", ".join(COLUMNS) + " FROM en)",
    "stats_collapsed": _E + """SELECT ontology_id, pattern_name, sum(reused_total)::BIGINT AS reused_total, sum(label_reused_total)::BIGINT AS label_reused_total, sum(pattern_n_total)::BIGINT AS pattern_n_total,
        round(sum(reused_total) / sum(pattern_n_total) * 100, 6) AS pct_reused_total, round(sum(label_reused_total) / sum(pattern_n_total) * 100, 6) AS pct_label_reused_total FROM en GROUP BY ALL""",
    "stats_union_by_name": _U + f"SELECT ontology_id, pattern_name, {', '.join(_UN)}, {', '.join(f'round({c}, 6) AS {c}' for c in _UP)} FROM u",
    "stats_unique_patterns": _U + f"SELECT pattern_name, {', '.join(f'max({c}) AS {c}' for c in _UN)}, {', '.join(f'round(max({c}), 6) AS {c}' for c in _UP)} FROM u GROUP BY pattern_name",
    "stats_average_by_ontology": _E + "SELECT ontology_id, round(avg(pct_reused_total), 6) AS avg_pct_reused_graph, round(avg(pct_label_reused_total), 6) AS avg_pct_reused_labels, count(*) AS n_patterns FROM en GROUP BY ontology_id",
}
