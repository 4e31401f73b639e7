"""Queries over labels, texts and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reweave.functions import labels as fl
from reweave.operators import simjoin as sj
from reweave.plans.bindings import table
from reweave.plans.report_queries import rounded


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("label")).distinct()


def types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.lower("p_type").alias("label")).distinct()


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rounded(sj.vector_join(rows.filter("vec_id % 100 = 0"), rows, 0.5))  # the queries of a search, against all vectors


def label_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.col("p_name"), F.lit("_"), F.col("p_type"), F.lit("-"), F.col("p_brand"))
    iri = F.concat(F.lit("http://ex.org/"), F.lower("p_type"), F.when(F.col("p_size") % 2 == 0, "#").otherwise("/"), F.col("p_brand"))
    rows = table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"), iri.alias("iri"), F.col("p_name"))
    words = fl.tokens(fl.normalize_label(F.col("raw")))
    return rounded(
        rows.select(
            "p_partkey",
            fl.normalize_label(F.col("raw")).alias("plain"),
            fl.local_name(F.col("iri")).alias("local"),
            fl.base_namespace(F.col("iri")).alias("ns"),
            F.size(words).alias("n_words"),
            F.size(fl.ngrams(F.col("p_name"))).alias("n_grams"),
            fl.jaccard(words, fl.tokens(F.lower("p_name"))).alias("similar"),
            fl.bounded_levenshtein(F.col("p_name"), F.lower(F.col("raw")), 5).alias("edits"),
            fl.percent(F.size(words), F.char_length("p_name")).alias("pct"),
        )
    )


QUERIES = {
    "join_char_cosine": lambda s, d: rounded(sj.char_join(names(s, d), names(s, d), 0.6)),
    "join_word_cosine": lambda s, d: rounded(sj.word_join(names(s, d), names(s, d), 0.5)),
    "join_word_jaccard": lambda s, d: rounded(sj.jaccard_join(names(s, d), names(s, d), 0.3)),
    "join_edit_distance": lambda s, d: sj.edit_join(names(s, d), names(s, d), 5),
    "join_label_hybrid": lambda s, d: rounded(sj.label_join(names(s, d), names(s, d), 0.7, 1)),
    "join_vector_cosine": vectors,
    "label_functions": label_functions,
}
_N = "WITH n AS (SELECT DISTINCT p_name AS label FROM part), "
_COS = """c AS (SELECT label, g, count(*) AS k FROM {grams} GROUP BY ALL), m AS (SELECT label, sqrt(sum(k * k)) AS nm FROM c GROUP BY label)
SELECT a.label AS left_label, b.label AS right_label, round(sum(a.k * b.k) / (x.nm * y.nm), 6) AS similarity FROM c a JOIN c b USING (g)
JOIN m x ON x.label = a.label JOIN m y ON y.label = b.label GROUP BY a.label, b.label, x.nm, y.nm HAVING sum(a.k * b.k) / (x.nm * y.nm) >= {t} - 1e-12"""
ORACLE_SQL = {
    "join_char_cosine": _N + _COS.format(grams="(SELECT label, unnest(CASE WHEN length(label) < 3 THEN [label] ELSE list_transform(range(1, length(label) - 1), lambda i: substr(label, i, 3)) END) AS g FROM n)", t=0.6),
    "join_word_cosine": _N + _COS.format(grams="(SELECT label, unnest(string_split(label, ' ')) AS g FROM n)", t=0.5),
    "join_word_jaccard": _N + """w AS (SELECT label, list_distinct(string_split(label, ' ')) AS s FROM n), p AS (SELECT a.label AS left_label, b.label AS right_label,
        len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) AS similarity FROM w a, w b) SELECT left_label, right_label, round(similarity, 6) AS similarity FROM p WHERE p.similarity >= 0.3""",
    "join_edit_distance": _N + "x AS (SELECT 1) SELECT a.label AS left_label, b.label AS right_label, levenshtein(a.label, b.label)::INT AS distance FROM n a, n b WHERE levenshtein(a.label, b.label) <= 5",
    "join_vector_cosine": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) AS similarity
        FROM v a, v b WHERE a.vec_id % 100 = 0) SELECT query_id, vec_id, round(similarity, 6) AS similarity FROM p WHERE p.similarity >= 0.5""",
    "label_functions": """WITH r AS (SELECT p_partkey, p_name, p_name || '_' || p_type || '-' || p_brand AS raw, 'http://ex.org/' || lower(p_type) || CASE WHEN p_size % 2 = 0 THEN '#' ELSE '/' END || p_brand AS iri FROM part),
        q AS (SELECT *, lower(trim(regexp_replace(regexp_replace(regexp_replace(raw, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))) AS plain FROM r),
        z AS (SELECT *, string_split(plain, ' ') AS w, string_split(lower(p_name), ' ') AS u FROM q)
        SELECT p_partkey, plain, regexp_extract(iri, '([^#/]*)$', 1) AS local, CASE WHEN contains(iri, '#') THEN regexp_extract(iri, '^(.*#)', 1) ELSE iri END AS ns, len(w)::INT AS n_words,
          (length(p_name) - 2)::INT AS n_grams, round(len(list_intersect(w, u)) / len(list_distinct(list_concat(w, u))), 6) AS similar, least(levenshtein(p_name, lower(raw)), 6)::INT AS edits,
          round(len(w) / length(p_name) * 100.0, 6) AS pct FROM z""",
}
