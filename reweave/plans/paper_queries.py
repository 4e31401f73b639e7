"""Queries over search hits, library files and bibliographic records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reweave.operators import discovery as di
from reweave.operators import papers as pa
from reweave.plans.bindings import table
from reweave.plans.report_queries import rounded
from reweave.storage import written

HREF = {"href": r'(?i)href\s*=\s*"([^"]+)"', "src": r'(?i)src\s*=\s*"([^"]+)"'}


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    return table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("file"), host.alias("dir"), F.col("html").alias("text"))


def url_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", di.stem(url).alias("stem"), di.extension(url, F.lit(None).cast("string")).alias("ext"), di.sanitize(url).alias("label"),
        di.is_generic(url, "example.com").alias("generic"), di.raw_url(F.concat(F.lit("https://github.com/o/r/blob/main/"), F.col("page_id")), "raw.host").alias("raw"),
    )


def scored(spark: SparkSession, sf_dir: str, ratio: bool = False, threshold: float | None = None, most: int = 1) -> tuple[DataFrame, DataFrame]:
    """The seeds, and the candidates of different seeds among different works, all or those that reach the threshold: as many
    copies of a work as the `most` best matches of a seed can have. SQL can only say the score by words; `ratio` makes it the
    whole score."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"), (F.lit(1990) + F.col("p_size") % 10).alias("year"), F.col("p_brand").alias("venue"))
    seeds = part.filter("p_partkey % 20 = 0").select(F.col("p_partkey").alias("seed_id"), "title", "year", F.lit("#3").alias("hint"))
    works = part.filter("p_partkey % 20 <> 0").select(F.col("p_partkey").alias("work_id"), "title", "year", "venue")
    found = pa.linkage_candidates(pa.distinct_seeds(seeds), pa.first_works(works, most), "#1", ratio=ratio, threshold=threshold)
    return seeds, found


def linked(spark: SparkSession, sf_dir: str, ratio: bool = False) -> DataFrame:
    """The best match of each seed."""
    seeds, found = scored(spark, sf_dir, ratio, 0.82)
    return pa.for_every_seed(pa.best_matches(found, 0.82, 1), seeds)


def best_three(spark: SparkSession, sf_dir: str, ratio: bool = False) -> DataFrame:
    seeds, found = scored(spark, sf_dir, ratio, most=3)
    return pa.for_every_seed(pa.ranked(found, 3), seeds)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("type"), (F.col("o_orderstatus") == "F").alias("reused"),
        F.concat(F.col("o_custkey").cast("string"), F.lit(" and "), (F.col("o_custkey") % 7).cast("string")).alias("authors"), F.col("o_totalprice").alias("citations"),
    )


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("doi"), "lang", "source")
    thin = d.filter("doc_id % 3 = 0").withColumns({"lang": F.lit(None).cast("string"), "doc_id": F.col("doc_id") - 1_000_000})
    both = d.unionByName(thin).withColumns({"id": F.lit(None).cast("string"), "title": F.lit(None).cast("string")})
    return pa.merged_works(both, "doc_id", ["lang", "source"])


def text_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", pa.reuse_gate(F.col("text"), ["licensed", "released"], r"\blicense\b", r"\b(the|this)\b").cast("int").alias("gate"), F.md5(pa.squeeze(F.col("text"))).alias("squeezed"))


def name_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([("apache license",), ("mit_license",), ("general-public",), ("all rights",)], "name string")
    found = pa.named(table(spark, sf_dir, "documents").select("doc_id", "text"), names, "doc_id")
    return found.groupBy("name").agg(F.count(F.lit(1)).alias("docs"), F.sum("doc_id").alias("ids"))


def ratio_of_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return rounded(t.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("quality"), F.avg("toxic").alias("toxic_rate")))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.lower("text")
    flags = {"license": F.contains(t, F.lit("license")), "pipe": F.contains(t, F.lit("|")), "rights": F.contains(t, F.lit("rights reserved"))}
    rows = table(spark, sf_dir, "documents").select(*[f.cast("int").alias(n) for n, f in flags.items()])
    return rounded(pa.signal_rates(rows, list(flags)))


def interesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("publisher"), F.col("lang").alias("venue"), F.lit(None).cast("string").alias("url"))
    return pa.of_interest(d, ["SRC1", "es"], ["x.org"]).select("doc_id")


def in_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches by words; the second round takes works that hold the seed's title, from the years around too."""
    seeds, found = scored(spark, sf_dir, threshold=0.95)
    found = written(found, "candidates")
    return pa.for_every_seed(pa.matched_in_rounds(found.filter("abs(year - seed_year) = 0"), pa.phrase_candidates(found), 0.95, 2), seeds)


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "part").filter("p_partkey % 20 = 0").select(F.col("p_partkey").alias("seed_id"), F.col("p_name").alias("seed_title"))
    matches = written(linked(spark, sf_dir), "matches")
    matched = matches.select(F.col("work_id").alias("seed")).distinct()
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("seed"), F.col("l_orderkey").alias("id")).join(matched, "seed", "left_semi")
    cited = pa.citations(lines, 20).withColumnRenamed("seed", "work_id").join(lines.groupBy(F.col("seed").alias("work_id")).agg(F.count(F.lit(1)).alias("total")), "work_id")
    return pa.audited(seeds, matches, cited)


def citing_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    title = F.when(F.col("lang") != "de", F.concat(F.lit(" "), F.col("lang"), F.lit("  "), F.col("source")))
    doi = F.when(F.col("n_chars") > 1000, F.col("doc_id").cast("string")).when(F.col("n_chars") > 100, F.concat(F.lit("http://d/"), F.col("doc_id")))
    return pa.citing_rows(d.select(
        F.col("source").alias("seed_id"), F.length("lang").alias("seed_year"), title.alias("title"), F.lit("u").alias("url"), F.col("n_chars").alias("year"),
        doi.alias("doi"), F.col("doc_id").alias("id"), F.col("source").alias("venue"), (F.col("n_chars") > 500).alias("is_oa"), F.col("lang").alias("oa_status"),
    ))


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as classified works of the seed that is their source."""
    t = F.lower(F.coalesce("text", F.lit("")))
    parts = [F.when(F.contains(t, F.lit(w)), F.lit(w)) for w in ("license", "rights reserved", "apache", "benchmark")]
    label = F.when(F.contains(t, F.lit("license")), "Possibly").otherwise("Unlikely")
    return table(spark, sf_dir, "documents").select("doc_id", "source", label.alias("label"), F.concat_ws(" ; ", *parts).alias("matched_names"))


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orders(spark, sf_dir)
    stats = pa.citation_stats(o, "type")
    return rounded(pa.statistics({"available": pa.availability(o, "reused"), "types": pa.value_counts(o, "type"), "mean_citations": stats.select("type", "mean")}))


QUERIES = {
    "papers_signal_rates": signals,
    "papers_of_interest": interesting,
    "papers_labels_by_year": lambda s, d: pa.labels_by(orders(s, d).withColumn("type", F.when(F.col("type").startswith("1"), "urgent").otherwise("other")), "year", "type", ["urgent", "other"]),
    "hits_iri_methods": lambda s, d: di.extract_iris(files(s, d), HREF).groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("iri").alias("iris")),
    "hits_directory_summary": lambda s, d: di.directory_summary(files(s, d), di.extract_iris(files(s, d), HREF)),
    "hits_url_functions": url_functions,
    "papers_linkage": lambda s, d: rounded(linked(s, d, True).select("seed_id", "work_id", "score")),
    "papers_linkage_ranked": lambda s, d: rounded(best_three(s, d, True).select("seed_id", "work_id", "rank", "sim", "year_bonus", "evidence_bonus", "hint_bonus", "score")),
    "papers_linkage_words": lambda s, d: rounded(linked(s, d).select("seed_id", "work_id", "score")),
    "papers_linkage_words_ranked": lambda s, d: rounded(best_three(s, d).select("seed_id", "work_id", "rank", "sim", "year_bonus", "evidence_bonus", "hint_bonus", "score")),
    "papers_linkage_rounds": lambda s, d: rounded(in_rounds(s, d).select("seed_id", "work_id", "round", "score")),
    "papers_linkage_audit": audit,
    "papers_citing_export": citing_export,
    "papers_classification_summary": lambda s, d: pa.classification_summary(classes(s, d), "source"),
    "papers_overview": lambda s, d: pa.overview(classes(s, d), "source", "label", ["Possibly", "Unlikely"]),
    "papers_matched_names": lambda s, d: pa.matched_name_counts(classes(s, d), 3),
    "papers_availability": lambda s, d: pa.availability(orders(s, d), "reused"),
    "papers_in_years": lambda s, d: pa.value_counts(pa.in_years(orders(s, d), 1994, 1996), "type"),
    "papers_value_counts": lambda s, d: pa.value_counts(table(s, d, "documents"), "lang", "doc_id"),
    "papers_statistics": statistics,
    "papers_merged": merged,
    "papers_per_year": lambda s, d: pa.per_year(orders(s, d), 1990, 2001, "urgent"),
    "papers_authors": lambda s, d: pa.author_counts(orders(s, d), "authors", 50),
    "papers_citation_stats": lambda s, d: rounded(pa.citation_stats(orders(s, d), "type")),
    "papers_citations_capped": lambda s, d: pa.citations(table(s, d, "events").select(F.col("user_id").alias("seed"), F.col("event_type").alias("id")), 3),
    "papers_text_flags": text_flags,
    "papers_name_hits": name_hits,
    "papers_labels_by_source": ratio_of_signals,
}
_F = """WITH f AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS dir, html FROM pages),
x AS (SELECT DISTINCT page_id, dir, trim(iri) AS iri, method FROM (
  SELECT page_id, dir, unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*"([^"]+)"', 1)) AS iri, 'href' AS method FROM f
  UNION ALL SELECT page_id, dir, unnest(regexp_extract_all(html, '(?i)src\\s*=\\s*"([^"]+)"', 1)), 'src' FROM f) WHERE trim(iri) <> '')
"""
_S = """WITH p AS (SELECT p_partkey AS k, p_name AS title, 1990 + p_size % 10 AS y, p_brand AS venue, list_distinct(string_split(lower(p_name), ' ')) AS w FROM part),
c AS (SELECT a.k AS seed_id, b.k AS work_id, abs(a.y - b.y) AS dy, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) AS sim,
  CASE abs(a.y - b.y) WHEN 0 THEN 0.15 WHEN 1 THEN 0.10 WHEN 2 THEN 0.05 ELSE -0.10 END::DOUBLE AS year_bonus, CASE WHEN contains(b.venue, '#1') THEN 0.10 ELSE 0.0 END::DOUBLE AS evidence_bonus,
  CASE WHEN contains(b.venue, '#3') THEN 0.05 ELSE 0.0 END::DOUBLE AS hint_bonus FROM p a JOIN p b ON a.k % 20 = 0 AND b.k % 20 <> 0 AND len(list_intersect(a.w, b.w)) > 0),
z AS (SELECT *, sim + year_bonus + evidence_bonus + hint_bonus AS score FROM c)
"""
ORACLE_SQL = {
    "papers_signal_rates": "WITH f AS (SELECT contains(lower(text), 'license')::INT AS license, contains(text, '|')::INT AS pipe, contains(lower(text), 'rights reserved')::INT AS rights FROM documents) "
    + " UNION ALL ".join(f"SELECT '{n}' AS signal, sum({n})::BIGINT AS hits, round(avg({n}), 6) AS rate FROM f" for n in ("license", "pipe", "rights")),
    "papers_of_interest": "SELECT doc_id FROM documents WHERE contains(lower(source), 'src1') OR contains(lower(source), 'es') OR contains(lower(lang), 'src1') OR contains(lower(lang), 'es')",
    "papers_labels_by_year": "SELECT year(o_orderdate)::INT AS year, count(*) FILTER (starts_with(o_orderpriority, '1')) AS urgent, count(*) FILTER (NOT starts_with(o_orderpriority, '1')) AS other FROM orders GROUP BY 1",
    "hits_iri_methods": _F + "SELECT method, count(*) AS n, count(DISTINCT iri) AS iris FROM x GROUP BY method",
    "hits_directory_summary": _F + """SELECT f.dir, count(DISTINCT f.page_id) AS total_files, count(DISTINCT x.page_id) AS files_with_iri, count(DISTINCT f.page_id) - count(DISTINCT x.page_id) AS files_without_iri,
        count(DISTINCT x.iri) AS unique_iris FROM f LEFT JOIN x ON x.page_id = f.page_id GROUP BY f.dir""",
    "papers_linkage_words": _S + "SELECT seed_id, work_id, round(score, 6) AS score FROM z WHERE dy <= 1 AND z.score >= 0.82 QUALIFY row_number() OVER (PARTITION BY seed_id ORDER BY z.score DESC, work_id) = 1",
    "papers_linkage_words_ranked": _S + "SELECT seed_id, work_id, row_number() OVER (PARTITION BY seed_id ORDER BY z.score DESC, work_id)::INT AS rank, round(sim, 6) AS sim, year_bonus, evidence_bonus, hint_bonus, round(score, 6) AS score FROM z QUALIFY row_number() OVER (PARTITION BY seed_id ORDER BY z.score DESC, work_id) <= 3",
    "papers_merged": """WITH b AS (SELECT doc_id, md5(text) AS doi, lang, source FROM documents UNION ALL SELECT doc_id - 1000000, md5(text), NULL, source FROM documents WHERE doc_id % 3 = 0)
        SELECT doi AS key, min(doc_id) AS doc_id, arg_min(lang, doc_id) FILTER (lang IS NOT NULL) AS lang, arg_min(source, doc_id) AS source FROM b GROUP BY doi""",
    "papers_per_year": "SELECT y.y::INT AS year, count(o_orderkey) AS total, count(*) FILTER (o_orderpriority ILIKE '%urgent%') AS of_kind, count(*) FILTER (o_orderpriority ILIKE '%urgent%' AND o_orderstatus = 'F') AS reused_of_kind FROM range(1990, 2002) y(y) LEFT JOIN orders ON year(o_orderdate) = y.y GROUP BY y.y",
    "papers_authors": "WITH a AS (SELECT o_custkey::VARCHAR AS author FROM orders UNION ALL SELECT (o_custkey % 7)::VARCHAR FROM orders) SELECT author, count(*) AS n FROM a GROUP BY author ORDER BY n DESC, author LIMIT 50",
    "papers_citation_stats": "SELECT o_orderpriority AS type, round(sum(o_totalprice)::DOUBLE, 6) AS total, round(avg(o_totalprice)::DOUBLE, 6) AS mean, round(median(o_totalprice)::DOUBLE, 6) AS median, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders GROUP BY o_orderpriority",
    "papers_citations_capped": "SELECT user_id AS seed, least(count(DISTINCT event_type), 3) AS citation_count FROM events GROUP BY user_id",
    "papers_text_flags": r"""SELECT doc_id, (regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])(licensed|released)([^A-Za-z0-9_]|$)') AND regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])license([^A-Za-z0-9_]|$)')
        AND regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])(the|this)([^A-Za-z0-9_]|$)'))::INT AS gate, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS squeezed FROM documents""",
    "papers_labels_by_source": "SELECT source, count(*) AS n, sum(quality)::BIGINT AS quality, round(avg(toxic), 6) AS toxic_rate FROM documents JOIN labels USING (doc_id) GROUP BY source",
    "papers_linkage_rounds": _S + """, g AS (SELECT *, p.title AS st, q.title AS wt FROM z JOIN p ON p.k = seed_id JOIN p q ON q.k = work_id),
        r1 AS (SELECT seed_id, work_id, score FROM g WHERE dy = 0 AND score >= 0.95 QUALIFY row_number() OVER (PARTITION BY seed_id ORDER BY score DESC, work_id) = 1),
        r2 AS (SELECT seed_id, work_id, score FROM g WHERE dy <= 2 AND score >= 0.95 AND contains(lower(wt), lower(st)) AND seed_id NOT IN (SELECT seed_id FROM r1)
          QUALIFY row_number() OVER (PARTITION BY seed_id ORDER BY score DESC, work_id) = 1)
        SELECT seed_id, work_id, 1 AS round, round(score, 6) AS score FROM r1 UNION ALL SELECT seed_id, work_id, 2, round(score, 6) FROM r2""",
    "papers_linkage_audit": _S + """, m AS (SELECT z.*, q.title AS wt, q.y AS wy FROM z JOIN p q ON q.k = work_id WHERE dy <= 1 AND z.score >= 0.82 QUALIFY row_number() OVER (PARTITION BY seed_id ORDER BY z.score DESC, work_id) = 1),
        c2 AS (SELECT l_partkey AS k, least(count(DISTINCT l_orderkey), 20) AS n, count(*) AS total FROM lineitem GROUP BY l_partkey)
        SELECT p_partkey AS seed_id, p_name AS seed_title, coalesce(n, 0) AS citation_count, coalesce(work_id::VARCHAR, '') AS matched_id, coalesce(wt, '') AS matched_title, coalesce(wy::VARCHAR, '') AS matched_year,
          coalesce(printf('%.3f', m.score), '') AS match_score, coalesce(total::VARCHAR, '') AS total, coalesce((evidence_bonus > 0)::INT, 0) AS evidence
        FROM part LEFT JOIN m ON seed_id = p_partkey LEFT JOIN c2 ON c2.k = work_id WHERE p_partkey % 20 = 0""",
    "papers_citing_export": """SELECT source AS seed_id, length(lang)::INT AS seed_year, lang || ' ' || source AS citing_title, 'u' AS citing_url, n_chars AS citing_year,
        CASE WHEN n_chars > 1000 THEN 'https://doi.org/' || doc_id WHEN n_chars > 100 THEN 'http://d/' || doc_id ELSE '' END AS citing_doi, doc_id AS citing_id, source AS venue_name,
        n_chars > 500 AS is_oa, lang AS oa_status FROM documents WHERE lang <> 'de'""",
    "papers_classification_summary": "SELECT source, count(*) AS num_citing, count(*) FILTER (contains(lower(text), 'license')) AS num_possibly, count(*) FILTER (NOT contains(lower(coalesce(text, '')), 'license')) AS num_unlikely FROM documents GROUP BY source",
    "papers_overview": """WITH f AS (SELECT source, contains(lower(coalesce(text, '')), 'license') AS l FROM documents)
        SELECT 'n_classified_files' AS metric, count(DISTINCT source) AS value FROM f UNION ALL SELECT 'n_total_citing_rows', count(*) FROM f
        UNION ALL SELECT 'count_possibly', count(*) FILTER (l) FROM f UNION ALL SELECT 'count_unlikely', count(*) FILTER (NOT l) FROM f""",
    "papers_matched_names": "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{w}' AS name, count(*) AS n FROM documents WHERE contains(lower(text), '{w}')" for w in ("license", "rights reserved", "apache", "benchmark")) + ") WHERE n > 0 ORDER BY n DESC, name LIMIT 3",
    "papers_availability": "SELECT year(o_orderdate)::INT AS year, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1",
    "papers_in_years": "SELECT o_orderpriority AS value, count(*) AS n FROM orders WHERE year(o_orderdate) BETWEEN 1994 AND 1996 GROUP BY 1",
    "papers_value_counts": "SELECT coalesce(lang, '') AS value, count(*) AS n FROM documents GROUP BY 1",
    "papers_statistics": """SELECT 'available' AS metric, year(o_orderdate)::VARCHAR AS key, count(*)::DOUBLE AS value FROM orders WHERE o_orderstatus = 'F' GROUP BY 2
        UNION ALL SELECT 'types', o_orderpriority, count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'mean_citations', o_orderpriority, round(avg(o_totalprice)::DOUBLE, 6) FROM orders GROUP BY 2""",
    "papers_name_hits": "WITH n AS (SELECT * FROM (VALUES ('apache license', 'apache[\\s\\-_]*license'), ('mit_license', 'mit[\\s\\-_]*license'), ('general-public', 'general[\\s\\-_]*public'), ('all rights', 'all[\\s\\-_]*rights')) v(name, p)) "
    + "SELECT name, count(*) AS docs, sum(doc_id)::BIGINT AS ids FROM n JOIN documents ON regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_])' || p || '($|[^\\p{L}\\p{N}_])') GROUP BY name",
    "hits_url_functions": """WITH s AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*', ''), '[?#].*$', '') AS path FROM pages),
        b AS (SELECT page_id, url, regexp_replace(regexp_extract(rtrim(CASE WHEN path = '' THEN url ELSE path END, '/'), '([^/]*)$', 1), '^(.+)\\.[^.]*$', '\\1') AS name,
          lower(regexp_extract(url, '\\.([A-Za-z0-9]{2,6})(?:$|[?#])', 1)) AS x, rtrim(lower(trim(url)), '/') AS t FROM s),
        c AS (SELECT *, trim(regexp_replace(regexp_replace(translate(trim(name), '/\\', '__'), '[^A-Za-z0-9._+\\-]', '_', 'g'), '_+', '_', 'g'), '_.') AS st,
          trim(regexp_replace(regexp_replace(translate(trim(url), '/\\', '__'), '[^A-Za-z0-9._+\\-]', '_', 'g'), '_+', '_', 'g'), '_.') AS la FROM b)
        SELECT page_id, CASE WHEN st = '' THEN 'unknown' ELSE st END AS stem, CASE WHEN x IN ('owl', 'ttl', 'rdf', 'xml', 'nt', 'trig') THEN '.' || x ELSE '.owl' END AS ext,
          CASE WHEN la = '' THEN 'unknown' ELSE la END AS label, ends_with(t, '/template') OR contains(t, '/template/') OR regexp_matches(t, '^https?://(www\\.)?example\\.com$') AS generic,
          'https://raw.host/o/r/main/' || page_id AS raw FROM c""",
}
