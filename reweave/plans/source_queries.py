"""Queries for inventories, files and hits of sources, and the rules that read them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reweave.operators import discovery as di
from reweave.operators import papers as pa
from reweave.operators import reports as rp
from reweave.operators import vector_index as vi
from reweave.plans import paper_queries as pq
from reweave.plans.bindings import table
from reweave.plans.paper_queries import files, scored
from reweave.plans.report_queries import rounded
from reweave.sources import files as sf
from reweave.storage import written

#: A line for each extraction rule, by p_partkey % 11; the key ends the IRI.
RULE_LINES = [
    '<x xml:base = "http://x.org/base/{k}">', '<x XMLNS:base="http://x.org/ns/{k}" >', '<x xmlns="http://x.org/default/{k}#">',
    '<owl:Ontology rdf:about="http://x.org/about/{k}">', '<Ontology a="b" ontologyIRI="http://x.org/oi/{k}">', '@base <http://x.org/tb/{k}> .',
    'BASE <http://x.org/b/{k}>', '<http://x.org/s/{k}> a owl:Ontology .', 'owl:versionIRI <http://x.org/v/{k}> .',
    '@prefix : <http://x.org/p/{k}> .\n: a owl:Ontology .', '<x xml:base="http://other.org/{k}">',
]


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings that pages hold or not: first links, as they are and with what stands before them, addresses, and names."""
    link = F.regexp_extract("html", r'href="([^"]+)"', 1)
    each = F.array(link, F.concat(F.lit('="'), link), F.col("url"), F.concat(F.lit("urn:odp:"), F.col("page_id")))
    return table(spark, sf_dir, "pages").select(F.explode(each).alias("pattern_iri"))


def dataset_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, page = F.col("page_id"), F.concat(F.lit("page"), F.col("page_id"))
    link = F.regexp_extract("html", r'href="([^"]+)"', 1)
    hits = table(spark, sf_dir, "pages").select(
        F.when(k % 3 == 0, "GitHub").when(k % 3 == 1, "github").otherwise("web").alias("source"),
        F.when(k % 5 == 0, F.upper(page)).otherwise(F.lit("other")).alias("pattern_label"), link.alias("pattern_iri"), F.concat(F.lit("o/r "), k).alias("match_label"),
        F.when(k % 7 == 0, F.lit("")).when(k % 4 == 0, F.concat(F.lit("https://h.org/"), page, F.lit(".ttl#x"))).otherwise(F.concat(F.lit("https://github.com/o/r/blob/main/d/"), page, F.lit(".rdf"))).alias("url"),
        F.lit("").alias("details"),
    )
    return di.dataset_plan(hits, di.containing_files(hits.filter("pattern_iri LIKE '/%a%'").select("pattern_iri"), files(spark, sf_dir)), "raw.host")


def main_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(*[F.lit(e) for e in (".owl", ".ttl", ".rdf", ".xml", ".nt", ".trig")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    repo = F.concat(F.col("p_brand"), F.lit("/"), F.col("p_size"))
    rows = table(spark, sf_dir, "part").select(repo.alias("repo"), ext.alias("ext"), (F.col("p_retailprice") * 100).cast("long").alias("size"), F.col("p_partkey").cast("string").alias("path"), F.lit("ontology").alias("role"))
    coded, stated = sf.main_file(rows), sf.main_file(rows, prefer_owl=True)
    return coded.select("repo", "path").join(stated.select("repo", F.col("path").alias("owl_first")), "repo")


def source_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    path = F.when(k % 3 == 0, F.concat(F.lit("/in/"), F.col("p_size") + 1990, F.lit("/x.csv"))).when(k % 3 == 1, F.concat(F.lit("20"), F.col("p_size") + 10)).otherwise(F.concat(F.lit("/in/1"), k, F.lit("99x/y")))
    doi = F.when(k % 4 == 0, "").when(k % 4 == 1, F.concat(F.lit(" https://doi.org/10.1/A"), k, F.lit(" "))).when(k % 4 == 2, F.concat(F.lit("http://doi.org/10.2/B"), k))
    title = F.concat(F.lit("  "), F.col("p_name"), F.lit(" https://x.org/"), k, F.lit("  CEUR-WS.org\tSubmission: "), F.col("p_brand"), F.lit(" ;- "))
    loose = F.element_at(F.array(*[F.lit(v) for v in ("1", "True", " true ", "TRUE", "0", "")]), (k % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.coalesce(sf.seed_year(path), F.lit(0)).alias("seed_year"), rp.threshold_token((k % 41) / F.lit(32.0) - F.lit(0.125)).alias("token"), sf.loose_flag(loose).alias("flag"),
        pa.normal_doi(doi).alias("doi"), pa.clean_title(title).alias("title"),
    )


def rule_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    line = F.element_at(F.array(*[F.lit(x) for x in RULE_LINES]), (F.col("p_partkey") % 11 + 1).cast("int"))
    text = F.concat(F.lit("first\n"), F.replace(line, F.lit("{k}"), key), F.lit("\n"), F.col("p_name"))
    return table(spark, sf_dir, "part").select(key.alias("file"), F.col("p_brand").alias("dir"), text.alias("text"))


def iri_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return di.extract_iris(rule_files(spark, sf_dir), host="X.org")


def iri_rules_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rule_files(spark, sf_dir)
    return di.methods_summary(rows, di.extract_iris(rows, host="x.org"))


#: Abstracts by p_size % 8: what each of the rules of the classes looks for, or lacks.
ABSTRACTS = [
    "We reuse an ontology and its content ontology design patterns", "This ontology is based on patterns of odps.org", "An ontology instantiated from pattern apache license",
    "Software design patterns in use", "We apply goF pattern in an ontology pattern", "Ontologies and patterns we adopt", "ontology design pattern", "extended ontology, old pattern, mit-license",
]


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([("apache license",), ("mit_license",), ("burnished copper",)], "name string")
    abstract = F.element_at(F.array(*[F.lit(a) for a in ABSTRACTS]), (F.col("p_size") % 8 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lower("p_type").alias("title"), abstract.alias("abstract"), F.when(F.col("p_partkey") % 5 == 0, "http://odps.org/x").alias("url"))
    found = pa.named(rows.select("id", F.concat_ws("\n", "title", "abstract").alias("text")), names, "id")
    return pa.classified(rows, found, "id", "odps.org")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    addresses = F.array(F.when(k % 3 == 0, F.concat(F.lit("http://CEUR-ws.org/Vol-"), k)), F.when(k % 4 == 0, "https://ceurws.org/"), F.lit("10.1/x"))
    venue = F.when(k % 5 == 0, "In CEUR, Vol 3").when(k % 5 == 1, "Workshop Proceedings of X").when(k % 5 == 2, "Ceurope")
    return table(spark, sf_dir, "part").select("p_partkey", pa.has_evidence(addresses, venue, r"ceur[-.]?ws\.org", r"\bceur\b|workshop proceedings").alias("evidence"))


def ranked_in_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds, found = scored(spark, sf_dir, most=3)
    found = written(found, "candidates")
    return rounded(pa.for_every_seed(pa.ranked_in_rounds(found, pa.phrase_candidates(found), 3), seeds).select("seed_id", "work_id", "round", "rank", "sim", "score"))


def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), (F.col("user_id") % 50).alias("pattern_iri"), (F.col("event_id") % 3).alias("url"), F.col("event_id").alias("seq"))
    return di.distinct_hits(rows, "seq")


def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As `join_vector_cosine`, by way of an index."""
    rows = table(spark, sf_dir, "embeddings")
    return rounded(vi.indexed_join(rows.filter("vec_id % 100 = 0"), rows, 0.5))


QUERIES = {
    "hits_containing_files": lambda s, d: di.containing_files(patterns(s, d), files(s, d)),
    "hits_dataset_plan": dataset_plan,
    "hits_first_seen": first_seen,
    "hits_iri_rules": iri_rules,
    "hits_iri_rules_summary": iri_rules_summary,
    "source_main_files": main_files,
    "source_values": source_values,
    "papers_capped": lambda s, d: di.capped(table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 3).drop("o_orderdate"),
    "papers_classified": classified,
    "papers_evidence": evidence,
    "papers_linkage_rounds_ranked": ranked_in_rounds,
    "join_vector_cosine_indexed": vector_search,
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_LINES = "[" + ", ".join(_quoted(x) for x in RULE_LINES) + "]"
_RULES = f"""WITH f AS (SELECT p_partkey::VARCHAR AS file, p_brand AS dir, 'first' || chr(10) || replace(({_LINES})[p_partkey % 11 + 1], '{{k}}', p_partkey::VARCHAR) || chr(10) || p_name AS text FROM part),
x0 AS ({' UNION ALL '.join(f"SELECT file, dir, unnest(regexp_extract_all(text, {_quoted(p)}, 1)) AS iri, {_quoted(m)} AS method FROM f" for m, p in di.IRI_PATTERNS.items())}
  UNION ALL SELECT file, dir, regexp_extract(text, {_quoted(di.DEFAULT_PREFIX)}, 1), 'Turtle @prefix : <> + : a owl:Ontology' FROM f WHERE regexp_matches(text, {_quoted(di.DEFAULT_IS_ONTOLOGY)}) AND regexp_matches(text, {_quoted(di.DEFAULT_PREFIX)})),
x AS (SELECT DISTINCT file, dir, CASE WHEN method = 'xmlns (default namespace)' THEN rtrim(trim(iri), '#') ELSE trim(iri) END AS iri, method FROM x0 WHERE contains(lower(iri), 'x.org'))
"""
_MAIN = """row_number() OVER (PARTITION BY repo ORDER BY {rank}, size DESC, path) AS {name}"""
_HAS = lambda text, patterns_: "(" + " OR ".join(f"regexp_matches({text}, {_quoted('(?i)' + p)})" for p in patterns_) + ")"
_CLEAN = "regexp_replace(trim(regexp_replace(raw, '\\s+', ' ', 'g')), '(?i)https?://\\S+', '', 'g')"
for _noise in pa.TITLE_NOISE:
    _CLEAN = f"regexp_replace({_CLEAN}, {_quoted('(?i)' + _noise.replace('.', chr(92) + '.'))}, '', 'g')"
ORACLE_SQL = {
    "hits_containing_files": """WITH p AS (SELECT DISTINCT unnest([regexp_extract(html, 'href="([^"]+)"', 1), '="' || regexp_extract(html, 'href="([^"]+)"', 1), url, 'urn:odp:' || page_id]) AS pattern_iri FROM pages),
        m AS (SELECT pattern_iri, page_id::VARCHAR AS file FROM p JOIN pages ON pattern_iri <> '' AND contains(html, pattern_iri))
        SELECT pattern_iri, file, count(*) OVER (PARTITION BY pattern_iri) AS n_files FROM m QUALIFY row_number() OVER (PARTITION BY pattern_iri ORDER BY length(file), file) = 1""",
    "hits_dataset_plan": """WITH h AS (SELECT page_id AS k, regexp_extract(html, 'href="([^"]+)"', 1) AS pattern_iri, CASE WHEN page_id % 5 = 0 THEN 'PAGE' || page_id ELSE 'other' END AS pattern_label, 'page' || page_id AS stem,
          CASE WHEN page_id % 7 = 0 THEN '' WHEN page_id % 4 = 0 THEN 'https://h.org/page' || page_id || '.ttl#x' ELSE 'https://github.com/o/r/blob/main/d/page' || page_id || '.rdf' END AS url FROM pages),
        c AS (SELECT pattern_iri, page_id::VARCHAR AS file FROM (SELECT DISTINCT pattern_iri FROM h WHERE pattern_iri LIKE '/%a%') JOIN pages ON contains(html, pattern_iri) QUALIFY row_number() OVER (PARTITION BY pattern_iri ORDER BY length(page_id::VARCHAR), page_id::VARCHAR) = 1)
        SELECT pattern_label, h.pattern_iri, url, stem || '_o_r_' || k AS folder, CASE WHEN k % 4 <> 0 THEN 'https://raw.host/o/r/main/d/' || stem || '.rdf' END AS raw_url, stem || CASE WHEN k % 4 = 0 THEN '.ttl' ELSE '.rdf' END AS target,
          c.file AS pattern_file, CASE WHEN k % 4 = 0 THEN 'no raw address' WHEN c.file IS NULL THEN 'no pattern file' ELSE 'planned' END AS status
        FROM h LEFT JOIN c ON c.pattern_iri = h.pattern_iri WHERE k % 3 < 2 AND k % 7 <> 0 AND lower(pattern_label) <> stem""",
    "hits_first_seen": "SELECT event_type AS source, user_id % 50 AS pattern_iri, event_id % 3 AS url, event_id AS seq FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id % 50, event_id % 3 ORDER BY event_id) = 1",
    "hits_iri_rules": _RULES + "SELECT * FROM x",
    "hits_iri_rules_summary": _RULES + """SELECT 'method' AS kind, method AS name, count(*) AS n FROM x GROUP BY method UNION ALL SELECT 'file without', file, 0 FROM f WHERE file NOT IN (SELECT file FROM x)
        UNION ALL SELECT 'directory without', dir, count(*) FROM f GROUP BY dir HAVING dir NOT IN (SELECT dir FROM x)""",
    "source_main_files": "WITH f AS (SELECT p_brand || '/' || p_size AS repo, p_partkey::VARCHAR AS path, (p_retailprice * 100)::BIGINT AS size, [0, 1, 2, 2, 3, 3][p_partkey % 6 + 1] AS rank FROM part), "
    + f"n AS (SELECT *, {_MAIN.format(rank='rank DESC', name='a')}, {_MAIN.format(rank='rank', name='b')} FROM f) SELECT x.repo, x.path, y.path AS owl_first FROM n x JOIN n y ON x.repo = y.repo AND x.a = 1 AND y.b = 1",
    "source_values": f"""WITH r AS (SELECT p_partkey AS k, p_size, '  ' || p_name || ' https://x.org/' || p_partkey || '  CEUR-WS.org' || chr(9) || 'Submission: ' || p_brand || ' ;- ' AS raw FROM part)
        SELECT k AS p_partkey, CASE WHEN k % 3 = 0 THEN p_size + 1990 WHEN k % 3 = 1 AND p_size + 10 < 100 THEN 2010 + p_size ELSE 0 END::INT AS seed_year,
          lpad(greatest(0, least(10, round_even(((k % 41) / 32.0 - 0.125) * 10, 0)::INT))::VARCHAR, 2, '0') AS token, k % 6 < 3 AS flag,
          CASE k % 4 WHEN 1 THEN '10.1/a' || k WHEN 2 THEN '10.2/b' || k END AS doi, trim(regexp_replace({_CLEAN}, '\\s+', ' ', 'g'), ' :;-') AS title FROM r""",
    "papers_capped": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) <= 3",
    "papers_classified": f"""WITH r AS (SELECT p_partkey AS id, lower(p_type) || chr(10) || ([{', '.join(_quoted(a) for a in ABSTRACTS)}])[p_size % 8 + 1] AS g, CASE WHEN p_partkey % 5 = 0 THEN 'http://odps.org/x' ELSE '' END AS url FROM part),
        t AS (SELECT *, g || chr(10) || url AS txt, array_to_string(list_filter([CASE WHEN regexp_matches(g, '(?i)\\bapache[\\s\\-_]*license\\b') THEN 'apache license' END, CASE WHEN regexp_matches(g, '(?i)\\bburnished[\\s\\-_]*copper\\b') THEN 'burnished copper' END,
          CASE WHEN regexp_matches(g, '(?i)\\bmit[\\s\\-_]*license\\b') THEN 'mit_license' END], lambda x: x IS NOT NULL), ';') AS matched_names FROM r),
        z AS (SELECT *, {_HAS('txt', pa.KEY_PHRASES)} AS kp, contains(lower(txt), 'odps.org') AS u, matched_names <> '' AS nm, {_HAS('txt', pa.OTHER_FIELD)} AND NOT contains(lower(txt), 'ontology') AS o,
          {_HAS('g', [chr(92) + 'b' + x + chr(92) + 'b' for x in pa.REUSE_TERMS])} AND regexp_matches(g, '(?i)\\bontology\\b') AND regexp_matches(g, '(?i)\\bpatterns?\\b') AS gate FROM t)
        SELECT id, CASE WHEN gate AND (kp OR u OR nm) AND NOT o THEN 'Possibly' ELSE 'Unlikely' END AS label, kp::INT AS hit_keyphrase, u::INT AS hit_url, nm::INT AS hit_named, o::INT AS hit_other_field, matched_names FROM z""",
    "papers_evidence": "SELECT p_partkey, p_partkey % 3 = 0 OR p_partkey % 4 = 0 OR p_partkey % 5 < 2 AS evidence FROM part",
    "papers_linkage_rounds_ranked": pq._S + """, g AS (SELECT z.*, contains(lower(q.title), lower(p.title)) AS phrase FROM z JOIN p ON p.k = seed_id JOIN p q ON q.k = work_id),
        r AS (SELECT *, 1 AS round FROM g UNION ALL SELECT *, 2 FROM g WHERE phrase)
        SELECT seed_id, work_id, round, row_number() OVER (PARTITION BY round, seed_id ORDER BY r.score DESC, work_id)::INT AS rank, round(sim, 6) AS sim, round(score, 6) AS score FROM r
        QUALIFY row_number() OVER (PARTITION BY round, seed_id ORDER BY r.score DESC, work_id) <= 3""",
}
