"""Operators of the second round against hand-reckoned results."""

import json
import random

import pytest
from pyspark.sql import functions as F

from reweave import storage
from reweave.operators import constructs, discovery, papers, reports, simjoin, triples
from reweave.sources import files, landed, sinks
from reweave.vocab import IRIS


def test_ntriples_escapes_are_decoded_once(spark, tmp_path):
    text = r'''<http://a> <http://p> "été \\n \n \t \"q\" \U0001F600" .
<http://café> <http://p> "x\\ty"@en .
'''
    (tmp_path / "g.nt").write_text(text)
    rows, bad = files.read_triples(spark, str(tmp_path))
    got = {(r.s, r.o) for r in rows.collect()}
    assert got == {("http://a", 'été \\n \n \t "q" \U0001F600'), ("http://café", "x\\ty")} and bad.count() == 0


def test_files_below_a_base_that_repeats(spark, tmp_path):
    base = tmp_path / "data" / "x+y" / "data"
    for name in ("repo1/a.owl", "repo2/patterns/p.ttl", "top.owl", "repo1/skip.owl"):
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_text("text of " + name)
    for given in (str(base), f"file://{base}/"):
        rows = files.list_files(spark, given, [".owl", ".ttl"], skip=("skip",)).collect()
        assert {(r.name, r.repo, r.role) for r in rows} == {("a.owl", "repo1", "ontology"), ("p.ttl", "repo2", "pattern"), ("top.owl", "", "ontology")}
    assert {r.text for r in files.read_texts(spark, str(base), [".ttl"]).collect()} == {"text of repo2/patterns/p.ttl"}
    kinds = spark.createDataFrame([(".ttl", "@prefix : <x> ."), (".owl", "plain"), (".nt", "<http://a>")], "ext string, content string")
    got = kinds.select(files.looks_like_rdf(F.col("content").cast("binary"), F.col("ext")).alias("ok")).collect()
    assert [r.ok for r in got] == [True, False, True]
    assert [r.name for r in files.folder_names(files.list_files(spark, str(base), [".owl", ".ttl"])).collect()] == ["data", "patterns", "repo1"]


def test_small_functions(spark):
    def of(column, value):
        return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]

    assert of(files.fallback_iri, "x\nOntology: <http://o/1>\nhttp://no") == "http://o/1"
    assert of(files.fallback_iri, "see urn:isbn:1 and") == "urn:isbn:1" and of(files.fallback_iri, "Ontology: <file> http://a\"b") == "http://a" and of(files.fallback_iri, "none") is None
    assert of(files.number, " 1.5 ") == 1.5 and of(files.number, "x") is None
    assert [of(files.loose_flag, v) for v in ("1", "True", "true", "TRUE", None)] == [True, True, True, False, False]
    assert files.normal_columns(spark.createDataFrame([(1, 2)], "` Ontolgoy available?` int, `ODP reused` int")).columns == ["ontology_available?", "odp_reused?"]
    for value, want in [(None, ""), ([], ""), (["", "b"], "b"), ({"x": 1, "id": "i", "uri": "u"}, "u"), ([{"@id": ["", "deep"]}], "deep"), (3, "3"), ({"x": 1}, '{"x":1}')]:
        said = json.dumps(value, separators=(",", ":")) if isinstance(value, (list, dict)) else value if value is None else str(value)
        assert of(landed.as_text, said) == want, value
    assert of(lambda c: papers.contains_folded(c, F.lit("cafe")), "Un CAFÉ noir") and not of(lambda c: papers.contains_folded(c, F.lit("thé")), "Un CAFÉ noir")
    assert of(papers.download_name, "a/b c?.pdf") == "a_b_c_.pdf" and of(papers.download_name, "??") == "file" and of(discovery.slug, "x/my own.file.csv") == "my_own.file"
    assert [of(lambda c: reports.figure_bins(c.cast("int")), v) for v in ("4", "100", "900")] == [5, 10, 20]
    assert of(lambda c: discovery.is_generic_at_end(c, "example.com"), "http://a/template/x") and not of(lambda c: discovery.is_generic_at_end(c, "example.com"), "http://a/templates")
    assert of(discovery.first_iri, '@base <http://b> . <x xml:base="http://a">') == "http://a"


def test_catalog_and_preprints(spark):
    page = {"results": [{"prefixedName": ["a:b"], "uri": ["http://t"], "vocabulary": {"prefix": "voc"}}, {"label": "L", "vocabulary": {"uriSpace": "http://v#"}}]}
    vocab = {"results": [{"prefix": "p", "uri": "http://v", "description": ["", "d"]}]}
    pages = lambda o: spark.createDataFrame([("lab", "iri", json.dumps(o))], "pattern_label string, pattern_iri string, json string")
    hits = landed.catalog_hits(pages(page), pages(vocab))
    assert {(r.source, r.match_label, r.url) for r in hits.collect()} == {("lov-terms", "voc", "http://t"), ("lov-terms", "L", "http://v#"), ("lov-vocab", "p", "http://v")}
    assert {r.details for r in hits.filter("source = 'lov-vocab'").collect()} == {"d"} and json.loads(hits.filter("match_label = 'voc'").first().details) == {"vocab": {"prefix": "voc"}}
    assert landed.from_sources(hits, ["lov-vocab"]).count() == 1 and landed.from_sources(hits, []).count() == 3
    entry = {"id": "http://x/1", "title": " A\n title ", "summary": "s", "authors": [{"name": "N  M"}, {"name": ""}], "published": "2020-01-01",
             "links": [{"rel": "alternate", "href": "http://l"}, {"type": "application/pdf", "href": "http://p"}], "arxiv_primary_category": {"term": "cs"}}
    got = landed.preprints(spark.createDataFrame([(json.dumps(entry),), (json.dumps({"title": "t", "published": "soon"}),)], "json string")).collect()
    assert (got[0].title, got[0].authors, got[0].year, got[0].url, got[0].pdf_url, got[0].category) == ("A title", ["N M"], 2020, "http://l", "http://p", "cs")
    assert (got[1].id, got[1].year, got[1].url, got[1].pdf_url) == ("t", None, None, None)


def test_vector_join_equals_brute_force(spark):
    import numpy as np

    rng = np.random.RandomState(1)
    data = [(i, [float(x) for x in rng.randn(6)]) for i in range(300)] + [(300, None), (301, [0.0] * 6)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in data[:300]}
    want = {(a, b) for a in range(0, 300, 3) for b in range(300) if unit[a] @ unit[b] >= 0.7}
    got = simjoin.vector_join(df.filter("vec_id % 3 = 0"), df, 0.7, block=30, chunk=70).collect()
    assert {(r.query_id, r.vec_id) for r in got} == want and len(got) == len(want)
    assert simjoin.vector_join(df.limit(0), df, 0.7).count() == 0


def test_cosine_and_label_joins_equal_brute_force(spark):
    from collections import Counter
    from difflib import SequenceMatcher

    rng = random.Random(4)
    words = ["red", "reds", "blue", "bluish", "green", "the", "thing"]
    labels = sorted({" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(60)})
    df = spark.createDataFrame([(x,) for x in labels], "label string")

    def cosine(a, b, cut):
        x, y = Counter(cut(a)), Counter(cut(b))
        return sum(n * y[g] for g, n in x.items()) / (sum(n * n for n in x.values()) * sum(n * n for n in y.values())) ** 0.5

    grams = lambda t: [t[i : i + 3] for i in range(len(t) - 2)] if len(t) >= 3 else [t]
    for threshold in (0.3, 0.7):
        for join, cut in ((simjoin.char_join, grams), (simjoin.word_join, str.split)):
            got = {(r.left_label, r.right_label) for r in join(df, df, threshold).collect()}
            assert got == {(a, b) for a in labels for b in labels if cosine(a, b, cut) >= threshold - 1e-9}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    def best(a, b):
        x, y = set(a.split()), set(b.split())
        e = edits(a, b)
        return 1.0 if e <= 1 else max(len(x & y) / len(x | y), SequenceMatcher(None, a, b).ratio(), 1 - e / max(len(a), len(b)))

    few = labels[:25]
    left = spark.createDataFrame([(x,) for x in few], "label string")
    got = {(r.left_label, r.right_label): r.similarity for r in simjoin.label_join(left, left, 0.7, 1).collect()}
    want = {(a, b): best(a, b) for a in few for b in few if best(a, b) >= 0.7}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_similar_labels(spark):
    left = spark.createDataFrame([("red car",), ("blue",)], "label string")
    right = spark.createDataFrame([("red cars",), ("blue",), ("azure",)], "label string")
    vectors = spark.createDataFrame([("red car", [1.0, 0.0]), ("red cars", [1.0, 0.1]), ("blue", [0.0, 1.0]), ("azure", [0.1, 1.0])], "label string, embedding array<double>")
    of = lambda name, **options: {(r.left_label, r.right_label) for r in triples.similar_labels(left, right, name, 0.8, **options).collect()}
    assert of("exact") == {("blue", "blue")} and of("char") == of("auto") == of("hybrid") == {("blue", "blue"), ("red car", "red cars")}
    everything = {("blue", "blue"), ("blue", "azure"), ("red car", "red cars")}
    assert of("vector", vectors=vectors) == of("auto", vectors=vectors) == everything
    assert of("hybrid", vectors=vectors, prefilter=0.5) == {("blue", "blue"), ("red car", "red cars")}
    with pytest.raises(ValueError):
        of("vector")
    with pytest.raises(ValueError):
        of("other")
    found = {r.left_label: r.by for r in simjoin.gated_join(left, right, 0.95, 0.8, spark.createDataFrame([("red car", 0.99)], "left_label string, similarity double")).collect()}
    assert found == {"blue": "char", "red car": "vector"}


def test_linkage_needs_a_threshold_that_its_candidates_cover():
    with pytest.raises(ValueError):
        papers.best_matches(None, 0.7, 1)


def test_literals_set_no_construct(spark):
    v = IRIS.one
    rows = [("g", "a", "iri", v("rdf:type"), v("owl:ReflexiveProperty"), "literal"), ("g", "b", "bnode", v("owl:someValuesFrom"), v("owl:Thing"), "literal")]
    got = constructs.constructs(spark.createDataFrame(rows, "graph_id string, s string, s_kind string, p string, o string, o_kind string")).first()
    assert not got.ROLE_REFLEXIVITY_CHAINS and not got.LIMITED_EXISTENTIAL and got.FULL_EXISTENTIAL


def test_names_group_pattern_files(spark):
    names = constructs.CONSTRUCTS
    row = lambda name, gid, score, expr, used: (name, gid, score, expr, *[c in used for c in names])
    schema = "name string, graph_id string, dl_complexity_score int, expressivity string, " + ", ".join(f"{c} boolean" for c in names)
    df = spark.createDataFrame([row("n", "a", 1, "EL", {"D"}), row("n", "b", 2, "ALC", {"F"}), row("n", "c", 2, "SHOIN", set()), row("m", "d", 0, "EL", set())], schema)
    both = {r.name: r for r in reports.by_name(df, "name").collect()}
    assert both["n"].D and both["n"].F and not both["m"].D
    assert {r.name: r.expressivity for r in reports.richest(df, "name", "graph_id").collect()} == {"n": "SHOIN", "m": "EL"}
    wide = reports.wide(spark.createDataFrame([(c, i) for i, c in enumerate(names)], "construct string, n int"), "construct", ["n"]).first()
    assert len(wide) == len(names)


def test_shares_over_many_partitions(spark):
    rng = random.Random(9)
    values = [rng.randrange(40) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v int").repartition(7)
    got = {r.v: (r.n, round(r.share, 9)) for r in reports.cumulative_share(df, "v").collect()}
    assert got == {v: (values.count(v), round(sum(x <= v for x in values) / 500, 9)) for v in values}
    each = sorted((r.v, round(r.share, 9)) for r in reports.empirical_cdf(df, "v").collect())
    assert each == [(v, round((i + 1) / 500, 9)) for i, v in enumerate(sorted(values))]


def test_sinks(spark, tmp_path):
    stats = papers.statistics({"a": spark.createDataFrame([(2000, 3)], "year int, n int"), "b": spark.createDataFrame([("x", 0.5)], "k string, v double")})
    sinks.write_statistics(stats, f"{tmp_path}/s")
    assert spark.read.json(f"{tmp_path}/s/json").count() == 2 and {r.metric for r in spark.read.option("header", True).csv(f"{tmp_path}/s/csv").collect()} == {"a", "b"}
    rows = papers.citing_rows(spark.createDataFrame(
        [(1, 2000, "  A  title", "u", 2001, "10.1/x", "id", "v", True, "gold"), (1, 2000, " ", "u", 2001, None, "id", "v", None, None)],
        "seed_id int, seed_year int, title string, url string, year int, doi string, id string, venue string, is_oa boolean, oa_status string"))
    sinks.write_citing(rows, f"{tmp_path}/c")
    got = spark.read.option("header", True).csv(f"{tmp_path}/c").collect()
    assert [(r.citing_title, r.citing_doi, r.seed_year) for r in got] == [("A title", "https://doi.org/10.1/x", 2000)]
    sinks.write_table(spark.createDataFrame([(1, 2)], "a int, b int"), f"{tmp_path}/t", ["b"], csv=True)
    assert spark.read.option("header", True).csv(f"{tmp_path}/t").columns == ["b"]
    sinks.write_datasets(spark.createDataFrame([(50, "x")], "dataset int, pattern_id string"), f"{tmp_path}/d")
    assert spark.read.parquet(f"{tmp_path}/d").count() == 1
    capped = discovery.capped(spark.createDataFrame([("a", i) for i in range(5)], "k string, n int"), ["k"], ["n"], 2)
    assert [r.n for r in capped.collect()] == [0, 1]


def test_landed_enrichment(spark):
    own = spark.createDataFrame([("d1", "t1", False, None), ("d2", "t2", None, "p")], "doi string, title string, is_oa boolean, pdf_url string")
    access = spark.createDataFrame([("d1", True, None, None, [("http://u", "http://f")])], "doi string, is_oa boolean, url string, pdf_url string, locations array<struct<url:string,url_for_pdf:string>>")
    got = {r.doi: (r.is_oa, r.oa_url, r.pdf_url) for r in landed.enriched(own, access).collect()}
    assert got == {"d1": (True, "http://u", "http://f"), "d2": (None, None, "p")}
    found = landed.looked_up(own.select("doi", "title"), spark.createDataFrame([("d1", 5)], "doi string, n int"), spark.createDataFrame([("t1", 1, 7), ("t2", 1, 8), ("t2", 2, 9)], "title string, rank int, n int"), ["n"])
    assert {r.doi: r.n for r in found.collect()} == {"d1": 5, "d2": 8}
    page = lambda o: spark.createDataFrame([("l", "i", json.dumps(o))], "pattern_label string, pattern_iri string, json string")
    assert [r.url for r in landed.web_hits(page({"items": [{"title": "t", "link": "http://w"}]})).collect()] == ["http://w"]
    assert [r.match_label for r in landed.portal_hits(page({"collection": [{"prefLabel": "", "label": "L", "@id": "x"}]}), "bp").collect()] == ["L"]


def test_method_summary(spark):
    rows = spark.createDataFrame([("f1", "d1", 'xml:base="http://a"'), ("f2", "d1", "none"), ("f3", "d2", "none")], "file string, dir string, text string")
    got = {(r.kind, r.name, r.n) for r in discovery.methods_summary(rows, discovery.extract_iris(rows)).collect()}
    assert got == {("method", "xml:base", 1), ("file without", "f2", 0), ("file without", "f3", 0), ("directory without", "d2", 1)}


def test_a_cluster_needs_a_shared_folder():
    class Fake:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})  # noqa: N815

    with pytest.raises(ValueError):
        storage.shared_folder(Fake)
