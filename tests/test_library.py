"""Sources, sinks, streams and functions against hand-reckoned results."""

import difflib
import json
import random

from pyspark.sql import functions as F

from reweave.functions import labels as fl
from reweave.operators import constructs, discovery, papers, reports, simjoin, triples, usage
from reweave.sources import files, landed, sinks
from reweave.streaming import landed as stream
from reweave.vocab import IRIS, SHORT


def one(spark, *columns, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'bigint'}" for k, v in values.items())
    return tuple(spark.createDataFrame([tuple(values.values())], schema).select(*columns).first())


def test_labels(spark):
    c = F.col("x")
    assert one(spark, fl.normalize_label(c), x=" hasPart_of-Thing(1) ") == ("has part of thing 1",)
    assert one(spark, fl.normalize_label_unicode(c), x="hatÄpfel_und-Öl!") == ("hatäpfel und öl",)
    assert one(spark, fl.normalize_label(c), fl.local_name(c), x=None)[0] == ""
    assert one(spark, fl.local_name(c), fl.base_namespace(c), x="http://a/b#c") == ("c", "http://a/b#")
    assert one(spark, fl.local_name(c), fl.base_namespace(c), x="http://a/b/") == ("b", "http://a/b/")
    assert one(spark, fl.ngrams(c), x="abcd") == (["abc", "bcd"],) and one(spark, fl.ngrams(c), x="ab") == (["ab"],)
    assert one(spark, fl.bounded_levenshtein(c, F.lit("abcdef"), 2), x="x") == (3,)
    assert one(spark, fl.percent(F.lit(1), F.lit(0)), fl.ratio(F.lit(1), F.lit(0)), x="") == (None, 0.0)


NT = """# a comment
<http://p#A> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://www.w3.org/2002/07/owl#Class> .
<http://p#A> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://www.w3.org/2002/07/owl#Class> .
<http://p#A> <http://www.w3.org/2000/01/rdf-schema#label> "An \\"A\\""@en .
_:b <http://www.w3.org/2002/07/owl#oneOf> _:l .
_:l <http://www.w3.org/1999/02/22-rdf-syntax-ns#first> "x"^^<http://t> .
not a triple
"""


def test_read_triples(spark, tmp_path):
    (tmp_path / "g.nt").write_text(NT)
    rows, corrupt = files.read_triples(spark, str(tmp_path))
    assert rows.count() == 4 and [r.line for r in corrupt.collect()] == ["not a triple"]
    literal = rows.filter("o_lang = 'en'").first()
    assert (literal.o, literal.o_kind, literal.s_kind) == ('An "A"', "literal", "iri")
    assert [(r.kind, r.iri) for r in triples.entities(rows, IRIS).collect()] == [("class", "http://p#A")]
    flags = constructs.constructs(rows, IRIS).first()
    assert flags.D and not flags.NOMINALS and flags.expressivity == "EL" and flags.n_axioms == 4 and flags.dl_complexity_score == 1


def graph(spark, **graphs):
    rows = [(g, s, "bnode" if s.startswith("_:") else "iri", p, o, "literal" if o.startswith('"') else "bnode" if o.startswith("_:") else "iri") for g, ts in graphs.items() for s, p, o in ts]
    return spark.createDataFrame(rows, "graph_id string, s string, s_kind string, p string, o string, o_kind string")


def test_usage_of_slash_namespaces_imports_and_isolation(spark):
    pattern = [("http://p/A", "rdf:type", "owl:Class"), ("http://p/B", "rdf:type", "owl:Class"), ("http://p/r", "rdf:type", "owl:ObjectProperty"), ("http://p/A", "http://p/r", "http://p/B")]
    t = graph(
        spark, pat=pattern,
        used=[("http://o#X", "rdfs:subClassOf", "http://p/A"), ("http://p/A", "http://p/r", "http://p/B"), ("http://p/B", "owl:equivalentClass", "http://o#Y"), ("_:r", "owl:onProperty", "http://p/r")],
        only=[("http://o2#O", "owl:imports", "http://p/A")], other=[("http://z#Z", "rdf:type", "owl:Class")],
    )
    pairs = spark.createDataFrame([(o, "pat") for o in ("used", "only", "other")], "ontology_id string, pattern_id string")
    got = {r.ontology_id: r for r in usage.usage(pairs, t, SHORT).collect()}
    u = got["used"]
    assert (u.direct, u.as_subclass, u.via_restriction, u.equivalent, u.as_superclass, u.isolated) == (3, 1, 1, 1, 0, False)
    assert got["other"].isolated and not got["other"].import_only and got["other"].direct == 0 and got["other"].connectivity_ratio == 0
    # the imported IRI is itself an entity, so it counts as reused, and direct use needs its internal triple
    assert got["only"].direct == 0 and got["only"].import_only


def test_main_file(spark):
    rows = [("r1", "ontology", ".owl", 9, "a.owl"), ("r1", "ontology", ".nt", 1, "b.nt"), ("r2", "ontology", ".ttl", 1, "x"), ("r2", "ontology", ".ttl", 5, "y"), ("r2", "pattern", ".nt", 5, "z")]
    df = spark.createDataFrame(rows, "repo string, role string, ext string, size long, path string")
    assert {r.path for r in files.main_file(df).collect()} == {"b.nt", "y"}
    assert {r.path for r in files.main_file(df, prefer_owl=True).collect()} == {"a.owl", "y"}


def test_inventory_and_papers(spark, tmp_path):
    (tmp_path / "lib/repo1/patterns").mkdir(parents=True)
    (tmp_path / "lib/repo1/o.ttl").write_text("@prefix : <x> .")
    (tmp_path / "lib/repo1/patterns/p.ttl").write_text("@base <y> .")
    (tmp_path / "lib/repo1/catalog.ttl").write_text("no")
    found = files.list_files(spark, str(tmp_path / "lib"), [".ttl"], skip=("catalog",))
    assert {(r.repo, r.role, r.name) for r in found.collect()} == {("repo1", "ontology", "o.ttl"), ("repo1", "pattern", "p.ttl")}
    (tmp_path / "papers/2014").mkdir(parents=True)
    (tmp_path / "papers/2014/a.csv").write_text('Year,TITLE\n2014,"A ""b""\nc"\n')
    r = files.read_papers(spark, str(tmp_path / "papers"), {"year": "year", "title": "title", "venue": "venue"}).first()
    assert (r.year, r.title, r.venue, r.seed_year) == ("2014", 'A "b"\nc', None, 2014)
    assert one(spark, files.flag(F.col("x")), x=" true ") == (True,) and one(spark, files.flag(F.col("x")), x="maybe") == (None,)


def test_landed(spark, tmp_path):
    page = {"items": [{"path": "a.owl", "html_url": "u", "repository": {"full_name": "o/r"}}, {"html_url": None}]}
    pages = spark.createDataFrame([("L", "I", json.dumps(page))], "pattern_label string, pattern_iri string, json string")
    assert [(r.source, r.match_label, r.url, r.details) for r in landed.code_hits(pages).collect()] == [("github", "o/r", "u", "a.owl"), ("github", "", "", "")]
    work = {"id": "1", "doi": "10.1/x", "authorships": [{"author": {"display_name": "A"}}, {"author": {}}], "abstract_inverted_index": {"b": [1], "a": [0, 3]}}
    w = landed.works(spark.createDataFrame([(json.dumps(work),)], "json string"))
    r = w.withColumn("abstract", papers.abstract_text(F.col("abstract_inverted_index"))).first()
    assert (r.url, r.authors, r.abstract) == ("https://doi.org/10.1/x", ["A"], "a b  a")
    rec = {"DOI": "10.1/X", "title": ["T", "U"], "issued": {"date-parts": [[2001, 2]]}, "author": [{"given": "G", "family": "F"}]}
    r = landed.records(spark.createDataFrame([(json.dumps(rec),), ("{}",)], "json string")).orderBy(F.desc("doi")).first()
    assert (r.doi, r.title, r.year, r.authors) == ("10.1/x", "T U", 2001, ["G F"])
    (tmp_path / "in").mkdir()
    rows = [{"seed": "s", "id": i} for i in (1, 2, 1)]
    (tmp_path / "in/1.json").write_text("\n".join(map(json.dumps, rows)))
    for n in (2, 3):
        stream.export(stream.new_citations(spark, str(tmp_path / "in"), "seed string, id long"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == n
        (tmp_path / f"in/{n}.json").write_text(json.dumps({"seed": "s", "id": 7}) + "\n" + json.dumps({"seed": "s", "id": 2}))
    seeds = spark.createDataFrame([("s",), ("t",)], "seed string")
    assert [r.seed for r in stream.pending(seeds, spark.read.parquet(str(tmp_path / "out"))).collect()] == ["t"]


def test_discovery(spark):
    text = 'xml:base = "http://a#"\nxmlns="http://d#"\n@base <http://b> .\n@prefix : <http://c#> .\n: a owl:Ontology .'
    df = spark.createDataFrame([("f", "d", text), ("g", "d", "none"), ("h", "e", "")], "file string, dir string, text string")
    found = discovery.extract_iris(df)
    assert {(r.iri, r.method.split(" ")[0]) for r in found.collect()} == {("http://a#", "xml:base"), ("http://d", "xmlns"), ("http://b", "Turtle"), ("http://c#", "Turtle")}
    assert {(r.dir, r.total_files, r.files_with_iri, r.files_without_iri, r.unique_iris) for r in discovery.directory_summary(df, found).collect()} == {("d", 2, 1, 1, 4), ("e", 1, 0, 1, 0)}
    c = F.col("x")
    assert one(spark, discovery.sanitize(c), x=" a//b?c_ ") == ("a_b_c",) and one(spark, discovery.sanitize(c), x="//") == ("unknown",)
    assert one(spark, discovery.stem(c), discovery.raw_url(c, "raw"), x="https://github.com/o/r/blob/m/d/My%20f.v1.owl?x=1")[1].startswith("https://raw/o/r/m/d/")
    assert one(spark, discovery.stem(c), x="https://h/d/f.v1.owl?x") == ("f.v1",) and one(spark, discovery.extension(c, F.lit("b.ttl#z")), x="a.zip") == (".ttl",)
    assert one(spark, discovery.is_generic(c, "s.org"), discovery.is_generic_at_end(c, "s.org"), x="http://s.org/a/template/b") == (True, True)
    hits = spark.createDataFrame([("a", "i", "u", 2, "late"), ("a", "i", "u", 1, "early"), ("b", "i", "u", 3, "x")], "source string, pattern_iri string, url string, seq long, details string")
    assert {r.details for r in discovery.distinct_hits(hits, "seq").collect()} == {"early", "x"}
    library = spark.createDataFrame([("long/file", "see <http://a/b#c>"), ("f", "at http://a/b#c now"), ("g", "http://a/b")], "file string, text string")
    pats = spark.createDataFrame([("http://a/b#c",), ("http://a/b",)], "pattern_iri string")
    assert {(r.pattern_iri, r.file, r.n_files) for r in discovery.containing_files(pats, library).collect()} == {("http://a/b#c", "f", 2), ("http://a/b", "f", 3)}
    rows = spark.createDataFrame([("GitHub", "P", "http://a/b#c", "o/r", "https://github.com/o/r/blob/m/x.owl", ""), ("github", "x", "i", "m", "https://h/x.owl", ""), ("web", "P", "i", "m", "u", "")], discovery.HITS)
    plan = discovery.dataset_plan(rows, discovery.containing_files(pats, library), "raw").collect()
    assert [(r.folder, r.target, r.pattern_file, r.status) for r in plan] == [("x_o_r", "x.owl", "f", "planned")]


def test_papers(spark):
    c = F.col("x")
    assert one(spark, papers.clean_title(c), x=" A  study: https://a.b/c - CEUR workshop ") == ("A study",)
    assert one(spark, papers.normal_doi(c), papers.file_name(c), x=" https://doi.org/10.1/AB ")[0] == "10.1/ab"
    assert one(spark, papers.reuse_gate(c), x="We REUSED an ontology and its patterns") == (True,) and one(spark, papers.reuse_gate(c), x="ontology patterns") == (False,)
    works = spark.createDataFrame(
        [(1, "D", None, "t", None, [], False), (2, "D", None, None, 2001, ["a"], True), (3, None, "i", "x", 1, ["b"], None), (4, None, None, "Only Title", None, None, None)],
        "seq long, doi string, id string, title string, year int, authors array<string>, is_oa boolean",
    )
    got = {r.key: r for r in papers.merged_works(works, "seq", ["title", "year", "authors", "is_oa"]).collect()}
    assert (got["D"].title, got["D"].year, got["D"].authors, got["D"].is_oa) == ("t", 2001, ["a"], True) and set(got) == {"D", "i", "only title"}
    texts = spark.createDataFrame([(1, "Reuse of ontology patterns", "an odp: Part-Of", None), (2, "Software design patterns", "we use a pattern", ""), (3, None, None, None)], "id long, title string, abstract string, url string")
    names = spark.createDataFrame([("part_of",), ("Role",), ("?",)], "name string")
    found = papers.named(texts.select("id", F.concat_ws(" ", "title", "abstract").alias("text")), names, "id")
    assert [(r.id, r.name) for r in found.collect()] == [(1, "part_of")]
    got = {r.id: r for r in papers.classified(texts, found, "id", "site.org").collect()}
    assert (got[1].label, got[1].matched_names, got[1].hit_keyphrase) == ("Possibly", "part_of", 1)
    assert (got[2].label, got[2].hit_other_field) == ("Unlikely", 1) and got[3].label == "Unlikely"
    seeds = spark.createDataFrame([(1, "a b c d", 2000, ""), (2, "q", 2000, "")], "seed_id long, title string, year int, hint string")
    cands = spark.createDataFrame([(10, "a b c d", 2001, "X"), (11, "A b c d", 2005, "X"), (12, "z", 2000, "X")], "work_id long, title string, year int, venue string")
    scored = papers.linkage_candidates(seeds, cands, "ws")
    assert {(r.seed_id, r.work_id): round(r.score, 6) for r in scored.collect()} == {(1, 10): 1.1, (1, 11): 0.9}
    assert [(r.seed_id, r.work_id) for r in papers.best_matches(scored, 0.82, 1).collect()] == [(1, 10)]
    assert papers.best_matches(scored, 0.82, 1, need_evidence=True).count() == 0


def test_reports(spark):
    v = spark.createDataFrame([(x,) for x in (-1, 0, 3, 3, 12)], "v long")
    assert {r.bin: r["count"] for r in reports.histogram(v, "v", [0, 2, 5]).collect()} == {"0-1": 1, "2-4": 2, "5+": 2}
    assert one(spark, reports.threshold_token(F.lit(0.85)), reports.threshold_token(F.lit(7.0)), x="") == ("08", "10")
    assert {r.bucket: r["count"] for r in reports.equal_width(v, "v", 2).collect()} == {1: 4, 2: 1}


def words(rng, n):
    return ["".join(rng.choices("ab c", k=rng.randint(0, 9))).strip() for _ in range(n)]


def test_similarity_joins_equal_brute_force(spark):
    rng = random.Random(7)
    a, b = sorted(set(words(rng, 60))), sorted(set(words(rng, 60)))
    left, right = (spark.createDataFrame([(x,) for x in s], "label string") for s in (a, b))

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, cx in enumerate(x, 1):
            row, last = [i], row
            for j, cy in enumerate(y, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (cx != cy)))
        return row[-1]

    ratio = lambda x, y: difflib.SequenceMatcher(a=x, b=y).ratio() if x and y else 0.0
    pairs = lambda df: {(r.left_label, r.right_label) for r in df.collect()}
    for most in (0, 1, 2):
        assert pairs(simjoin.edit_join(left, right, most)) == {(x, y) for x in a for y in b if distance(x, y) <= most}
    assert pairs(simjoin.ratio_join(left, right, 0.75)) == {(x, y) for x in a for y in b if ratio(x, y) >= 0.75}

    def jac(x, y):
        s, t = set(x.split()), set(y.split())
        return len(s & t) / len(s | t) if s and t else 0.0

    def best(x, y):
        return max(jac(x, y), ratio(x, y), 1 - distance(x, y) / max(len(x), len(y), 1))

    got = pairs(simjoin.label_join(left.filter("label <> ''"), right.filter("label <> ''"), 0.7))
    assert got == {(x, y) for x in a for y in b if x and y and best(x, y) >= 0.7}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("exact", 0.8, 0, 1), ("char", 0.9, 2, 2)], "backend string, threshold double, edits int, n int")
    sinks.write_runs(df, str(tmp_path / "runs"))
    sinks.write_runs(df.filter("n = 2"), str(tmp_path / "runs"))
    assert spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", False).parquet(str(tmp_path / "runs")).count() == 2
    both = sinks.union_all([df.select("n"), df.select("backend")], ["backend"])
    assert both.columns == ["backend", "n"] and both.count() == 4
