"""Joins with candidate filters, the vector index, order statistics, linkage, folding and streams against plain reckonings."""

import difflib
import json
import os
import pathlib
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from reweave.functions import labels as fl
from reweave.operators import containment, discovery, order, papers, simjoin, triples, vector_index
from reweave.sources import files, landed, sinks
from reweave.streaming import landed as stream

DATA = "/root/testdata/sf0.1"


def strings(spark, rows, name="label"):
    return spark.createDataFrame([(r,) for r in rows], f"{name} string")


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def word_jaccard(a, b):
    x, y = set(a.split()), set(b.split())
    return len(x & y) / len(x | y) if x and y else 0.0


def ratio(a, b):
    return difflib.SequenceMatcher(a=a, b=b).ratio() if a and b else 0.0


def test_contained_equals_in(spark):
    rng = random.Random(3)
    patterns = ["urn:odp:x", "http://p.org/a", "http://p.org/a#b", "p.org", "a", "é", "", None, "no such", " ", "line\nbreak"]
    patterns += ["".join(rng.choices("ab/:é", k=rng.randint(1, 5))) for _ in range(40)]
    texts = [None, "", "see <http://w.org/?u=http://p.org/a>", "urn:odp:xy line\nbreak", "HTTP://P.ORG/A"]
    texts += ["".join(rng.choices("ab/:é ", k=60)) for _ in range(30)]
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "file long, text string, pattern_iri string")
    want = {(i, p) for i, t in enumerate(texts) for p in set(patterns) if p and p in (t or "")}
    for most in (2_000_000, 20):
        got = [tuple(r) for r in containment.contained(rows, strings(spark, patterns, "pattern_iri"), max_letters=most).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert containment.contained(rows, strings(spark, [], "pattern_iri")).count() == 0
    chosen = {r.pattern_iri: (r.file, r.n_files) for r in discovery.containing_files(strings(spark, patterns, "pattern_iri"), rows.withColumn("file", F.col("file").cast("string"))).collect()}
    for p in {p for _, p in want}:
        own = [str(i) for i, q in want if q == p]
        assert chosen[p] == (min(own, key=lambda f: (len(f), f)), len(own))


@pytest.mark.parametrize("letters,low,high", [("ab", 1, 9), ("abcd ", 1, 14), ("abcdefgh ", 5, 25)])
def test_label_joins_lose_nothing(spark, letters, low, high):
    rng = random.Random(len(letters))
    a = sorted({"".join(rng.choices(letters, k=rng.randint(low, high))) for _ in range(50)} | {""})
    b = sorted({"".join(rng.choices(letters, k=rng.randint(low, high))) for _ in range(50)} | set(a[:15]))
    left, right = strings(spark, a), strings(spark, b)
    for t in (0.4, 0.75, 1.0):
        got = {(x, y): s for x, y, s in simjoin.ratio_join(left, right, t).collect()}
        assert got == {(x, y): ratio(x, y) for x in a for y in b if ratio(x, y) >= t}
        assert {(x, y) for x, y, _ in simjoin.jaccard_join(left, right, t).collect()} == {(x, y) for x in a for y in b if word_jaccard(x, y) >= t}
    best = {(x, y): 1.0 if edits(x, y) <= 1 else max(word_jaccard(x, y), ratio(x, y), 1 - edits(x, y) / max(len(x), len(y))) for x in a for y in b}
    got = {(x, y): round(s, 9) for x, y, s in simjoin.label_join(left, right, 0.7, 1).collect()}
    assert got == {k: round(s, 9) for k, s in best.items() if s >= 0.7}


def test_candidates_grow_with_the_labels(spark):
    rng = random.Random(1)
    for n in (300, 3000):
        rows = strings(spark, ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=12)) for _ in range(n)]).repartition(4)
        assert n <= simjoin.subsequence_candidates(rows, rows, 0.8).count() < 2 * n


def test_a_common_word_makes_no_pairs(spark):
    rows = strings(spark, [f"the common w{i} x{i} y{i}" for i in range(2000)])
    met = simjoin.jaccard_join(rows, rows, 0.9)
    assert met.count() == 2000
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_vector_index_recall(spark):
    rng = np.random.RandomState(2)
    centres = rng.normal(size=(30, 32))
    points = np.concatenate([c + 0.45 * rng.normal(size=(40, 32)) for c in centres])
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)] + [(5000, None), (5001, [0.0] * 32)], "vec_id long, embedding array<double>")
    asked = rows.filter("vec_id % 100 = 0")
    exact = {tuple(r)[:2] for r in simjoin.vector_join(asked, rows, 0.7).collect()}
    centres = vector_index.fit_centres(rows)
    index = vector_index.indexed(rows, centres)
    for options in ({}, {"chunk": 16, "block": 5}):
        got = {tuple(r)[:2] for r in vector_index.search(asked, index, centres, 0.7, probes=6, **options).collect()}
        assert got <= exact and len(got) >= 0.9 * len(exact) and len(exact) > 200
    assert vector_index.work(asked, index, centres, 6) < 0.5 * asked.count() * rows.count()
    assert {tuple(r)[:2] for r in vector_index.search(asked, index, centres, 0.7, probes=len(centres)).collect()} == exact
    nothing = rows.limit(0)
    assert vector_index.indexed_join(asked, nothing, 0.7).count() == 0 and vector_index.indexed_join(nothing, rows, 0.7).count() == 0


@pytest.mark.skipif(not pathlib.Path(DATA).exists(), reason="needs the tables")
def test_vector_index_recall_on_the_table(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet")
    asked = rows.filter("vec_id % 100 = 0")
    exact = {tuple(r)[:2] for r in simjoin.vector_join(asked, rows, 0.5).collect()}
    centres = vector_index.fit_centres(rows)
    index = vector_index.indexed(rows, centres)
    got = {tuple(r)[:2] for r in vector_index.search(asked, index, centres, 0.5).collect()}
    assert got <= exact and len(got) >= 0.9 * len(exact)
    assert vector_index.work(asked, index, centres, 8) < 0.3 * asked.count() * rows.count()


def test_quantiles(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(20)])) for _ in range(500)] + [("c", None), ("d", 3), ("e", 1), ("e", 2)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(5)
    want = {}
    for k in {r[0] for r in rows}:
        own = [v for q, v in rows if q == k and v is not None]
        if own:
            want[k] = (min(own), *np.percentile(own, [25, 50, 90]).round(9).tolist(), max(own), len(own))
    got = order.quantiles(df, "v", {"q": 0.25, "m": 0.5, "h": 0.9}, ("k",)).collect()
    assert {r[0]: (r.low, round(r.q, 9), round(r.m, 9), round(r.h, 9), r.high, r.n) for r in got} == want
    assert tuple(order.quantiles(df.limit(0), "v", {"m": 0.5}).first()) == (None, None, None, 0)
    stats = {r.k: (r.total, r.median) for r in papers.citation_stats(df.withColumnRenamed("v", "citations"), "k").collect()}
    assert stats["c"] == (None, None) and stats[None][1] == want[None][2]


def test_linkage_with_a_threshold_keeps_all_that_reach_it(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(12)] + ["the"] * 6
    title = lambda: " ".join(["the", *rng.sample(words, rng.randint(1, 5))])
    seeds = spark.createDataFrame([(i, title(), rng.choice([2000, 2001, None]), rng.choice(["", "v"])) for i in range(30)], "seed_id long, title string, year int, hint string")
    works = spark.createDataFrame([(i, title(), rng.choice([2000, 2003, None]), rng.choice(["ceur", "v", None])) for i in range(60)], "work_id long, title string, year int, venue string")
    for use_ratio in (True, False):
        everything = {(r.seed_id, r.work_id): round(r.score, 9) for r in papers.linkage_candidates(seeds, works, "ceur", use_ratio, list_size=5).collect()}
        assert len(everything) == 30 * 60  # all share a word
        for threshold in (0.72, 0.9, 1.1):
            got = {(r.seed_id, r.work_id): round(r.score, 9) for r in papers.linkage_candidates(seeds, works, "ceur", use_ratio, threshold, list_size=7).collect()}
            assert got == {k: s for k, s in everything.items() if s >= threshold - 1e-9}


def test_folding_of_all_code_points(spark):
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    rows = ["x".join(points[i : i + 2000]) for i in range(0, len(points), 2000)]
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower()
    df = spark.createDataFrame(list(enumerate(rows)), "i long, t string").select("i", papers.folded(F.col("t")).alias("f"))
    assert all(r.f == plain(rows[r.i]) for r in df.collect())
    holds = lambda t, p: spark.range(1).select(papers.contains_folded(F.lit(t), F.lit(p))).first()[0]
    assert not holds("Straße", "strasse") and not holds("smørbrød", "smorbrod") and holds("½ cup", "1") and holds("Un CAFÉ", "café") and holds("ＦＵＬＬ", "full")


def test_nested_values_of_any_depth(spark):
    deep = "end"
    for k in ("uri", None, "@id", None, "id", "value", None, "href"):
        deep = {k: deep, "x": 1} if k else ["", [], deep]
    cases = [(deep, "end"), ([[[[[["", "six"]]]]]], "six"), ({"id": {"y": [1, "é"]}}, '{"y":[1,"é"]}'), ([0, 1], "0"), ([{"url": None}, "b"], "b"), ([True], "true")]
    df = strings(spark, [json.dumps(v) for v, _ in cases] + ["[no json", "plain", None], "v").select("v", landed.as_text(F.col("v")).alias("t"))
    got = {r.v: r.t for r in df.collect()}
    assert [got[json.dumps(v)] for v, _ in cases] == [w for _, w in cases]
    assert (got["[no json"], got["plain"], got[None]) == ("[no json", "plain", "")


def test_counts_are_carried_over_reruns(spark, tmp_path):
    base = tmp_path / "in"
    base.mkdir()
    rng = random.Random(1)
    pages = [[{"seed": rng.choice("abc"), "id": rng.randrange(12)} for _ in range(30)] + [{"seed": None, "id": 1}, {"seed": "a"}] for _ in range(3)]
    schema, out, mark = "seed string, id long", str(tmp_path / "out"), str(tmp_path / "mark")
    seeds = spark.createDataFrame([("a", 1), ("b", 2), ("z", 3)], "seed string, year int")
    seen = set()
    for n, page in enumerate(pages):
        (base / f"{n}.json").write_text("\n".join(map(json.dumps, page)))
        for _ in range(2):  # the second run finds nothing new
            stream.export_batches(spark.readStream.schema(schema).json(str(base)), out, mark).awaitTermination()
        seen |= {(r["seed"], r["id"]) for r in page if r["seed"] and r.get("id") is not None}
        rows = [tuple(r) for r in spark.read.parquet(out).select("seed", "id").collect()]
        assert len(rows) == len(seen) and set(rows) == seen
        assert len([f for f in os.listdir(out) if f.startswith("batch=")]) == n + 2
        counts = {r.seed: (r.year, r.citation_count) for r in stream.carried_counts(seeds, out).collect()}
        assert counts == {s: (y, sum(a == s for a, _ in seen)) for s, y in (("a", 1), ("b", 2), ("z", 3))}


def test_hybrid_decides_by_entity(spark):
    pairs = spark.createDataFrame([("o1", "p"), ("o2", "p")], "ontology_id string, pattern_id string")
    rows = [("p", "class", "p#1", "red car"), ("p", "class", "p#2", "blue"), ("o1", "class", "o#1", "red cars"), ("o2", "class", "o#2", "red carpets of old"), ("o2", "class", "o#3", "azure")]
    named = spark.createDataFrame(rows, "graph_id string, kind string, iri string, label string")
    vectors = spark.createDataFrame([("red car", [1.0, 0.0]), ("red carpets of old", [1.0, 0.1]), ("blue", [0.0, 1.0]), ("azure", [0.1, 1.0]), ("red cars", [0.0, 1.0])], "label string, embedding array<double>")
    reuse = lambda prefilter: {(r.ontology_id, r.iri) for r in triples.hybrid_label_reuse(pairs, named, vectors, 0.8, prefilter).collect()}
    assert reuse(0.75) == {("o1", "p#1")}  # by characters; the other ontology's label is not near enough to ask vectors
    assert reuse(0.45) == {("o1", "p#1"), ("o2", "p#1")}  # blue and azure have no characters in common


def test_hashed_vectors(spark):
    texts = ["", "a", "ab", "abc", "red car", "abcabc"]

    def plain(t):
        t = t.ljust(3) if t else t
        out = [0.0] * 16
        for i in range(len(t) - 2):
            out[(ord(t[i]) * 961 + ord(t[i + 1]) * 31 + ord(t[i + 2])) % 16] += 1
        return out

    got = {r.label: list(r.v) for r in strings(spark, texts).select("label", fl.hashed_vector(F.col("label"), 16).alias("v")).collect()}
    assert got == {t: plain(t) for t in texts}


def test_written_works_and_classes(spark, tmp_path):
    works = spark.createDataFrame([("1", "T, \"q\"", ["A", "B"], 2001)], "id string, title string, authors array<string>, year int")
    sinks.write_works(works, str(tmp_path / "works"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "works/csv")).first().authors == "A; B"
    assert spark.read.json(str(tmp_path / "works/json")).first().authors == ["A", "B"]
    iri = strings(spark, ["http://x/Name.owl", "http://x/y/"]).select(fl.iri_label(F.col("label")).alias("n")).collect()
    assert [r.n for r in iri] == ["Name", "y"]
    rows = spark.createDataFrame([("/in/2001/one.csv", "A", "Possibly"), ("/in/2001/two.x.csv", "B", "Unlikely")], "file string, title string, label string")
    sinks.write_classified(rows, str(tmp_path / "2001"))
    assert sorted(f for f in os.listdir(tmp_path / "2001") if "=" in f) == ["classified=one-classified", "classified=two.x-classified"]
    again = files.read_papers(spark, str(tmp_path / "2001"), {"title": "title", "label": "label"}, "*.csv")
    assert {(r.title, r.label, r.seed_year, r.file.split("=")[-1].split("/")[0]) for r in again.collect()} == {("A", "Possibly", 2001, "one-classified"), ("B", "Unlikely", 2001, "two.x-classified")}
