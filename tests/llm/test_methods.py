"""Methods of single operators against plain reckonings of their own."""

import hashlib
import random
from collections import Counter

import numpy as np

from reweave.llm import chat_format, decontaminate, exact_dedup, license_scan, quality, queries


def plain_tiles(item, text, least):
    """Greedy string tiling by looking at all places again for every tile."""
    in_item, in_text, out = set(), set(), []
    while True:
        best = None
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and i + n not in in_item and j + n not in in_text:
                    n += 1
                if n >= least and (best is None or (-n, i, j) < best):
                    best = (-n, i, j)
        if best is None:
            return out
        n, i, j = -best[0], *best[1:]
        out.append((i, j, n))
        in_item |= set(range(i, i + n))
        in_text |= set(range(j, j + n))


def test_tiles_equal_plain_tiling():
    rng = random.Random(12)
    for k in range(120):
        words = "ab" if k % 3 else "abcdefgh"
        item, text = rng.choices(words, k=rng.randint(1, 40)), rng.choices(words, k=rng.randint(1, 60))
        if k % 4 == 0:
            text = text[:20] + item[10:] + text[20:] + item[:10]
        least = rng.choice([3, 5])
        assert decontaminate.tile(item, text, least, rng.choice([5, 20])) == plain_tiles(item, text, least), (item, text)
    assert decontaminate.tile(["x"] * 8, ["x"] * 3 + [None] + ["x"] * 6) == [(0, 4, 6)]


def test_tiles_of_one_repeated_word():
    assert decontaminate.tile(["w"] * 3000, ["w"] * 20000) == [(0, 0, 3000)]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_notices_have_no_false_hits():
    rng = random.Random(13)
    for notice, label in license_scan.NOTICES.items():
        fuzzy = license_scan.Fuzzy(notice, label, len(notice) // 9)
        for _ in range(15):
            words = notice.split()
            for _ in range(rng.randrange(5)):
                k = rng.randrange(len(words))
                words[k] = "".join(rng.sample(words[k], len(words[k])))
            text = ("some words " + " ".join(words) + " and more").encode()
            found = fuzzy.search(text)
            assert all(edits(text[a:b].decode(), notice) <= fuzzy.edits and n <= fuzzy.edits for a, b, n in found)
            at = [i for i in range(len(text)) if i == 0 or text[i - 1 : i] == b" "]
            ends = [i for i in range(1, len(text) + 1) if i == len(text) or text[i : i + 1] == b" "]
            near = any(abs(b - a - len(notice)) <= fuzzy.edits and edits(text[a:b].decode(), notice) <= fuzzy.edits for a in at for b in ends)
            assert near == bool(found), text


def test_query_reports_spans(spark):
    rows = [(1, "All rights reservd"), (2, None), (3, "x " * 50_000 + "all rights reserved"), (1, "All rights reservd")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = license_scan.license_scan(docs).collect()
    assert Counter((r.doc_id, tuple((s.label, s.first_word, s.n_words, s.edits) for s in r.spans)) for r in got) == Counter(
        {(1, (("notice-reserved", 0, 3, 1),)): 2, (2, ()): 1, (3, (("notice-reserved", 50_000, 3, 0),)): 1}
    )


def test_compiled_rules_score_as_the_ensemble_does(spark):
    rng = np.random.RandomState(5)
    x = rng.rand(400, len(quality.STATISTICS)) * 4
    y = ((x[:, 2] > 2) & (x[:, 5] <= 3) | (x[:, 7] > 3.5)).astype(float)
    model = quality.fit(x, y)
    assert model.rules
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"p_{s} double" for s in quality.STATISTICS))
    got = [r.score for r in df.select(model.column("p_").alias("score")).collect()]
    assert np.allclose(sorted(got), sorted(model.score(x)), atol=1e-12)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.9


def test_held_out_accuracy_on_the_tables(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.op8_quality(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").select("predicted", "quality").collect()
    assert len(got) > 50 and sum(r.predicted == r.quality for r in got) >= 0.95 * len(got)


def test_log_of_rows_folds_back(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", None, "a:b"]), rng.choice([None, "", "x", "\\### </turn>", "é" * 950, "ab " * 500])) for c in (1, 2, None) for t in range(6)]
    rows += [rows[0], (1, 0, "user", "same turn"), (1, None, "assistant", "no turn")]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, message string")
    events = chat_format.rows_as_log(table)
    assert {r.kind for r in events.select("kind").distinct().collect()} == {"delta", "edit", "regenerate"}
    got = chat_format.fold(events).select("conv_id", "turn", "role", "text").collect()
    assert Counter(map(tuple, got)) == Counter((c, t, r or "", x or "") for c, t, r, x in rows)
    plain = chat_format.digest(chat_format.format_conversations(chat_format.rows_as_events(table))).collect()
    streamed = chat_format.digest(chat_format.format_conversations(events)).collect()
    assert Counter(map(tuple, plain)) == Counter(map(tuple, streamed)) and len(plain) == 3
    assert chat_format.rows_as_log(table.limit(0)).count() == 0


def test_keep_unique_keeps_columns_of_any_name(spark):
    rows = [(1, "A", "x"), (1, "a", "y"), (1, "b", "z"), (2, "b", "w"), (None, None, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __sha string").selectExpr("*", "1 as sha", "2 as kept_id", "3 as text_sha256")
    kept = exact_dedup.keep_unique(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, (r.text or "").lower()) for r in kept.collect()]
    assert sorted(got, key=str) == sorted([(1, "a"), (2, "b"), (None, "")], key=str)


def test_very_long_texts(spark):
    rng = random.Random(2)
    long = " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "epsilon"], k=1_000_000))  # beyond every cut of batches
    docs = spark.createDataFrame([(1, long), (2, long), (3, "short")], "doc_id long, text string")
    from reweave.llm import near_dedup, substring_dedup, suffix_dedup

    assert {r.doc_id: r.component_id for r in near_dedup.near_dedup(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert {(r.doc_id, r.n_words - r.n_removed) for r in substring_dedup.substring_dedup(docs).collect()} == {(1, 0), (2, 0), (3, 1)}
    assert {(r.doc_id, r.n_bytes - r.n_removed) for r in suffix_dedup.suffix_dedup(docs).collect()} == {(1, 0), (2, 0), (3, 5)}
    assert {(r.doc_id, r.keep_id, r.text_sha256) for r in exact_dedup.exact_dedup(docs).collect()} == {
        (1, 2, hashlib.sha256(long.encode()).hexdigest()), (2, 2, hashlib.sha256(long.encode()).hexdigest()), (3, 3, hashlib.sha256(b"short").hexdigest())
    }


def test_a_common_stem_makes_no_pairs(spark):
    rng = random.Random(4)
    say = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    stem = "which of the following is true".split()
    items = [stem + say(20 + i % 7) for i in range(60)]
    texts = [say(15) + stem + say(15) for _ in range(60)] + [say(9) + items[3] + say(4) + items[5][::-1], items[7][9:] + say(3) + items[7][:9]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    shares = {(d, i): sum(n for _, _, n in plain_tiles(item, text, 5)) / len(item) for d, text in enumerate(texts) for i, item in enumerate(items)}
    for threshold in (0.8, 0.2):
        got = decontaminate.coverage(docs, bench, threshold=threshold).collect()
        wanted = {k for k, s in shares.items() if s >= threshold}
        assert {(r["doc_id"], r["item_id"]) for r in got if r["share"] >= threshold} == wanted
        assert all(r["share"] == shares[r["doc_id"], r["item_id"]] for r in got)
        assert len(got) <= len(texts) + len(wanted)
        best = {r["doc_id"]: r["share"] for r in sorted(got, key=lambda r: r["share"])}
        assert best == {d: max(shares[d, i] for i in range(len(items))) for d in range(len(texts))}


def test_rows_to_learn_from_are_bounded_where_ids_repeat(spark, monkeypatch):
    docs = spark.range(400).selectExpr("cast(1 AS long) AS doc_id", "concat('some words ', id) AS text")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append(x.shape) or quality.RuleEnsemble(0.0))
    quality.learn(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"), max_rows=10)
    assert seen == [(10, len(quality.STATISTICS))]
