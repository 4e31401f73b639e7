"""Every stage of the pipeline against brute force, on rows with nulls, empty texts, repeats and clashing names."""

import random
import re
from collections import Counter

import corpus_pipeline
import pytest

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, sha string, cid long, row_number long, stat_n_words double"
STAGE = dict(corpus_pipeline.STAGES)


def rows():
    rng = random.Random(21)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(400)]
    say = lambda n: " ".join(rng.choices(vocabulary, k=n))
    base = say(150).split()
    out = [(1, None), (2, ""), (3, " "), (4, "Same Text"), (5, "same text"), (5, "same text"), (5, "another text"), (None, "no id"), (None, "no id either")]
    for i in range(8):
        own = list(base)
        for _ in range(i):
            own[rng.randrange(150)] = "q"
        out.append((10 + i, " ".join(own)))
    out += [(30 + i, say(40)) for i in range(5)]
    return out


def frame(spark, data):
    return spark.createDataFrame([(i, t, "en", "clash", 7, 8, 0.5) for i, t in data], SCHEMA).repartition(3)


def kept(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables of labels and benchmark that the stages read."""
    path = str(tmp_path_factory.mktemp("tables"))
    data = rows()
    item = " ".join(data[9][1].split()[20:60])
    spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "words that no document has at all")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(i, int(i % 3 > 0), 0) for i in range(1000, 1240)] + [(1000, None, None), (None, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_exact_stage(spark, folder):
    data = rows()
    best = {}
    for i, t in data:
        k = (t or "").translate(LOW)
        best[k] = max(best.get(k, -1), -1 if i is None else i)
    got = STAGE["exact_dedup"](spark, frame(spark, data), folder)
    assert got.columns == frame(spark, data).columns
    assert Counter((r.doc_id, (r.text or "").translate(LOW)) for r in got.collect()) == Counter({(None if i < 0 else i, k): 1 for k, i in best.items()})


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_near_stage(spark, folder):
    data = rows()
    sets, root = [shingles(t) for _, t in data], list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(data)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                root[find(a)] = find(b)
    groups = Counter(find(k) for k in range(len(data)))
    got = STAGE["near_dedup"](spark, frame(spark, data), folder)
    assert got.columns == frame(spark, data).columns
    found = [(r.doc_id, r.text) for r in got.collect()]
    assert len(found) == len(groups)
    homes = {row: find(k) for k, row in enumerate(data)}
    assert len({(homes[row], row if not shingles(row[1]) else None) for row in found}) == len(groups)
    unique = [(i, t) for k, (i, t) in enumerate(data) if i is not None and i >= 10]
    got = kept(STAGE["near_dedup"](spark, frame(spark, unique), folder))
    least = {}
    for i, t in unique:
        least.setdefault(homes[i, t], (i, t))
    assert got == Counter(least.values())  # where ids are unique, the smallest stays


def test_decontamination_stage(spark, folder):
    data = rows()
    word = re.compile(r"[0-9a-z\x80-\U0010ffff]+")
    item = word.findall(data[9][1])[20:60]

    def covered(text):  # of one item in order, words in runs of five at least
        words, gone = word.findall((text or "").translate(LOW)), set()
        for i in range(len(item) - 4):
            if any(words[j : j + 5] == item[i : i + 5] for j in range(len(words) - 4)):
                gone |= set(range(i, i + 5))
        return len(gone)

    want = Counter((i, t) for i, t in data if covered(t) < 0.8 * len(item))
    assert kept(STAGE["decontamination"](spark, frame(spark, data), folder)) == want and len(want) < len(data)


def test_quality_stage(spark, folder):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choices(["the", "of", "house", "river", "stone", "walks", "bright"], k=60)) + "."
    bad = lambda: " | ".join(["BUY!!"] * 40)
    data = [(i, good() if i % 3 else bad()) for i in range(1000, 1240)] + [(5000, good()), (5000, bad()), (None, good()), (None, bad())]
    got = STAGE["quality"](spark, frame(spark, data), folder)
    assert got.columns == frame(spark, data).columns
    assert kept(got) == Counter((i, t) for i, t in data if "BUY" not in t)
    odd = STAGE["quality"](spark, frame(spark, data + rows()), folder)
    assert not kept(odd) - Counter(data + rows())


def test_packing_stage(spark, folder):
    got = STAGE["packing"](spark, frame(spark, rows()), folder).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows())  # all shorter than a sequence
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048 and len(ends) <= -(-sum(ends.values()) // 2048) + 1


def test_stages_of_empty_tables(spark, folder):
    for name, stage in corpus_pipeline.STAGES:
        empty = frame(spark, rows()).limit(0)
        got = stage(spark, empty, folder)
        assert got.count() == 0 and (name == "packing" or got.columns == empty.columns)
