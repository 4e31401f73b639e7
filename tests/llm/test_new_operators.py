"""SimHash dedup, periodic runs and lexical search against plain reckonings, over odd rows too."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import xxhash

from reweave.llm import lexical, periodic, queries, simhash

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, fp long, tile long, runs string, item_id string, score string"


def rows():
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdé", k=rng.randint(1, 5))) for _ in range(150)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    long_ = say(3000)
    out = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one"), (5, "One two"), (6, "one  two"), (7, "a b c"), (8, "Éa é"), (9, "x\x00y \x85 z\x00")]
    out += [(20 + i, say(rng.randint(1, 80))) for i in range(40)]
    out += [(100 + i, long_ + " " + say(i)) for i in range(12)]  # near copies
    out += [(200, "la " * 500), (201, "a b " * 100 + "c"), (202, "x a b a b a b a b a y a a a a a a z"), (203, "aa aa aa aa aa"), (204, "q " + "u v w u v w x " * 6)]
    out += [(205, " ".join(["ab", "cd", "ef"] * 4)), (206, "b" * 100_000), (None, "no id here"), (None, None), (20, "Same id, other text"), (100, long_)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, 2, "r", "i", "s") for i, t in rows()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def key(r):
    return tuple((v is not None, v) for v in r)


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def fingerprint(text):
    words = SPACED.findall((text or "").translate(LOW))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints, radius=2):
    """Component number of each fingerprint, all pairs compared."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                root[find(a)] = find(b)
    return [find(x) for x in range(len(prints))]


@pytest.mark.parametrize("options", [{}, {"parts": 4, "tile_size": 2}, {"parts": 8}])
def test_simhash_dedup(docs, nothing, options):
    assert simhash.simhash_dedup(nothing, **options).count() == 0
    prints = [fingerprint(t) for _, t in rows()]
    component, least = linked(prints), {}
    for (i, _), c in zip(rows(), component):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    often = Counter(prints)
    want = [(i, f"{p:016x}", least.get(c), often[p]) for (i, _), p, c in zip(rows(), prints, component)]
    same(simhash.simhash_dedup(docs, **options).collect(), want)
    assert len({w[2] for w in want}) < len({w[1] for w in want})  # some differ and yet link


def test_tiles_lose_no_pair_and_skip_most():
    rng = np.random.RandomState(5)
    base = rng.randint(0, 2**63 - 1, 300).astype(np.uint64)
    near = [b ^ np.uint64(1 << int(i)) ^ np.uint64(1 << int(j)) for b in base[:100] for i, j in [rng.randint(0, 64, 2)]]
    all_ = [int(x) for x in base] + [int(x) for x in near]
    for parts in (1, 4, 6, 8):
        widths, weights, steps = simhash._widths(parts), simhash._weights(parts, 2), set(simhash.tile_steps(parts, 2))

        def number(x):
            out, shift = 0, 0
            for width, weight in zip(widths, weights):
                out, shift = out + (x >> shift & (1 << width) - 1).bit_count() * weight, shift + width
            return out

        tiles = [number(x) for x in all_]
        met = sum(abs(tiles[a] - tiles[b]) in steps for a in range(len(all_)) for b in range(a))
        assert all(abs(tiles[a] - tiles[b]) in steps for a in range(len(all_)) for b in range(a) if (all_[a] ^ all_[b]).bit_count() <= 2)
        assert met < len(all_) ** 2 / 2 * {1: 0.5, 4: 0.05, 6: 0.01, 8: 0.005}[parts]
    assert [len(simhash.tile_steps(p, 2)) for p in (6, 8, 16)] == [43, 73, 273]


def test_pairs_of_blocks():
    rng = np.random.RandomState(7)
    left = [rng.randint(0, 64, n).astype(np.uint64) for n in (3, 0, 120, 70)]
    right = [rng.randint(0, 64, n).astype(np.uint64) for n in (4, 5, 110, 2)]
    x, y = simhash.near_pairs(left, right, 1, most=500)
    want = sorted((int(a), int(b)) for p, q in zip(left, right) for a in p for b in q if a != b and int(a ^ b).bit_count() <= 1)
    assert sorted(zip(x.tolist(), y.tolist())) == want
    a, b = simhash.forest(x, y)
    nodes = sorted({v for pair in want for v in pair})
    assert len(a) == len(nodes) - len(set(linked(nodes, 1)))
    assert simhash.near_pairs([], [], 2)[0].size == 0


def plain_runs(words, least=6, times=4):
    found = {}
    for p in range(1, len(words) // times + 1):
        i = 0
        while i + p < len(words):
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(least, times * p):
                found.setdefault((i, j - i + p), p)
            i = j
    return sorted((a, n, p) for (a, n), p in found.items())


def collapsed(words, runs):
    gone = {k for a, n, p in runs for k in range(a + p, a + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def test_periodic_runs(docs, nothing):
    assert periodic.periodic_runs(nothing).count() == 0
    want = []
    for i, t in rows():
        words = SPACED.findall(t or "")
        runs = plain_runs(words)
        want.append((i, len(words), tuple(runs), collapsed(words, runs)))
    got = periodic.periodic_runs(docs).collect()
    same([(r["doc_id"], r["n_words"], tuple((s["start"], s["length"], s["period"]) for s in r["runs"]), r["collapsed"]) for r in got], want)
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs, times=3)


def test_runs_of_random_and_nested_texts():
    rng = random.Random(2)
    texts = [["w%d" % rng.randrange(k) for _ in range(rng.randrange(120))] for k in (1, 2, 3) for _ in range(60)]
    for _ in range(40):
        unit = [rng.choice("ab") for _ in range(rng.randint(1, 6))] * rng.randint(4, 7)
        texts.append((["x"] + unit + unit[: rng.randrange(4)] + [rng.choice("xab")]) * rng.randint(1, 6))
    hashes = np.array([zlib.crc32(w.encode()) for t in texts for w in t], np.uint64)
    for least, times in ((6, 4), (10, 5)):
        found = periodic.find_runs(texts, hashes, least, times)
        for k, t in enumerate(texts):
            assert [tuple(r) for r in found.get(k, np.zeros((0, 3), int)).tolist()] == plain_runs(t, least, times), t


def test_a_long_text_that_only_repeats():
    found = periodic.find_runs([["a"] * 30_000, ["a", "b"] * 5_000], np.array([1] * 30_000 + [1, 2] * 5_000, np.uint64))
    assert found[0].tolist() == [[0, 30_000, 1]] and found[1].tolist() == [[0, 10_000, 2]]


def test_extensions_equal_plain_comparison():
    rng = np.random.RandomState(1)
    for high in (1, 2, 4):
        seq = np.append(rng.randint(0, high, 200), 9)
        reach = periodic.Extensions(seq)
        i, j = (v.ravel() for v in np.meshgrid(np.arange(201), np.arange(201)))
        i, j = i[i != j], j[i != j]

        def plain(a, b):
            n = 0
            while max(a, b) + n < 201 and seq[a + n] == seq[b + n]:
                n += 1
            return n

        assert reach(i, j).tolist() == [plain(a, b) for a, b in zip(i.tolist(), j.tolist())]


def test_periodic_query(spark, tmp_path):
    spark.createDataFrame(rows(), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in rows():
        words = queries.planted_period(i, SPACED.findall(t or ""))
        runs = plain_runs(words)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
        lines = "".join("%d,%d,%d\n" % r for r in runs)
        milli = 1000 * best[1] // best[2] if runs else None
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(runs), *best, milli, digest(lines), digest(collapsed(words, runs)), len(words)))
    got = queries.op12_periodic_runs(spark, str(tmp_path))
    assert dict(got.dtypes)["start"] == dict(got.dtypes)["exponent_milli"] == "bigint"
    same(got.collect(), want)


def plain_search(docs, items, k):
    bags = [(i, Counter(TERM.findall((t or "").translate(LOW)))) for i, t in docs]
    n_docs, all_terms = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    holding = Counter(w for _, b in bags for w in b)
    asked = defaultdict(set)
    for item, t in items:
        asked[item] |= set(TERM.findall((t or "").translate(LOW)))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, bag in bags:
            norm = 10 + (90 * sum(bag.values()) * n_docs) // max(1, all_terms)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[w] + 1))) * ((10**9 * bag[w]) // (1000 * bag[w] + 8 * norm))
                for w in terms if w in bag
            )
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:k], 1)]
    return out


@pytest.mark.parametrize("options", [{}, {"k": 3, "width": 8}, {"max_terms": 60}])
def test_lexical_search(spark, docs, nothing, options, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 16)
    monkeypatch.setattr(lexical, "RESCORED", 4)
    texts = [t for _, t in rows()]
    items = [(1, texts[25]), (2, texts[30]), (2, "one ZWO, one!"), (3, None), (4, ""), (5, "unknownword"), (None, "no id"), (6, "aa ab ac")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    same(lexical.lexical_search(docs, bench, **options).collect(), plain_search(rows(), items, options.get("k", 10)))
    assert lexical.lexical_search(nothing, bench).count() == 0
    assert lexical.lexical_search(docs, bench.limit(0)).count() == 0


def test_rescoring_stops_at_the_threshold():
    rng = np.random.RandomState(3)
    true = rng.randint(0, 1000, 5000)
    bounds = (true + rng.randint(0, 50, 5000)).astype(float)
    best = lexical.Best(10)
    done = lexical.rescore(bounds, np.arange(5000), lambda own: true[own], best)
    order = sorted(range(5000), key=lambda i: (-true[i], i))[:10]
    assert best.ids.tolist() == order and done < 1000
