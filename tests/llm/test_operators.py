"""Every operator against a plain reckoning, over rows with nulls, empty and long texts, ties and repeats."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from reweave.llm import (
    chat_format, decontaminate, deep_shallow, exact_dedup, license_scan, near_dedup, packing, quality, queries,
    substring_dedup, suffix_dedup, token_counts,
)

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, sha string, cid long, h long, text_sha256 string"


def rows():
    """Ids with texts; some repeat, some are null, some share passages, some are near copies."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(300)]
    say = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passage, common = say(60), say(150)
    out = [(0, None), (1, ""), (2, " \n\t"), (3, "A"), (4, "a"), (5, "one two three"), (6, "One two three "), (7, "ÉA é"), (8, "éA é")]
    out += [(10 + i, f"{say(20 + i)} {passage} {say(15)}") for i in range(6)]
    words = common.split()
    for i in range(12):
        own = list(words)
        for _ in range(i):
            own[rng.randrange(len(own))] = "x"
        out.append((20 + i, " ".join(own)))
    out += [(40, common), (41, common.upper()), (42, say(4000)), (43, "ab" * 900), (44, "ab" * 900), (45, passage + "\n" + passage)]
    out += [(50, "This work is licensed under the GNU General Public Licence, CC BY 4.0"), (51, "GNU general. public-license; CC by. gnu general public license")]
    out += [(52, "relased under teh MIT license"), (53, "x\x00y z\x85w v"), (None, "no id here"), (44, "ab" * 900), (60, passage[:400])]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "clash", 1, 2, "clash") for i, t in rows()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def key(r):
    return tuple((v is not None, v) for v in r)


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("options", [{}, {"block_bytes": 16}, {"block_bytes": 8, "hash_bits": 3}])
def test_exact_dedup(docs, nothing, options):
    groups = defaultdict(list)
    for i, t in rows():
        groups[(t or "").translate(LOW)].append(-1 if i is None else i)
    want = []
    for t, ids in groups.items():
        best, left = max(ids), True
        for i in sorted(ids, reverse=True):
            none = lambda x: None if x == -1 else x
            want.append((none(i), none(best), len(ids), i == best and left, hashlib.sha256(t.encode()).hexdigest()))
            left = False if i == best else left
    same(exact_dedup.exact_dedup(docs, **options).collect(), want)
    assert exact_dedup.exact_dedup(nothing).count() == 0


def test_keep_unique(docs):
    got = exact_dedup.keep_unique(docs)
    assert got.columns == docs.columns
    texts = [(r.text or "").translate(LOW) for r in got.collect()]
    assert len(texts) == len(set(texts)) == len({(t or "").translate(LOW) for _, t in rows()})


def shingles(text, size):
    w = SPACED.findall((text or "").translate(LOW))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def reckoned_components(data, size):
    sets = [shingles(t, size) for _, t in data]
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(data)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    ids = defaultdict(list)
    for k, (i, _) in enumerate(data):
        ids[find(k)].append(i)
    least = {r: min((i for i in v if i is not None), default=None) for r, v in ids.items()}
    return [(i, len(sets[k]), least[find(k)], i == least[find(k)]) for k, (i, _) in enumerate(data)]


def test_near_dedup(docs, nothing):
    same(near_dedup.near_dedup(docs, shingle_words=4).collect(), reckoned_components(rows(), 4))
    assert near_dedup.near_dedup(nothing).count() == 0


def test_near_dedup_settles_lists_between_components(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    data = []
    for i in range(160):
        own = list(base)
        for _ in range(rng.choice([0, 1, 4, 6, 7, 8, 9, 12])):
            own[rng.randrange(len(own))] = f"n{rng.randrange(10**6)}"
        data.append((i, " ".join(own)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    same(near_dedup.near_dedup(df, shingle_words=4).collect(), reckoned_components(data, 4))
    kept = near_dedup.keep_one(df, shingle_words=4)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, _, _, k in reckoned_components(data, 4) if k}


def reckoned_repeats(units, window):
    seen = Counter(tuple(u[i : i + window]) for u in units for i in range(len(u) - window + 1))
    out = []
    for u in units:
        gone = [False] * len(u)
        for i in range(len(u) - window + 1):
            if seen[tuple(u[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((gone, spans))
    return out


def test_substring_dedup(docs, nothing):
    units = [[w.encode() for w in SPACED.findall(t or "")] for _, t in rows()]
    want = []
    for (i, _), u, (gone, spans) in zip(rows(), units, reckoned_repeats(units, 35)):
        kept = b" ".join(w for w, g in zip(u, gone) if not g)
        want.append((i, len(u), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    same(substring_dedup.substring_dedup(docs).select("doc_id", "n_words", "n_removed", "n_spans", "kept_sha256").collect(), want)
    assert substring_dedup.substring_dedup(nothing).count() == 0


@pytest.mark.parametrize("most", [64, 1])
def test_suffix_dedup(docs, nothing, most):
    units = [(t or "").encode() for _, t in rows()]
    want = []
    for (i, _), u, (gone, spans) in zip(rows(), units, reckoned_repeats(units, 120)):
        kept = bytes(b for b, g in zip(u, gone) if not g)
        want.append((i, len(u), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    got = suffix_dedup.suffix_dedup(docs, window=120, gram=24, most=most)
    same(got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect(), want)
    assert most > 1 or suffix_dedup.suffix_dedup(nothing).count() == 0


def test_deep_shallow_sort():
    rng = random.Random(1)
    for _ in range(50):
        base = bytes(rng.choices(b"ab", k=200))
        s = [base[: rng.randrange(200)] + bytes(rng.choices(b"abc", k=rng.randrange(30))) for _ in range(rng.randrange(1, 40))]
        s += s[:3]
        order = deep_shallow.sort(s)
        assert [s[i] for i, _ in order] == sorted(s)
        assert all(n == deep_shallow.common_prefix(s[i], s[j]) for (i, _), (j, n) in zip(order, order[1:]))
    assert deep_shallow.sort([]) == []


def test_license_scan(docs, nothing):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    got = defaultdict(list)
    for r in license_scan.license_scan(docs).collect():
        got[r.doc_id].append(r)
    for i, t in rows():
        words = word.findall((t or "").translate(LOW))
        hits = [(k, label) for p, label in license_scan.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r = got[i][0]
        assert (r.n_words, r.n_base) == (len(words), len(hits)), i
        assert (r.first_word, r.last_word) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in hits})) and set(r.base_labels.split(",")) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert "notice-gpl" in got[50][0].labels and got[50][0].spans[0].edits == 1
    assert "notice-mit" in got[52][0].labels and [(s.first_word, s.n_words) for s in got[52][0].spans] == [(0, 5)]
    assert license_scan.license_scan(nothing).count() == 0


def test_fuzzy_finds_every_place_with_few_edits():
    rng = random.Random(2)
    fuzzy = license_scan.Fuzzy("released under the mit license", "x", 3)
    for _ in range(200):
        s = list("released under the mit license")
        for _ in range(rng.randint(0, 3)):
            s[rng.randrange(1, len(s) - 1)] = rng.choice("qz")
        text = ("abc def " + "".join(s) + " ghi").encode()
        assert fuzzy.search(text), text


def test_token_counts(docs, nothing):
    path = queries.vocabulary()
    costs = token_counts.read_pieces(path)
    find = token_counts.regex.compile(token_counts.PATTERN).findall

    def best(word):
        least = [(0, 0)]
        for e in range(1, len(word) + 1):
            least.append(min((least[s][0] + costs[word[s:e]], least[s][1] + 1) for s in range(e) if word[s:e] in costs))
        return least[-1]

    want = []
    for i, t in rows():
        found = [best(w.encode()) for w in find(t or "")]
        want.append((i, len(t or ""), len(found), sum(n for _, n in found), sum(c for c, _ in found)))
    same(token_counts.token_counts(docs, vocabulary=path).collect(), want)
    same(token_counts.token_counts(docs, vocabulary=path, cache_size=5).collect(), want)
    assert token_counts.token_counts(nothing, vocabulary=path).count() == 0


def test_packing(docs, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder.encode_special_tokens = True
    got = packing.best_fit_packing(docs, vocabulary=queries.vocabulary(), capacity=64).collect()
    want = Counter()
    for i, t in rows():
        ids = encoder.encode(t or "", add_special_tokens=False).ids + [0]
        for k, (a, n) in enumerate(packing.cut(len(ids), 64)):
            want[i, k, a, n, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a : a + n]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        end = 0
        for a, n in sorted(own):
            assert a == end
            end += n
        assert end <= 64
    assert len(sequences) <= 1.02 * sum(r.length for r in got) / 64 + 2
    assert packing.best_fit_packing(nothing, vocabulary=queries.vocabulary()).count() == 0


def test_packing_plan_uses_up_every_length():
    import numpy as np

    rng = np.random.RandomState(4)
    counts = np.zeros(257, int)
    counts[1:] = rng.poisson(30, 256) * (rng.rand(256) < 0.7)
    used, sequences = np.zeros(257, int), 0
    for times, repeats in packing.plan(counts, 256):
        assert sum(n * k for n, k in times.items()) <= 256
        sequences += repeats
        for n, k in times.items():
            used[n] += k * repeats
    bound = max((counts * np.arange(257)).sum() / 256, counts[129:].sum())  # no two lengths over half fit together
    # a lower bound, which no packing of these lengths need reach
    assert (used == counts).all() and sequences <= 1.03 * bound + 1


def test_quality(spark, docs, nothing):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choices(["the", "of", "house", "river", "stone", "walks", "bright"], k=60)) + "."
    bad = lambda: " | ".join(["BUY!!"] * 40)
    data = [(i, good() if i % 3 else bad(), "x") for i in range(240)]
    df = spark.createDataFrame(data, "doc_id long, text string, stat_n_words string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), None) for i in range(240)] + [(3, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for r in quality.classify(df, labels).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.doc_id % 3 > 0) == int(r.score >= 0.7)
    kept = quality.accepted(df, labels)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i in range(240) if i % 3}
    odd = quality.classify(docs, labels).collect()
    assert len(odd) == len(rows()) and all(0 <= r.score <= 1 for r in odd)
    assert quality.classify(nothing, labels).count() == 0 and quality.classify(docs, labels.limit(0)).count() == len(rows())


def test_decontaminate(spark, docs, nothing):
    word = re.compile(r"[0-9a-z\x80-\U0010ffff]+")
    passage = next(t for i, t in rows() if i == 45).split("\n")[0].split()
    items = [(1, " ".join(passage[:30])), (2, " ".join(passage[30:50]).upper() + "!"), (3, "never seen in any of these texts"), (4, None), (5, "no id"), (6, "")]
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, share string")
    shuffled = " ".join(passage[20:30] + ["zz"] + passage[10:20] + ["yy"] + passage[:10])
    more = docs.unionByName(spark.createDataFrame([(70, shuffled), (71, " ".join(passage[:20]))], "doc_id long, text string"), allowMissingColumns=True)
    got = {r.doc_id: r for r in decontaminate.report(more, bench).collect()}
    assert len(got) == len({i for i, _ in rows()}) + 2
    for i, t in [*rows(), (70, shuffled), (71, " ".join(passage[:20]))]:
        text = word.findall((t or "").translate(LOW))
        bad = []
        for k, item in items:
            own = word.findall((item or "").translate(LOW))
            tiles = decontaminate.tile(own, text, min(5, len(own))) if own else []
            if own and sum(n for _, _, n in tiles) >= 0.8 * len(own):
                bad.append(k)
        assert got[i].items == ",".join(map(str, bad)) and got[i].contaminated == bool(bad) and got[i].n_items == len(bad), i
    assert got[70].contaminated and got[10].contaminated and not got[71].contaminated and not got[3].contaminated
    split = decontaminate.report(more, bench, max_seeds=120)
    assert {(r.doc_id, r.items) for r in split.collect()} == {(i, r.items) for i, r in got.items()}
    kept = decontaminate.keep_clean(more, bench)
    assert kept.columns == more.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.contaminated}
    assert decontaminate.report(nothing, bench).count() == 0 and decontaminate.decontaminate(docs, bench.limit(0)).count() == 0


def test_tiles_do_not_overlap():
    rng = random.Random(8)
    for _ in range(100):
        item, text = rng.choices("abc", k=25), rng.choices("abc", k=60)
        tiles = decontaminate.tile(item, text)
        assert all(item[i : i + n] == text[j : j + n] and n >= 5 for i, j, n in tiles)
        for side in (0, 1):
            used = [x for t in tiles for x in range(t[side], t[side] + t[2])]
            assert len(used) == len(set(used))


def test_chat_format(spark):
    said = "\\### Assistant: </turn> ok"
    events = [
        (1, 0, 10, 0, "delta", "user", "Hel"), (1, 0, 10, 1, "delta", None, "lo"),
        (1, 1, 11, 2, "delta", "assistant", "wrong"), (1, 1, 11, 5, "regenerate", None, None), (1, 1, 11, 6, "delta", None, said), (1, 1, 11, 7, "delta", None, "!"),
        (1, 2, 12, 3, "delta", "user", "typo"), (1, 2, 12, 8, "edit", None, "fixed"),
        (2, 0, 20, 0, "delta", "a:b", None), (None, 0, 30, 0, "delta", None, "lost"),
    ]
    log = spark.createDataFrame(events, "conv_id long, turn long, message long, seq long, kind string, role string, text string").repartition(5)
    pieces = chat_format.format_conversations(log)
    text = defaultdict(str)
    for r in sorted(pieces.collect(), key=lambda r: (str(r.conv_id), r.turn)):
        text[r.conv_id] += r.formatted
    assert chat_format.read_turns(text[1]) == [("user", "Hello"), ("assistant", said + "!"), ("user", "fixed")]
    assert chat_format.read_turns(text[2]) == [("a:b", "")] and chat_format.read_turns(text[None]) == [("", "lost")]
    got = {r.conv_id: r for r in chat_format.digest(pieces).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == len(said) + 1 and got[1].formatted_chars == len(text[1])
    assert got[1].loss_sha256 == hashlib.sha256((said + "!").encode()).hexdigest()
    assert chat_format.digest(chat_format.format_conversations(log.limit(0))).count() == 0


def test_escaping_is_reversible():
    rng = random.Random(9)
    for _ in range(500):
        text = "".join(rng.choices(["\\", "#", "##", "###", "</turn>", "</", "turn>", "\n", "h", "e", ": ", "a"], k=rng.randrange(12)))
        escaped = chat_format.escape(text)
        assert "###" not in escaped and "</turn>" not in escaped and chat_format.unescape(escaped) == text
        turn, a, b = chat_format.render_turn("assistant", text)
        assert chat_format.read_turns(turn * 2) == [("assistant", text)] * 2 and turn[a:b] == escaped
