"""Repeats where ids repeat, and texts that sums of powers modulo 2**64 take for one another."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from reweave.llm import bytewords as bw
from reweave.llm import near_dedup, substring_dedup, suffix_dedup


def thue_morse(n, a, b):
    return [(a, b)[bin(i).count("1") % 2] for i in range(n)]


def covered(units, window):
    seen = Counter(tuple(u[i : i + window]) for u in units for i in range(len(u) - window + 1))
    out = []
    for u in units:
        gone = [False] * len(u)
        for i in range(len(u) - window + 1):
            if seen[tuple(u[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append(gone)
    return out


def rows():
    rng = random.Random(4)
    say = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    passage = say(40)
    one, two = f"{say(200)} {passage} {say(200)}", f"{say(200)} {passage} {say(200)}"
    many = [(9, f"{say(30)} {passage} {say(k)}") for k in range(20, 40)]
    return [(1, one), (1, two), (2, "x"), (None, f"{say(50)} {passage}"), (None, f"{say(60)} {passage} {say(9)}"), (3, say(80)), (3, None), (1, one), *many]


@pytest.mark.parametrize("most", [64, 3])
def test_rows_that_share_an_id_keep_their_own_text(spark, most):
    docs = spark.createDataFrame(rows(), "doc_id long, text string")
    words = [(t or "").encode().split() for _, t in rows()]
    want = Counter((i, len(w), sum(g), hashlib.sha256(b" ".join(x for x, y in zip(w, g) if not y)).hexdigest()) for (i, _), w, g in zip(rows(), words, covered(words, 35)))
    got = substring_dedup.substring_dedup(docs, most=most).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert Counter(map(tuple, got.collect())) == want
    texts = [(t or "").encode() for _, t in rows()]
    want = Counter((i, len(w), sum(g), hashlib.sha256(bytes(x for x, y in zip(w, g) if not y)).hexdigest()) for (i, _), w, g in zip(rows(), texts, covered(texts, 100)))
    got = suffix_dedup.suffix_dedup(docs, window=100, gram=32, most=most).select("doc_id", "n_bytes", "n_removed", "kept_sha256")
    assert Counter(map(tuple, got.collect())) == want


def test_regular_texts_are_not_taken_for_one_another(spark):
    for n in (1024, 2048, 4096):
        a, b = "".join(thue_morse(n, "a", "b")), "".join(thue_morse(n, "b", "a"))
        data, at = bw.texts(pa.array([a + " " + b]), False)
        starts, ends, _ = bw.words(data, at, bw.NOT_SPACE)
        assert len(set(bw.range_hashes(data, starts, ends).tolist())) == 2
        spans = bw.Spans.of_bytes(data)
        assert len(set(spans(starts, np.full(2, n)).tolist())) == 2
    one, two = " ".join(thue_morse(2048, "left", "right")), " ".join(thue_morse(2048, "right", "left"))
    docs = spark.createDataFrame([(1, "".join(thue_morse(1024, "a", "b"))), (2, "".join(thue_morse(1024, "b", "a"))), (3, one), (4, two)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(docs, shingle_words=4).collect()}
    assert got[1] == 1 and got[2] == 2


def test_hashes_of_spans_follow_their_content():
    rng = np.random.RandomState(3)
    data = rng.randint(97, 99, 500).astype(np.uint8)
    spans, raw = bw.Spans.of_bytes(data), data.tobytes()
    for n in (8, 9, 15, 16, 17, 31, 32, 40):
        all_ = spans.all(n)
        assert len(all_) == 500 - n + 1
        assert len(set(all_.tolist())) == len({raw[i : i + n] for i in range(len(all_))})
        assert (spans(np.arange(len(all_)), np.full(len(all_), n)) == all_).all()
    starts = rng.randint(0, 400, 300)
    ends = starts + rng.randint(0, 90, 300)
    found = bw.range_hashes(data, starts, ends).tolist()
    assert len(set(found)) == len({raw[a:b] for a, b in zip(starts, ends)}) and len(set(zip(found, (raw[a:b] for a, b in zip(starts, ends))))) == len(set(found))
    with pytest.raises(ValueError):
        spans.all(7)


def test_a_passage_in_many_contexts_makes_few_windows(spark, monkeypatch):
    """Of the windows around a passage in very many contexts, only those next to its ends are looked at one by one."""
    from reweave.llm import repeats

    rng = random.Random(8)
    say = lambda n: "".join(rng.choices("abcdefgh", k=n))
    passage = say(700)
    texts = [say(600) + passage + say(600) for _ in range(40)] + [say(300) + passage[:450] + say(300), say(300) + passage[:450] + say(300), passage[100:]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tables, keep = {}, repeats.written
    monkeypatch.setattr(repeats, "written", lambda df, name: tables.setdefault(name, keep(df, name)))
    got = suffix_dedup.suffix_dedup(docs, most=3).select("doc_id", "n_bytes", "n_removed", "kept_sha256")
    texts = [t.encode() for t in texts]
    want = {(i, len(t), sum(g), hashlib.sha256(bytes(x for x, y in zip(t, g) if not y)).hexdigest()) for i, (t, g) in enumerate(zip(texts, covered(texts, 400)))}
    assert {tuple(r) for r in got.collect()} == want
    windows = tables["hot"].selectExpr("sum(size(windows))").first()[0]
    assert 0 < tables["each"].count() < windows / 3 and tables["hot"].count() < windows / 8
