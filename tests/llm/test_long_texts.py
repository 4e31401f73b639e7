"""Very long texts: unbroken runs, repeated words and long messages."""

import hashlib
import random
import zlib

import pytest

from reweave.llm import chat_format, decontaminate, packing, quality, token_counts
from reweave.llm.queries import vocabulary


def plain_count(word: bytes, costs: dict[bytes, int]) -> tuple[int, int]:
    """(pieces, cost) of the cheapest cut, place by place."""
    longest, best = max(map(len, costs)), [(0, 0)]
    for end in range(1, len(word) + 1):
        best.append(min((best[a][0] + costs[word[a:end]], best[a][1] + 1) for a in range(max(0, end - longest), end) if word[a:end] in costs))
    return best[-1][1], best[-1][0]


def test_long_pretokens_are_counted_as_a_plain_table_does():
    rng = random.Random(5)
    costs = {bytes([b]): rng.randint(50, 90) for b in b"abc"} | {bytes(rng.choices(b"abc", k=rng.randint(2, 9))): rng.randint(60, 150) for _ in range(60)}
    base = bytes(rng.choices(b"abc", k=3 * token_counts.DEPTH))
    cuts = (1, token_counts.DEPTH - 1, token_counts.DEPTH, token_counts.DEPTH + 1, 2 * token_counts.DEPTH, len(base))
    words = list({base[:n] + tail for n in cuts for tail in (b"", b"a", b"cab", base[:300])})
    assert token_counts.UnigramTrie(costs).counts(words) == {w: plain_count(w, costs) for w in words}


def test_token_counts_of_an_unbroken_run(spark):
    rng = random.Random(6)
    run = "".join(rng.choices("abcdefgh", k=400_000))
    docs = spark.createDataFrame([(1, run), (2, run[:1000]), (3, "word " * 200_000)], "doc_id long, text string")
    found = {r.doc_id: r for r in token_counts.token_counts(docs, vocabulary=vocabulary()).collect()}
    costs = token_counts.read_pieces(vocabulary())
    assert (found[1].n_chars, found[1].n_pretokens) == (400_000, 1)
    assert (found[2].n_tokens, found[2].cost) == plain_count(run[:1000].encode(), {p: c for p, c in costs.items() if len(p) < 40})
    assert found[1].n_tokens > found[2].n_tokens * 300 and found[3].n_pretokens == 200_001


def test_packing_of_a_long_text(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    text = " ".join(f"w{i % 977} é{i % 31}" for i in range(150_000))
    docs = spark.createDataFrame([(1, text), (2, None), (3, "short")], "doc_id long, text string")
    rows = packing.best_fit_packing(docs, vocabulary=vocabulary(), with_ids=True).collect()
    own = sorted((r for r in rows if r.doc_id == 1), key=lambda r: r.piece)
    ids = [i for r in own for i in r.ids]
    assert ids == Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids + [0]
    assert all(r.length == 2048 for r in own[1:]) and [r.start for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
    assert len(rows) == len(own) + 2


@pytest.mark.parametrize("filler", ["word", "which of the following"])
def test_an_item_inside_a_long_text_is_found(spark, filler):
    item = "which of the following planets has the longest day and the shortest year of all"
    text = f"{filler} " * 60_000
    half = len(text) // 2 // (len(filler) + 1) * (len(filler) + 1)
    docs = spark.createDataFrame([(1, text[:half] + item + " " + text[half:]), (2, text), (3, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.keep_clean(docs, bench).orderBy("doc_id").collect()] == [2, 3]


def test_quality_of_a_long_text_is_that_of_its_statistics(spark):
    rows = [(i, ("good plain words stand here. " if i % 2 else "$$ !! %% ") * (1 + i % 7), i % 2) for i in range(60)]
    rows += [(100, "good plain words stand here. " * 40_000, 1), (101, "$" * 1_000_000, 0)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows[:60]], "doc_id long, quality int")
    found = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(found) == 62 and all(0 <= r.score <= 1 for r in found.values())
    assert found[100].held_out == (zlib.crc32(b"100") % 4 == 2) and found[101].predicted == 0


def test_chat_of_a_long_message_reads_back(spark):
    text = "### Assistant: </turn> \\h " * 50_000
    role, start, end = chat_format.render_turn("assistant", text)
    assert chat_format.read_turns(role) == [("assistant", text)] and chat_format.unescape(role[start:end]) == text
    events = spark.createDataFrame([(1, 0, 0, i, "delta", "user", text[i::4]) for i in range(4)], "conv_id long, turn int, message int, seq int, kind string, role string, text string")
    (message,) = chat_format.fold(events).collect()
    whole = "".join(text[i::4] for i in range(4))
    assert hashlib.sha256(message.text.encode()).digest() == hashlib.sha256(whole.encode()).digest()


def test_chat_of_empty_logs_and_null_ids(spark):
    kinds = "conv_id long, turn int, message int, seq int, kind string, role string, text string"
    none = chat_format.render(chat_format.fold(spark.createDataFrame([], kinds)))
    assert none.collect() == [] and chat_format.digest(none).collect() == []
    rows = [(None, 0, 0, 0, "delta", "user", "a"), (None, 0, 0, 1, None, None, None), (None, 1, 1, 0, "delta", "assistant", "b"), (5, 0, 0, 0, "delta", "user", "c")]
    folded = chat_format.fold(spark.createDataFrame(rows, kinds))
    assert sorted((r.conv_id or 0, r.message, r.role, r.text) for r in folded.collect()) == [(0, 0, "user", "a"), (0, 1, "assistant", "b"), (5, 0, "user", "c")]
    assert {r.conv_id: r.n_turns for r in chat_format.digest(chat_format.render(folded)).collect()} == {None: 2, 5: 1}
