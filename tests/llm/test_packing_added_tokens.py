"""Packing of texts that hold a token the vocabulary adds, against `tokenizers` without any switch."""

import random
import zlib
from collections import Counter

from reweave.llm import packing, queries


def test_added_tokens_in_text_are_one_id(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(11)
    parts = ["<|endoftext|>", "<|endoftext", "|>", " ", "  ", "\n", "a", " the", "'s", "12", "é", "日", "<|"]
    texts = ["end of page <|endoftext|> next", "<|endoftext|>", "<|endoftext|><|endoftext|>", "", None] + ["".join(rng.choices(parts, k=20)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = Counter()
    for i, t in enumerate(texts):
        ids = encoder.encode(t or "", add_special_tokens=False).ids + [0]
        for k, (a, n) in enumerate(packing.cut(len(ids), 16)):
            want[i, k, a, n, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a : a + n]))] += 1
    got = packing.best_fit_packing(docs, vocabulary=queries.vocabulary(), capacity=16).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert {r.doc_id: r.length for r in got if r.doc_id < 2} == {0: 7, 1: 2}
