"""Statistics of texts against plain counts."""

import random

import pyarrow as pa

from reweave.llm import quality


def test_lines_and_words_of_batches():
    rng = random.Random(8)
    texts = [None, "", "\n", "a\n", "a\na", "\n\na b", "x" * 100 + "\n" + "X" * 100] + ["".join(rng.choices("aB \n.", k=rng.randrange(40))) for _ in range(300)]
    got = quality.text_statistics(pa.array(texts, pa.string()))
    at = {name: k for k, name in enumerate(quality.STATISTICS)}
    for t, row in zip(texts, got):
        lines, words = (t or "").lower().split("\n"), (t or "").lower().split()
        assert row[at["n_lines"]] == len(lines) and row[at["distinct_lines"]] == len(set(lines)) / len(lines), t
        assert row[at["line_words"]] == len(words) / len(lines) and row[at["n_words"]] == len(words)
        assert row[at["distinct_words"]] == (len(set(words)) / len(words) if words else 1) and row[at["max_word"]] == max(map(len, words), default=0)
