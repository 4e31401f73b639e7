"""Which of many strings occur in which texts: one automaton over the strings, run over each text where it is read."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contained(texts: DataFrame, patterns: DataFrame, key: str = "file", *, max_letters: int = 2_000_000) -> DataFrame:
    """`key` and pattern_iri for each row of `texts` and each distinct pattern that is a substring of its text.

    texts: `key`, text; patterns: pattern_iri. Any string can be a pattern; case counts. Null and empty patterns occur
    nowhere, null texts hold nothing. Patterns are dealt into parts of about `max_letters` characters by their hash; each
    part is one Aho-Corasick automaton in the tasks that read the texts, whole, once for each part. Nothing is shuffled.
    """
    asked = patterns.select("pattern_iri").filter("pattern_iri <> ''").distinct()
    letters = asked.agg(F.sum(F.char_length("pattern_iri"))).first()[0] or 0
    parts = max(1, -(-letters // max_letters))
    kind = dict(texts.dtypes)[key]

    def matches(part: int) -> DataFrame:
        own = asked.filter(F.pmod(F.xxhash64("pattern_iri"), F.lit(parts)) == part)
        shared = texts.sparkSession.sparkContext.broadcast(sorted(r[0] for r in own.collect()))  # about max_letters

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, machine = shared.value, ahocorasick.Automaton()
            for i, word in enumerate(words):
                machine.add_word(word, i)
            machine.make_automaton()
            for batch in batches:
                rows, found = [], []
                for r, text in enumerate(batch.column(1)):
                    held = {i for _, i in machine.iter(text.as_py() or "")} if words else ()
                    rows += [r] * len(held)
                    found += [words[i] for i in held]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], [key, "pattern_iri"])

        return texts.select(key, "text").mapInArrow(scan, f"`{key}` {kind}, pattern_iri string")

    return reduce(lambda a, b: a.unionByName(b), [matches(p) for p in range(parts)])
