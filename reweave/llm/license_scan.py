"""License scans: exact phrases, and short notices with a bounded number of edits.

Each notice is split into one piece more than the edits it may have, so that one piece at least occurs unchanged
wherever the notice does (pigeonhole). Occurrences of the pieces give the windows. As an edit changes four of a notice's
runs of four letters at most, a window that lacks more of them than the edits allow is passed over: pieces that are everyday
words cost little. In the other windows the regex library's bounded-error matching verifies the notice and reports its span
and edits.

Map-only: each text is scanned where it is read, whole, and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from reweave.llm import bytewords as bw
from reweave.llm.common import own_columns

PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
NOTICES = {
    "licensed under the gnu general public license": "notice-gpl",
    "licensed under the apache license version": "notice-apache",
    "released under the mit license": "notice-mit",
    "permission is hereby granted free of charge": "notice-mit",
    "redistribution and use in source and binary forms": "notice-bsd",
    "mozilla public license": "notice-mpl",
    "eclipse public license": "notice-epl",
    "boost software license": "notice-boost",
    "gnu lesser general public license": "notice-lgpl",
    "gnu affero general public license": "notice-agpl",
    "the software is provided as is without warranty of any kind": "notice-mit",
    "permission to use copy modify and or distribute this software": "notice-isc",
    "this is free and unencumbered software released into the public domain": "notice-unlicense",
    "neither the name of the copyright holder nor the names of its contributors": "notice-bsd",
    "unless required by applicable law or agreed to in writing": "notice-apache",
    "creative commons attribution": "notice-cc",
    "all rights reserved": "notice-reserved",
}
GRAM, MOST = 4, 4096
_SPACE = bytes(b if bw.WORDLIKE[b] else 32 for b in bw.LOWER.tolist())
_SEP = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label: string, first_word: long, n_words: long, edits: long>>"
)


def split_seeds(notice: str, edits: int) -> list[tuple[bytes, int]]:
    """The notice in edits + 1 pieces of about the same length, each with its place."""
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(notice[a:b].encode(), a) for a, b in zip(cuts, cuts[1:])]


class Fuzzy:
    """Finds one notice in normalised text with at most `edits` insertions, deletions or substitutions."""

    def __init__(self, notice: str, label: str, edits: int):
        self.notice, self.label, self.edits, self.seeds = notice, label, edits, split_seeds(notice, edits)
        body = rb"(?<=^| )(?:" + re.escape(notice.encode()) + rb"){e<=%d}(?=$| )" % edits
        self.pattern = regex.compile(rb"(?b)" + body)
        text = notice.encode()
        self.grams = [text[i : i + GRAM] for i in range(len(text) - GRAM + 1)]

    def likely(self, window: bytes) -> bool:
        """Whether the window has as many of the notice's grams as any occurrence of the notice must have."""
        spare = GRAM * self.edits
        for gram in self.grams:
            if gram not in window:
                spare -= 1
                if spare < 0:
                    return False
        return True

    def windows(self, text: bytes) -> list[list[int]]:
        found = []
        for seed, offset in self.seeds:
            at = text.find(seed)
            while at >= 0:
                a, b = max(0, at - offset - self.edits - 1), at - offset + len(self.notice) + self.edits + 1
                if self.likely(text[a:b]):
                    found.append((a, b))
                at = text.find(seed, at + 1)
        merged: list[list[int]] = []
        for a, b in sorted(found):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        return merged

    def search(self, text: bytes) -> list[tuple[int, int, int]]:
        """(start, end, edits) of each occurrence in text order: the best of a window, then those before and after it.

        Windows that overlap are one. One of more than MOST bytes is read in pieces of that size; a piece begins a notice's
        length before the end of the one before, or where its last occurrence ends, so that none is cut or told twice."""
        out = []
        for a, b in self.windows(text):
            b, reach = min(b, len(text)), len(self.notice) + 2 * self.edits + 2
            while b - a > MOST:
                end = a + MOST
                found = [f for f in self._inside(text, a, end) if f[0] < end - reach]
                out += found
                a = max([end - reach, *(f[1] for f in found)])
            out += self._inside(text, a, b)
        return sorted(out)

    def _inside(self, text: bytes, a: int, b: int) -> list[tuple[int, int, int]]:
        out, todo = [], [(a, b)]
        while todo:
            a, b = todo.pop()
            if m := self.pattern.search(text, a, b):
                out.append((m.start(), m.end(), sum(m.fuzzy_counts)))
                todo.append((max(m.end(), m.start() + 1), b))
                if m.start() - 1 - a >= len(self.notice) - self.edits:
                    todo.append((a, m.start() - 1))  # up to the space before it
        return out


def license_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    phrases: dict[str, str] = PHRASES,
    notices: dict[str, str] = NOTICES,
    letters_per_edit: int = 9,
) -> DataFrame:
    """One row for each row of `docs`, with the places of phrases and the spans of notices.

    Null texts count as empty: no words, no labels, score 0. Repeated rows are scanned each for itself; empty tables give no
    rows. A notice may have one edit for each `letters_per_edit`
    letters. The score is 1 with a phrase, else the best 1 - edits / letters of a notice, else 0.
    """
    exact = [
        (re.compile(rb"(?<![0-9a-z\x80-\xff])" + _SEP.join(w.encode() for w in p.split()) + rb"(?![0-9a-z\x80-\xff])"), p.split()[0].encode(), p.split()[-1].encode(), label)
        for p, label in phrases.items()
    ]
    fuzzy = [Fuzzy(n, label, len(n) // letters_per_edit) for n, label in notices.items()]

    def scan(low: bytes, starts: np.ndarray) -> tuple:
        places, labels, mine, best = [], set(), [], 0.0
        for pattern, first, last, label in exact:
            if first in low and last in low:
                for m in pattern.finditer(low):
                    places.append(int(np.searchsorted(starts, m.start())))
                    labels.add(label)
        plain = b" ".join(low.translate(_SPACE).split())
        for notice in fuzzy:
            for a, b, edits in notice.search(plain):
                mine.append({"label": notice.label, "first_word": plain.count(b" ", 0, a), "n_words": plain.count(b" ", a, b) + 1, "edits": edits})
                best = max(best, 1 - edits / len(notice.notice))
        both = labels | {s["label"] for s in mine}
        return len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(both)), 1.0 if places else best, mine

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bw.small(batches, "text"):
            data, at = bw.texts(batch.column("text"), lower=True)
            starts, _, first = bw.words(data, at, bw.WORDLIKE)
            raw = data.tobytes()
            rows = [scan(raw[a:b], starts[i:j] - a) for a, b, i, j in zip(at, at[1:], first, first[1:])]
            columns = list(zip(*rows))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), SPANS]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(first), pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    return own_columns(docs, doc_id=id_col, text=text_col).mapInArrow(run, SCHEMA)


SPANS = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int64())]))
