"""Substring dedup over words by seed and extend.

Winnowed anchors are the seeds: documents meet on anchors that occur more than once, anywhere. Around a seed lies a
stretch, the windows that all have it as their anchor. A stretch that occurs twice as a whole is a repeat. Others are
joined on their seed, one document for each kind of stretch, and every match is extended word by word both ways; what
reaches the length of a window is a repeat. Overlapping repeats merge into maximal ones, and the words they cover are
removed. Where more than `most` kinds share a seed, their windows are counted instead of paired (see `repeats`): a passage
in a million documents is one row after partial aggregation, and its pairs of documents are never listed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from reweave.llm import bytewords as bw
from reweave.llm.repeats import STRETCHES, Units, assembled, cut_out, kept_anchors, repeated_ranges, surveyed, with_repeated_anchors

GRAM = 12


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, at = bw.texts(column, lower=False)
    starts, ends, first = bw.words(data, at, bw.NOT_SPACE)
    return data, at, first, bw.range_hashes(data, starts, ends)


def _digest(text: bytes) -> str:
    return hashlib.sha256(b" ".join(text.split())).hexdigest()


def _span_hashes(text: bytes, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return bw.Spans(_words(pa.array([text], pa.large_binary()))[3])(starts, lengths)


WORDS = Units(bytes.split, b" ".join, bytes.split, b" ", _span_hashes, _digest)


def _anchors(hashes: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    grams = bw.shingles(hashes, gram)
    ok = bw.whole_windows(first, window, len(hashes))[: len(grams)]
    at, starts, counts = bw.winnow(grams, window - gram + 1, ok)
    return grams[at], at, starts, counts


def extend(rows: list[tuple], window: int) -> list[tuple[int, int, int]]:
    """(rid, a, b) of the matches of lone rows with any other row of one seed that are as long as a window.

    rows: (rid, place, lone, left, right), with the words before the seed reversed and those from it on.
    """
    out = []
    for x, (rid, place, lone, left, right) in enumerate(rows):
        for other_rid, other_place, other_lone, other_left, other_right in rows[x + 1 :]:
            if not (lone or other_lone):
                continue
            after = before = 0
            for p, q in zip(right, other_right):
                if p != q:
                    break
                after += 1
            for p, q in zip(left, other_left):
                if p != q:
                    break
                before += 1
            if before + after >= window:
                if lone:
                    out.append((rid, place - before, place + after))
                if other_lone:
                    out.append((other_rid, other_place - before, other_place + after))
    return out


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window_words: int = 35, gram_words: int = GRAM, most: int = 64
) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_words, n_removed, n_spans, kept_sha256.

    Removed is each word covered by `window_words` consecutive words of one text that also start anywhere else, in the
    same text or another. kept_sha256 is of the words left, joined by one space. Words lie between white space and
    are compared unchanged; null and empty texts have none. Empty tables give no rows. Rows may share an id or have
    none: each is judged by its own text, and rows with equal words repeat as a whole.
    """

    def survey(column: pa.Array) -> tuple:
        data, at, first, hashes = _words(column)
        anchors, _, begin, _ = _anchors(hashes, first, window_words, gram_words)
        raw = data.tobytes()
        sha = [_digest(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        return sha, np.diff(first), anchors, np.searchsorted(begin, first)

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bw.small(batches, "text"):
            _, _, first, hashes = _words(batch.column("text"))
            anchors, place, starts, counts = _anchors(hashes, first, window_words, gram_words)
            row = np.searchsorted(first, starts, side="right") - 1
            keep = kept_anchors(batch.column("wanted"), anchors, row, len(first) - 1)
            if keep.any():
                anchors, place, starts, counts, row = (v[keep] for v in (anchors, place, starts, counts, row))
                whole = bw.mix(bw.Spans(hashes)(starts, counts - 1 + window_words) + (place - starts).astype(bw.U))
                values = [anchors.view(np.int64), whole.view(np.int64), place - first[row], starts - first[row], counts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rid").take(pa.array(row)), *(pa.array(v, pa.int64()) for v in values)],
                    ["rid", "h", "whole", "place", "start", "n_windows"],
                )

    rows, heads, classes = surveyed(docs, id_col, text_col, survey, _digest)
    texts = with_repeated_anchors(rows, classes)
    ranges = repeated_ranges(
        texts, texts.mapInArrow(stretches, STRETCHES), WORDS, lambda group: extend(group, window_words),
        window=window_words, reach=window_words - gram_words, most=most,
    )
    return assembled(heads, classes, cut_out(texts, ranges, classes, WORDS), window_words).withColumnRenamed("n", "n_words")
