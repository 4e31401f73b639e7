"""Suffix-array dedup over bytes.

A suffix array of every byte of the corpus would move many times its size. Here the array is sparse: it holds the
suffixes at content-chosen anchors, of which every window of `window` bytes has one, at the same place in equal windows.

1. Anchors that occur once anywhere are dropped, and with them all windows around them: they can't occur twice.
2. The stretch of windows around each anchor left is counted as a whole. Those that occur twice are done.
3. The other stretches are decided byte by byte. The suffixes at one anchor are sorted with their common prefixes by
   deep-shallow sorting; prefixes to the right and to the left of the anchor give how far any two of them agree.
4. Where more than `most` different stretches share an anchor, their windows are counted (see `repeats`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from reweave.llm import bytewords as bw
from reweave.llm import deep_shallow
from reweave.llm.repeats import STRETCHES, Units, assembled, cut_out, kept_anchors, repeated_ranges, surveyed, with_repeated_anchors

GRAM = 128
BATCH = 1 << 20


def _anchors(data: np.ndarray, at: np.ndarray, window: int, gram: int) -> tuple:
    spans = bw.Spans.of_bytes(data)
    grams = spans.all(gram)
    ok = bw.whole_windows(at, window, len(data))[: len(grams)]
    place, starts, counts = bw.winnow(grams, window - gram + 1, ok)
    return grams[place], place, starts, counts, spans


def _digest(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def _span_hashes(text: bytes, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return bw.Spans.of_bytes(np.frombuffer(text, np.uint8))(starts, lengths)


BYTES = Units(bytes, bytes, bytes, b"", _span_hashes, _digest)


def group_ranges(rows: list[tuple], window: int) -> list[tuple[int, int, int]]:
    """(rid, a, b) of the repeated bytes of the lone rows of one anchor.

    rows: (rid, place, lone, left, right), with the bytes before the anchor reversed and those from it on; all suffixes
    at the anchor. Sorted suffixes have in common what their neighbours between them have.
    """
    order = deep_shallow.sort([r[4] for r in rows])
    out = []
    for x, (i, _) in enumerate(order):
        rid, place, lone, left, _ = rows[i]
        if not lone:
            continue
        for step in (-1, 1):
            common, y = window, x
            while 0 <= y + step < len(order):
                common = min(common, order[y if step < 0 else y + 1][1])
                y += step
                other = rows[order[y][0]]
                before = deep_shallow.common_prefix(left, other[3])
                if before + common >= window:
                    out.append((rid, place - before, place + common))
    return out


def suffix_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = 400, gram: int = GRAM, most: int = 64
) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Removed is each byte of the UTF-8 text covered by a string of `window` bytes that also starts anywhere else, in the
    same text or another; a match never crosses texts. n_spans counts maximal removed runs, kept_sha256 is of the bytes
    left. Null counts as empty; empty tables give no rows. Rows may share an id or have none: each is judged by its own
    text, and rows with equal texts repeat as a whole. A text is held whole in one task, with some tens of its size.
    """

    def survey(column: pa.Array) -> tuple:
        data, at = bw.texts(column, lower=False)
        raw = memoryview(np.ascontiguousarray(data))
        sha = [_digest(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        parts = _parts(at)
        found = [_anchors(data[a:b], c, window, gram)[:3] for a, b, c in parts]
        anchors = np.concatenate([f[0] for f in found]) if found else np.zeros(0, bw.U)
        begin = np.concatenate([f[2] + a for f, (a, _, _) in zip(found, parts)]) if found else np.zeros(0, np.int64)
        return sha, np.diff(at), anchors, np.searchsorted(begin, at)

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bw.small(batches, "text", BATCH):
            data, at = bw.texts(batch.column("text"), lower=False)
            anchors, place, starts, counts, spans = _anchors(data, at, window, gram)
            row = np.searchsorted(at, starts, side="right") - 1
            keep = kept_anchors(batch.column("wanted"), anchors, row, len(at) - 1)
            if keep.any():
                anchors, place, starts, counts, row = (v[keep] for v in (anchors, place, starts, counts, row))
                whole = bw.mix(spans(starts, counts - 1 + window) + (place - starts).astype(bw.U))
                values = [anchors.view(np.int64), whole.view(np.int64), place - at[row], starts - at[row], counts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rid").take(pa.array(row)), *(pa.array(v, pa.int64()) for v in values)],
                    ["rid", "h", "whole", "place", "start", "n_windows"],
                )

    rows, heads, classes = surveyed(docs, id_col, text_col, survey, _digest)
    texts = with_repeated_anchors(rows, classes)
    ranges = repeated_ranges(
        texts, texts.mapInArrow(stretches, STRETCHES), BYTES, lambda group: group_ranges(group, window), window=window, reach=window - gram, most=most
    )
    return assembled(heads, classes, cut_out(texts, ranges, classes, BYTES), window).withColumnRenamed("n", "n_bytes")


def _parts(at: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """Runs of whole texts of about BATCH bytes: (begin, end, the texts' offsets from begin)."""
    cuts, begin = [], 0
    for i in range(1, len(at)):
        if at[i] - at[begin] >= BATCH or i == len(at) - 1:
            cuts.append((int(at[begin]), int(at[i]), at[begin : i + 1] - at[begin]))
            begin = i
    return cuts
