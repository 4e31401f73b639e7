"""Best-fit packing of tokenized documents into sequences of fixed length, by pattern packing.

1. Each document is tokenized where it is read and cut only if it is longer than a sequence.
2. The histogram of piece lengths (at most `capacity` numbers, whatever the corpus) goes to the driver. Patterns of a
   few lengths that fill a sequence are enumerated, and non-negative least squares finds how often to repeat each so
   that together they use up the histogram. Repeat counts are rounded down; what is left is packed best-fit decreasing.
3. A piece's rank among the pieces of its length says which repeat of which pattern takes it: a look-up in a table
   bounded by the number of patterns. Documents never meet in one task.
"""

from __future__ import annotations

import base64
import itertools
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reweave.llm import bytewords as bw
from reweave.llm.common import own_columns, written

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def added_tokens(path: str) -> dict[str, int]:
    """The tokens that the `tokenizers` form of the vocabulary, if it lies beside the file at `path`, finds in text before any merge."""
    whole = os.path.splitext(path)[0] + ".json"
    if not os.path.exists(whole):
        return {}
    with open(whole, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def encoding(path: str, added: dict[str, int] | None = None):
    """The byte-level BPE whose pieces and ranks are in the file at `path`, with added tokens."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added or {})


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, and before them a shorter one if need be."""
    if length <= capacity:
        return [(0, length)]
    head = length % capacity
    starts = ([0] if head else []) + list(range(head, length, capacity))
    return [(a, b - a) for a, b in zip(starts, starts[1:] + [length])]


def pieces(
    docs: DataFrame, id_col: str, text_col: str, *, vocabulary: str, capacity: int, end_id: int = 0, with_ids: bool = False
) -> DataFrame:
    """The pieces of all documents, with their rank among those of the same length in the same partition."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long"
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("local_rank", pa.int64())]
    if with_ids:
        schema, fields = schema + ", ids array<int>", [*fields, ("ids", pa.list_(pa.int32()))]

    added = added_tokens(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = encoding(vocabulary, added), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in bw.small(batches, "text"):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.append(np.asarray(encoder.encode_to_numpy(text or "", allowed_special="all", disallowed_special=()), "<u4"), np.uint32(end_id))
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    own = ids[start : start + length]
                    row = (doc, k, start, length, zlib.crc32(own.tobytes()), part, int(seen[length]))
                    rows.append((*row, own.astype(np.int32)) if with_ids else row)
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows), fields)], [n for n, _ in fields])

    return own_columns(docs, doc_id=id_col, text=text_col).mapInArrow(run, schema)


def patterns(counts: np.ndarray, capacity: int, most: int = 6000) -> list[tuple[int, ...]]:
    """Multisets of two or three lengths that fill a sequence exactly, the likeliest first, and single full ones."""
    have = np.flatnonzero(counts[: capacity + 1])
    have = have[have > 0]
    found: dict[tuple[int, ...], float] = {}
    share = counts / max(1, counts.sum())
    for a in have.tolist():
        rest = capacity - a
        if rest == 0:
            found[(a,)] = 2.0
        elif rest <= a and counts[rest]:
            found[(a, rest)] = 1.0 + share[a] * share[rest]
    common = have[np.argsort(-counts[have], kind="stable")][:400]
    for a, b in itertools.combinations_with_replacement(sorted(common.tolist(), reverse=True), 2):
        c = capacity - a - b
        if 0 < c <= b and counts[c]:
            found[(a, b, c)] = float(share[a] * share[b] * share[c])
    return sorted(found, key=lambda p: (-found[p], p))[:most]


def non_negative_least_squares(bins: list[tuple[int, ...]], target: np.ndarray, sweeps: int = 25) -> np.ndarray:
    """x >= 0 that brings the sum of x[i] for each mention of a bin in bins[i] closest to `target`, by coordinate descent.

    A bin weighs as much as its length squared: a long piece left over needs room that short ones can share.
    """
    x, left = np.zeros(len(bins)), target.astype(float).copy()
    uses = [np.unique(p, return_counts=True) for p in bins]
    weighed = [m * (a / len(target)) ** 4 for a, m in uses]
    norms = [float((m * w).sum()) for (_, m), w in zip(uses, weighed)]
    for _ in range(sweeps):
        for i, (at, times) in enumerate(uses):
            new = max(0.0, x[i] + float(left[at] @ weighed[i]) / norms[i])
            if new != x[i]:
                left[at] -= (new - x[i]) * times
                x[i] = new
    return x


def _best_fit(left: np.ndarray, first: int, capacity: int) -> dict[int, int]:
    """One sequence from the lengths left: the longest, then one or two that fill it exactly, or else the longest that fits."""
    times, room, own = {first: 1}, capacity - first, left.copy()
    own[first] -= 1
    while room and (fit := np.flatnonzero(own[: room + 1])).size:
        larger = fit[(fit * 2 >= room) & (fit < room)]
        exact = larger[(own[room - larger] > 0) & ((larger * 2 != room) | (own[larger] > 1))]
        if own[room]:
            chosen = [room]
        elif exact.size:
            chosen = [int(exact[-1]), room - int(exact[-1])]
        else:
            chosen = [int(fit[-1])]
        for n in chosen:
            times[n] = times.get(n, 0) + 1
            own[n] -= 1
            room -= n
    return times


def plan(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Sequences for a histogram of lengths: [({length: times}, repeats)], which use up each length exactly."""
    left, out = counts.astype(np.int64).copy(), []
    shapes = patterns(left, capacity)
    for shape, x in zip(shapes, non_negative_least_squares(shapes, left)):
        times = {n: shape.count(n) for n in set(shape)}
        repeats = min(int(x + 1e-9), *(int(left[n]) // k for n, k in times.items()))
        if repeats > 0:
            out.append((times, repeats))
            for n, k in times.items():
                left[n] -= k * repeats
    while (have := np.flatnonzero(left)).size:
        times = _best_fit(left, int(have[-1]), capacity)
        repeats = min(int(left[n]) // k for n, k in times.items())
        out.append((times, repeats))
        for n, k in times.items():
            left[n] -= k * repeats
    return out


def best_fit_packing(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str, capacity: int = 2048, with_ids: bool = False
) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids on request).

    Pieces of a sequence lie one after another from offset 0. A null or empty text is one piece that holds the end
    id only. Repeated rows are packed each for itself; an empty table gives no rows.
    """
    cut_up = written(pieces(docs, id_col, text_col, vocabulary=vocabulary, capacity=capacity, with_ids=with_ids), "pieces")
    by_part = cut_up.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    counts = np.zeros(capacity + 1, np.int64)
    for row in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[row["length"]] = row["n"]
    slots, taken, base = [], np.zeros(capacity + 1, np.int64), 0
    for times, repeats in plan(counts, capacity):
        offset = 0
        for length, k in times.items():
            slots.append((length, int(taken[length]), int(taken[length]) + k * repeats, repeats, base, offset))
            taken[length] += k * repeats
            offset += length * k
        base += repeats
    table = docs.sparkSession.createDataFrame(
        slots, "slot_length long, first_rank long, end_rank long, repeats long, base long, first_offset long"
    )
    ranked = cut_up.join(first, ["part", "length"]).withColumn("rank", F.col("before") + F.col("local_rank"))
    # the table of slots has a few rows for each pattern and each length: bounded by `capacity` and `most`
    placed = ranked.join(
        F.broadcast(table),
        (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank")),
    )
    own = F.col("rank") - F.col("first_rank")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("base") + own % F.col("repeats")).alias("sequence_id"),
        (F.col("first_offset") + F.floor(own / F.col("repeats")) * F.col("length")).alias("offset"),
        *(["ids"] if with_ids else []),
    )
