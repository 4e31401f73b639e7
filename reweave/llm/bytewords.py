"""Words and hashes of many texts at once, as numpy arrays.

A batch of texts is one byte array with offsets. Words are runs of bytes of a class, never across texts. Every step of
a hash ends in a mix that is not linear: sums of powers modulo 2**64 would take some regular texts for one another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
#: Odd multipliers; fixed, so that hashes agree between tasks.
FACTORS = np.random.RandomState(20240611).randint(1, 2**63 - 1, 256).astype(U) * U(2) + U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Whitespace words: everything but space and \t to \r.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Letters, digits and every byte of a character beyond ASCII, after lower-casing.
WORDLIKE = np.zeros(256, bool)
WORDLIKE[48:58] = WORDLIKE[97:123] = WORDLIKE[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit over all others."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one integer, zeros after the end; one place more than data has."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, short: int = 64) -> np.ndarray:
    """A hash of each byte range: eight bytes at a time for all ranges together, ranges above `short` bytes one by one."""
    at, size = _eights(data), ends - starts
    out = mix(size.astype(U) * FACTORS[0] + FACTORS[1])
    todo, k = np.flatnonzero((size > 0) & (size <= short)), 0
    while len(todo):
        chunk, rest = at[starts[todo] + k], size[todo] - k
        tail = np.flatnonzero(rest < 8)
        chunk[tail] &= (U(1) << (rest[tail] * 8).astype(U)) - U(1)
        out[todo] = mix(out[todo] ^ (chunk * FACTORS[2]))
        todo, k = todo[rest > 8], k + 8
    if len(long := np.flatnonzero(size > short)):
        raw = memoryview(np.ascontiguousarray(data))
        out[long] = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist())]
    return out


class Spans:
    """Hashes of spans of places: a table of spans of 1, 2, 4, ... leaves, each the mix of its halves.

    A leaf stands for `unit` places. Any span of at least `unit` places is covered by the two largest spans of the
    table that begin and end with it, so it costs two look-ups, whatever its length.
    """

    def __init__(self, leaves: np.ndarray, unit: int = 1):
        self.unit, self.levels = unit, [leaves]

    @classmethod
    def of_bytes(cls, data: np.ndarray) -> Spans:
        return cls(mix(_eights(data)[: max(0, len(data) - 7)] * FACTORS[2] + FACTORS[3]), 8)

    def _level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            last, step = self.levels[-1], self.unit << (len(self.levels) - 1)
            n, odd = max(0, len(last) - step), FACTORS[4 + 2 * len(self.levels) : 6 + 2 * len(self.levels)]
            self.levels.append(mix(last[:n] * odd[0] + last[step : step + n] * odd[1]))
        return self.levels[k]

    def __call__(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The hash of the span of lengths[i] places from starts[i] on; all must lie inside."""
        out, longest = np.zeros(len(starts), U), int(lengths.max()) if len(lengths) else 0
        k = 0
        while self.unit << k <= longest:
            own = np.flatnonzero((lengths >= self.unit << k) & (lengths < self.unit << (k + 1)))
            if len(own):
                level, a, n = self._level(k), starts[own], lengths[own]
                out[own] = mix(level[a] * FACTORS[0] + level[a + n - (self.unit << k)] * FACTORS[1] + n.astype(U) * FACTORS[2])
            k += 1
        return out

    def all(self, length: int) -> np.ndarray:
        """The hash of `length` places from each place on where they fit."""
        if length < self.unit:
            raise ValueError(f"spans must have {self.unit} places at least")
        k = (length // self.unit).bit_length() - 1
        level, step = self._level(k), length - (self.unit << k)
        n = max(0, len(level) - step)
        return mix(level[:n] * FACTORS[0] + level[step : step + n] * FACTORS[1] + U(length * int(FACTORS[2]) % (1 << 64)))


def texts(column: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after another, and where each begins (and the last ends); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return (LOWER[data] if lower else data), at - at[0]


def words(data: np.ndarray, at: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (with the total at the end)."""
    inside = member[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    first, last = at[:-1], at[1:]
    before[first[first < last]] = False
    after[last[first < last] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each `size` consecutive hashes (across texts too: the caller takes those within a text)."""
    return Spans(hashes).all(size)


def small(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of text at most, or one row."""
    for batch in batches:
        sizes = np.diff(texts(batch.column(column), False)[1])
        if not len(sizes):
            continue
        part = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(sizes)]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def whole_windows(at: np.ndarray, length: int, n: int) -> np.ndarray:
    """For each of n places, whether `length` places from there on lie within one text."""
    first, last = at[:-1], at[1:] - length + 1
    long = last > first
    step = np.zeros(n + 1, np.int8)
    step[first[long]] += 1
    step[last[long]] -= 1
    return np.cumsum(step[:n], dtype=np.int8) > 0


def winnow(grams: np.ndarray, width: int, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors: for each window of `width` grams that may start where `ok`, its least gram, the leftmost of equal ones.

    Returns for each run of windows with the same anchor: the anchor's place, the first window's start, and how many
    windows there are. The choice follows from the window's content alone.
    """
    n = len(grams)
    starts = np.flatnonzero(ok)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3
    packed = np.full(-(-n // width) * width + width, np.iinfo(np.uint64).max, U)
    packed[:n] = (grams & U(0xFFFFFFFF00000000)) | np.arange(n, dtype=U)
    blocks = packed.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    anchors = (np.minimum(after[starts], before[starts + width - 1]) & U(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (starts[1:] != starts[:-1] + 1)
    runs = np.flatnonzero(new)
    return anchors[runs], starts[runs], np.diff(np.append(runs, len(starts)))


def lists(values: np.ndarray, cuts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """`values` cut into lists at `cuts`."""
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, kind))
