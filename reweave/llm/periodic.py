"""Periodic runs of words: stretches that repeat with a period, four times or more, and texts without the repeats.

Runs are found on a harmonic grid. A run of period p and length 4p or more has 3p neighbouring places whose words come again
p later, so one of every 3p places lies among them: n / 3p places for each period, in all about n ln(n) / 3. From each that
matches, the longest common extensions to the right and to the left give the run.

Extensions come from a difference cover. Every 16 places five are sampled, such that any two places reach sampled ones by
stepping on together, by 15 steps at most. Only sampled suffixes are sorted, by prefix doubling; the words up to the samples
are compared one by one, and from there on the least common prefix between the two in the sorted order, kept in a sparse
table, says how far they agree. The reversed words give the extensions to the left.

Map-only: each text is read whole, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reweave.llm import bytewords as bw
from reweave.llm.common import own_columns

#: Places sampled in every CYCLE: the differences of two of them are all numbers modulo CYCLE.
CYCLE, COVER = 16, (0, 1, 2, 5, 8)
POINTS = 1 << 18
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _cover_tables() -> tuple[np.ndarray, np.ndarray]:
    """(steps until two places are both sampled, by their remainders; rank of a sampled remainder, else -1)."""
    rank = np.full(CYCLE, -1)
    rank[list(COVER)] = np.arange(len(COVER))
    steps = [[next(d for d in range(CYCLE) if rank[(i + d) % CYCLE] >= 0 and rank[(j + d) % CYCLE] >= 0) for j in range(CYCLE)] for i in range(CYCLE)]
    return np.array(steps), rank


STEPS, RANK = _cover_tables()


class Extensions:
    """Longest common extensions of any two places of a sequence of small integers.

    The sequence must end in a number that it has nowhere else, so that no two suffixes agree to the end."""

    def __init__(self, seq: np.ndarray):
        n = len(seq)
        self.seq = np.concatenate([seq.astype(np.int64), np.full(2 * CYCLE, -1, np.int64)])
        place = np.arange(-(-n // CYCLE) * CYCLE).reshape(-1, CYCLE)[:, list(COVER)].ravel()
        self.place = place = place[place < n]
        m = len(place)
        # names of the first CYCLE numbers of each sampled suffix, in their order
        name, numbers = np.zeros(m, np.int64), int(self.seq.max()) + 2
        for k in range(CYCLE):
            name = np.unique(name * numbers + self.seq[place + k] + 1, return_inverse=True)[1]
        levels, shift = [name], len(COVER)
        while int(name.max(initial=-1)) < m - 1:  # a suffix CYCLE * 2**k on is sampled too: len(COVER) * 2**k samples on
            later = np.zeros(m, np.int64)
            later[: max(0, m - shift)] = name[shift:] + 1
            name = np.unique(name * (m + 1) + later, return_inverse=True)[1]
            levels.append(name)
            shift *= 2
        self.order = name
        suffix = np.argsort(name)
        lengths = self._prefixes(levels, suffix[:-1], suffix[1:])
        self.table = [lengths]
        while 2 << len(self.table) - 1 <= len(lengths):
            half = 1 << len(self.table) - 1
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))

    def _prefixes(self, levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many numbers the sampled suffixes a and b have in common, from the names of their beginnings."""
        a, b, out, m = a.copy(), b.copy(), np.zeros(len(a), np.int64), len(self.place)
        for k in range(len(levels) - 1, -1, -1):
            inside = np.flatnonzero((a < m) & (b < m))
            same = inside[levels[k][a[inside]] == levels[k][b[inside]]]
            a[same] += len(COVER) << k
            b[same] += len(COVER) << k
            out[same] += CYCLE << k
        start = np.append(self.place, len(self.seq) - CYCLE)  # a suffix that ends here has nothing left to compare
        return out + self._few(start[np.minimum(a, m)], start[np.minimum(b, m)], np.full(len(a), CYCLE))

    def _few(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many of the next `most` numbers agree, compared one by one."""
        out, going = np.zeros(len(i), np.int64), np.flatnonzero(most > 0)
        for k in range(int(most.max(initial=0))):
            going = going[most[going] > k]
            going = going[self.seq[i[going] + k] == self.seq[j[going] + k]]
            out[going] += 1
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far the sequence agrees from places i and j on (i and j differ)."""
        step = STEPS[i % CYCLE, j % CYCLE]
        out = self._few(i, j, step)
        far = np.flatnonzero(out == step)
        a, b = i[far] + step[far], j[far] + step[far]
        a, b = (self.order[p // CYCLE * len(COVER) + RANK[p % CYCLE]] for p in (a, b))
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level):
            own = np.flatnonzero(level == k)
            row = self.table[k]
            out[far[own]] += np.minimum(row[low[own]], row[high[own] - (1 << int(k))])
        return out


def _grid(sizes: np.ndarray, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, period, place) of the grid over texts of `sizes` words, about POINTS at a time."""
    top = np.where(sizes >= least, sizes // times, 0)
    cuts = np.concatenate([[0], np.cumsum(top)])
    for a in range(0, int(cuts[-1]), POINTS):
        k = np.arange(a, min(a + POINTS, int(cuts[-1])))
        text = np.searchsorted(cuts, k, side="right") - 1
        period = k - cuts[text] + 1
        step = np.maximum((times - 1) * period, least - period)
        points = (sizes[text] - period + step - 1) // step
        ends = np.cumsum(points)
        begin = 0
        while begin < len(k):
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + POINTS)))
            n = points[begin:end]
            which = np.repeat(np.arange(begin, end), n)
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield text[which], period[which], nth * step[which]
            begin = end


def _between(values: np.ndarray, sizes: np.ndarray, fresh: int) -> tuple[np.ndarray, np.ndarray]:
    """(`values` with a number of its own before, between and after the texts; where each text begins)."""
    cuts = np.cumsum(sizes) - sizes
    out = np.empty(len(values) + len(sizes) + 1, values.dtype)
    at = cuts + np.arange(len(sizes)) + 1
    marks = np.append(at - 1, len(out) - 1)
    inside = np.ones(len(out), bool)
    inside[marks] = False
    out[inside] = values
    out[marks] = np.arange(fresh, fresh + len(marks)).astype(values.dtype)
    return out, at


def _matching(seq: np.ndarray, at: np.ndarray, sizes: np.ndarray, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Grid points whose word and two of its neighbours in a row come again a period later; a run has such a point."""
    for text, period, place in _grid(sizes, least, times):
        i = at[text] + place
        own = np.flatnonzero(seq[i] == seq[i + period])
        text, period, i = text[own], period[own], i[own]
        same = {d: seq[np.clip(i + d, 0, len(seq) - 1)] == seq[np.clip(i + d + period, 0, len(seq) - 1)] for d in (-2, -1, 1, 2)}
        own = (same[1] & same[2]) | (same[-1] & same[-2]) | (same[-1] & same[1])
        if own.any():
            yield text[own], period[own], i[own]


def find_runs(texts: list[list], hashes: np.ndarray, least: int = 6, times: int = 4) -> dict[int, np.ndarray]:
    """Index of a text -> its runs, as rows (start, length, period) in the order of start and period; texts without are absent.

    texts: lists of words; hashes: a hash of each word of all texts. The hashes find texts worth a closer look, the words
    themselves decide."""
    sizes = np.array([len(t) for t in texts], np.int64)
    seq, at = _between(hashes, sizes, 0)
    closer = np.unique(np.concatenate([np.zeros(0, np.int64)] + [np.unique(f[0]) for f in _matching(seq, at, sizes, least, times)]))
    if not len(closer):
        return {}
    number: dict = {}
    values = np.array([number.setdefault(w, len(number)) for t in closer for w in texts[t]], np.int64)
    sizes = sizes[closer]
    seq, at = _between(values, sizes, len(number))
    right, left, n = Extensions(seq), Extensions(seq[::-1]), len(seq)
    found = []
    for text, period, i in _matching(seq, at, sizes, least, times):
        j = i + period
        start = i - left(n - i, n - j)
        end = j + right(i, j)
        own = end - start >= np.maximum(least, times * period)
        found.append(np.stack([text[own], start[own] - at[text[own]], (end - start)[own], period[own]], axis=1))
    rows = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 4), np.int64)
    # multiples of the smallest period give the same stretch again: the first of equal stretches has it
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    rows = rows[first]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    return {int(closer[t]): rows[rows[:, 0] == t, 1:] for t in np.unique(rows[:, 0])}


def collapse(words: list, runs: np.ndarray) -> list:
    """The words without those that a run holds after its first period."""
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def periodic_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    least_words: int = 6,
    times: int = 4,
    rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_words, runs (start, length, period, by start, then period), collapsed.

    A run is a stretch of consecutive words with smallest period q (words q apart are identical), of at least `times` * q and
    `least_words` words, that no neighbouring word extends keeping period q. collapsed is the text without the words that a
    run holds after its first q, joined by one space. Words lie between white space and are compared unchanged. `rewrite`
    gets each row's id and words and gives the words to search instead. Null, empty and blank texts have no words and no
    runs; repeated rows are searched each for itself; empty tables give no rows. A text is held whole in one task, with some
    hundred bytes for each word of a text that repeats anything.
    """
    if times < 4:
        raise ValueError("times must be 4 or more: the grid's first look needs three matching words in a row")
    rows = own_columns(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bw.small(batches, "text", 1 << 20):
            data, at = bw.texts(batch.column("text"), lower=False)
            raw = data.tobytes()
            texts = [raw[a:b].split() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            if rewrite is not None:
                texts = [rewrite(i, t) for i, t in zip(batch.column("doc_id").to_pylist(), texts)]
            lines = [b" ".join(t) for t in texts]
            data, at = bw.texts(pa.array(lines, pa.large_binary()), lower=False)
            starts, ends, _ = bw.words(data, at, bw.NOT_SPACE)
            found = find_runs(texts, bw.range_hashes(data, starts, ends), least_words, times)
            for t, runs in found.items():
                lines[t] = b" ".join(collapse(texts[t], runs))
            counts = np.array([len(found[t]) if t in found else 0 for t in range(len(texts))], np.int64)
            all_runs = np.concatenate([found[t] for t in sorted(found)]) if found else np.zeros((0, 3), np.int64)
            values = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c), pa.int64()) for c in all_runs.T], ["start", "length", "period"])
            cuts = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            columns = [batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.ListArray.from_arrays(cuts, values)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(run, SCHEMA)


def most_repeated(runs: Column) -> Column:
    """The run with the greatest length / period, the first of equal ones; null without runs."""
    more = lambda best, r: r["length"] * best["period"] > best["length"] * r["period"]
    return F.reduce(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(more(best, r), r).otherwise(best))
