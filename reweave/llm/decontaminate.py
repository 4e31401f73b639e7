"""Benchmark decontamination by greedy string tiling.

Five-word seeds of the benchmark are joined with every whole text where it is read. Only words of an item that lie in seeds
found in the text can be covered; that bounds the coverage, and items are taken by falling bound, until neither the threshold
nor the best coverage so far can be reached. Such a text and item are tiled by running Karp-Rabin: at a falling match length, rolling hashes over the item's unmarked words are looked
up with those over the text's, hits are checked and extended on words, and the longest match is marked again and again
until none of five words is left. The share of the item's words that is marked is its coverage, whatever the order of the
tiles, so that reordered passages are caught.

The seed table goes to the tasks only as long as it has at most `max_seeds` rows. A larger benchmark is split into parts
by a hash of the item, each within that bound, and the texts are scanned once for each part; nothing is dropped.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reweave.llm import bytewords as bw
from reweave.llm.common import own_columns, row_ids, written

SEED_WORDS = 5


def word_list(data: bytes) -> list[bytes]:
    """The words of a text that is already lower-cased."""
    return data.translate(_SPACE).split()


_SPACE = bytes(b if bw.WORDLIKE[b] else 32 for b in range(256))


_PRIME, _BASE = (1 << 61) - 1, 0x1F35C9A7D1E3B5


def _rolled(words: list, marked: bytearray, size: int, number: dict) -> Iterator[tuple[int, int, object]]:
    """(place, hash of `size` words from it on, the unmarked word before it or None) of each run of unmarked words."""
    top = pow(_BASE, size - 1, _PRIME)
    a, end = 0, len(words)
    while a < end:
        if marked[a]:
            a += 1
            continue
        b = marked.find(b"\1", a)
        b = end if b < 0 else b
        if b - a >= size:
            h = 0
            for w in words[a : a + size]:
                h = (h * _BASE + number[w]) % _PRIME
            yield a, h, None
            for k in range(a + 1, b - size + 1):
                h = ((h - number[words[k - 1]] * top) * _BASE + number[words[k + size - 1]]) % _PRIME
                yield k, h, words[k - 1]
        a = b


def _matches(item: list, text: list, in_item: bytearray, in_text: bytearray, size: int, number: dict) -> list[tuple[int, int, int]]:
    """(-length, start in item, start in text) of all matches of at least `size` unmarked words that can't be extended.

    A hit counts only where the words before differ, so that a text of one repeated word has few of them."""
    places: dict[int, dict] = defaultdict(lambda: defaultdict(list))
    for i, h, before in _rolled(item, in_item, size, number):
        places[h][before].append(i)
    out = []
    for j, h, before in _rolled(text, in_text, size, number):
        for other, starts in places.get(h, {}).items():
            if other is not None and other == before:
                continue
            for i in starts:
                if item[i : i + size] == text[j : j + size]:
                    n = size
                    while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and not in_item[i + n] and not in_text[j + n]:
                        n += 1
                    out.append((-n, i, j))
    return out


def tile(item: list, text: list, least: int = SEED_WORDS, first: int = 20) -> list[tuple[int, int, int]]:
    """(start in item, start in text, length) of greedy tiles, longest first; ties go to the smaller starts.

    None in `text` stands for a gap and matches nothing.
    """
    number = {w: k + 1 for k, w in enumerate(dict.fromkeys([*item, *text]))}
    in_item, in_text = bytearray(len(item)), bytearray(w is None for w in text)
    out: list[tuple[int, int, int]] = []
    size = max(least, first)
    while True:
        heap = _matches(item, text, in_item, in_text, size, number)
        if heap and -min(heap)[0] > 2 * size:  # begin again at the length of the longest match
            size = -min(heap)[0]
            continue
        heapq.heapify(heap)
        while heap:
            n, i, j = heapq.heappop(heap)
            n = -n
            free = [not (in_item[i + k] or in_text[j + k]) for k in range(n)]
            if all(free):
                out.append((i, j, n))
                in_item[i : i + n] = in_text[j : j + n] = b"\1" * n
                continue
            k = 0
            while k < n:  # what is left of the match between marked words
                if not free[k]:
                    k += 1
                    continue
                a = k
                while k < n and free[k]:
                    k += 1
                if k - a >= size:
                    heapq.heappush(heap, (a - k, i + a, j + a))
        if size == least:
            return out
        size = max(least, size // 2)


def near_seeds(hits: np.ndarray, n_words: int, reach: int) -> list[tuple[int, int]]:
    """Ranges of words within `reach` of a seed, merged. Between ranges no word can be part of a tile."""
    out: list[list[int]] = []
    for h in hits.tolist():
        a, b = max(0, h - reach), min(n_words, h + SEED_WORDS + reach)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def coverage(docs: DataFrame, benchmark: DataFrame, *, threshold: float = 0.8, max_seeds: int = 1_000_000) -> DataFrame:
    """doc_id, item_id, covered, item_words, tiles and share of pairs of rows that share a seed.

    For each row of `docs` these are the pairs with a share of `threshold` or more and a pair with the largest share, from
    each part of the benchmark. Both tables have the columns doc_id or item_id, and text. Items of fewer than five words count
    as one seed of that length; items without words match nothing. The join with the seeds is a look-up in a table of at most
    `max_seeds` rows that each task holds.
    """
    total = benchmark.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n"), F.count(F.lit(1)).alias("k")).first()
    parts = max(1, -(-(int(total["n"] or 0) // 2 + int(total["k"])) // max_seeds))
    found = None
    for part in range(parts):
        own = benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        rows = [(r["item_id"], (r["text"] or "").encode()) for r in own.collect()]  # bounded by max_seeds
        one = _cover(docs, rows, threshold)
        found = one if found is None else found.unionByName(one)
    return found


class Seeds:
    """The seeds of some items: which items have a seed, and where.

    hashes: the distinct seeds, sorted; cuts, item, place: the items and places of the seed i are those from cuts[i] to
    cuts[i + 1]; own: the seeds of each item at its places."""

    def __init__(self, items: list[list[bytes]]):
        self.items, self.size = items, np.array([min(SEED_WORDS, len(w)) for w in items], np.int64)
        data, at = bw.texts(pa.array([b" ".join(w) for w in items], pa.large_binary()), lower=True)
        starts, ends, first = bw.words(data, at, bw.WORDLIKE)
        hashes = bw.range_hashes(data, starts, ends)
        by_size = {s: bw.shingles(hashes, s) for s in set(self.size.tolist()) - {0}}
        each = [by_size[s][a : b - s + 1] if s else np.zeros(0, bw.U) for s, a, b in zip(self.size.tolist(), first[:-1].tolist(), first[1:].tolist())]
        item = np.repeat(np.arange(len(items)), [len(e) for e in each])
        place = np.concatenate([np.zeros(0, np.int64)] + [np.arange(len(e)) for e in each])
        self.hashes, seed = np.unique(np.concatenate([np.zeros(0, bw.U), *each]), return_inverse=True)
        order = np.argsort(seed, kind="stable")
        self.item, self.place = item[order], place[order]
        self.cuts = np.searchsorted(seed[order], np.arange(len(self.hashes) + 1))
        self.own = np.split(seed, np.cumsum([len(e) for e in each])[:-1]) if items else []
        self.sizes = sorted(by_size)
        self.flags = np.zeros(1 << 20, bool)
        self.flags[(self.hashes >> bw.U(44)).astype(np.int64)] = True

    def bounds(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items that have any of the seeds `found` (distinct), and how many of their words lie in these seeds at most."""
        n = self.cuts[found + 1] - self.cuts[found]
        at = np.arange(n.sum()) + np.repeat(self.cuts[found] - (np.cumsum(n) - n), n)
        order = np.lexsort((self.place[at], self.item[at]))
        item, place = self.item[at][order], self.place[at][order]
        new = np.append(True, item[1:] != item[:-1])
        covers = self.size[item]
        covers[:-1] = np.where(new[1:], covers[:-1], np.minimum(covers[:-1], place[1:] - place[:-1]))
        begin = np.flatnonzero(new)
        return item[begin], np.add.reduceat(covers, begin)


def _cover(docs: DataFrame, rows: list[tuple[int, bytes]], threshold: float) -> DataFrame:
    ids, items = [i for i, _ in rows], [word_list(t.lower()) for _, t in rows]
    shared = docs.sparkSession.sparkContext.broadcast((ids, Seeds(items)))  # at most max_seeds rows

    def tiled(words: list[bytes], places: np.ndarray, found: np.ndarray, seeds: Seeds) -> Iterator[tuple]:
        """(item, covered, item_words, tiles, share), items by falling bound of the share, until neither the threshold nor
        the best share so far can be reached."""
        item, bound = seeds.bounds(np.unique(found))
        length = np.array([len(seeds.items[k]) for k in item.tolist()])
        best = (0.0, None)
        for x in np.lexsort((item, -bound / length)).tolist():
            k, n = int(item[x]), int(length[x])
            if bound[x] / n < threshold and bound[x] / n <= best[0]:
                break
            text: list = []
            for a, b in near_seeds(places[np.isin(found, seeds.own[k])], len(words), n):
                text += [*words[a:b], None]  # None equals no word
            tiles = tile(seeds.items[k], text, min(SEED_WORDS, n))
            covered = sum(m for _, _, m in tiles)
            one = (k, covered, n, len(tiles), covered / n)
            if covered / n >= threshold:
                yield one
            if covered / n > best[0]:
                best = (covered / n, one)
        if best[1] and best[0] < threshold:
            yield best[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, seeds = shared.value
        for batch in bw.small(batches, "text"):
            data, at = bw.texts(batch.column("text"), lower=True)
            starts, ends, first = bw.words(data, at, bw.WORDLIKE)
            hashes = bw.range_hashes(data, starts, ends)
            hits = []
            for size in seeds.sizes:
                own = bw.shingles(hashes, size)
                word = np.flatnonzero(seeds.flags[(own >> bw.U(44)).astype(np.int64)])
                seed = np.searchsorted(seeds.hashes, own[word])
                known = seeds.hashes[np.minimum(seed, len(seeds.hashes) - 1)] == own[word]
                word, seed = word[known], seed[known]
                row = np.searchsorted(first, word, side="right") - 1
                inside = word + size <= first[row + 1]
                hits.append(np.stack([row[inside], word[inside] - first[row[inside]], seed[inside]]))
            row, place, seed = np.concatenate(hits, axis=1) if hits else np.zeros((3, 0), np.int64)
            order = np.lexsort((place, row))
            row, place, seed = row[order], place[order], seed[order]
            out = []
            for r in np.unique(row).tolist():
                a, b = np.searchsorted(row, [r, r + 1])
                words = word_list(data[at[r] : at[r + 1]].tobytes())
                for k, *told in tiled(words, place[a:b], seed[a:b], seeds):
                    out.append((batch.column("doc_id")[r].as_py(), ids[k], *told))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
                names = ["doc_id", "item_id", "covered", "item_words", "tiles", "share"]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], names)

    return docs.mapInArrow(run, "doc_id long, item_id long, covered long, item_words long, tiles long, share double")


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    item_col: str = "item_id",
    threshold: float = 0.8,
    max_seeds: int = 1_000_000,
) -> DataFrame:
    """One row for each document that shares a seed with the benchmark: doc_id, contaminated, n_items, share, items.

    A document is contaminated if an item's words are covered by at least `threshold`; n_items and items (sorted ids,
    comma-joined) name those items, share is the largest coverage. Null texts match nothing.
    """
    rows = own_columns(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    bench = own_columns(benchmark, item_id=item_col, text=text_col).withColumn("item_id", F.col("item_id").cast("long"))
    pairs = coverage(rows, bench, threshold=threshold, max_seeds=max_seeds)
    bad = F.when(F.col("share") >= threshold, F.col("item_id"))
    return pairs.groupBy("doc_id").agg(
        (F.max("share") >= threshold).alias("contaminated"),
        F.count_distinct(bad).alias("n_items"),
        F.max("share").alias("share"),
        F.array_join(F.array_sort(F.collect_set(bad)).cast("array<string>"), ",").alias("items"),
    )


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options: object) -> DataFrame:
    """`decontaminate` with a row for every id of `docs`, also those that share no seed. Rows that share an id are one:
    it is contaminated if any of them is. Empty tables give no rows."""
    found = written(decontaminate(docs, benchmark, id_col, **options), "coverage")
    ids = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id")).distinct()
    named = found.withColumnRenamed("doc_id", "found_id")
    joined = ids.join(named, ids["doc_id"].eqNullSafe(named["found_id"]), "left")
    return joined.select(
        "doc_id",
        F.coalesce("contaminated", F.lit(False)).alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("share", F.lit(0.0)).alias("share"),
        F.coalesce("items", F.lit("")).alias("items"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """`docs` without contaminated rows; columns unchanged."""
    rows, key = row_ids(docs, id_col)
    bad = decontaminate(rows, benchmark, key, text_col, **options).filter("contaminated").select("doc_id")
    bad = written(bad, "contaminated")
    return rows.join(bad, rows[key].eqNullSafe(bad["doc_id"]), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
