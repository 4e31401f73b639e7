"""SimHash near-dedup by tiled exact comparison.

A fingerprint is the bitwise majority of 64-bit hashes of a text's shingles. Distinct fingerprints are dealt into tiles by
their population counts: each fingerprint is cut into a few parts of neighbouring bits, and the set bits of every part are
counted. One differing bit moves one count by one, so fingerprints within the radius lie in tiles whose counts differ by at
most the radius in sum. Only such tile pairs meet; they are compared whole, by exclusive-or and bit counts in numpy. Nothing
is hashed away: the links are those of comparing all pairs.

Large tiles are cut into blocks of about `tile_size`, so the work of a pair is bounded. `parts` weighs copies against
comparisons: each fingerprint goes to 43 tiles with six parts (73 with eight, 273 with sixteen), and 0.2 percent of all pairs
of random fingerprints are compared (0.04 percent, 0.00005 percent).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reweave.llm import bytewords as bw
from reweave.llm.common import own_columns, written
from reweave.llm.components import components

SEED = 42
CHUNK = 1 << 16


def _majority(hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The fingerprint of each run cuts[i]:cuts[i + 1] of hashes; empty runs have 0."""
    sizes = np.diff(cuts)
    ones = np.zeros((len(sizes), 64), np.int64)
    for a in range(0, len(hashes), CHUNK):
        b = min(a + CHUNK, len(hashes))
        bits = np.unpackbits(hashes[a:b].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.searchsorted(cuts, a, side="right") - 1
        last = np.searchsorted(cuts, b, side="left")
        rows = np.arange(first, last)[sizes[first:last] > 0]
        ones[rows] += np.add.reduceat(bits, np.maximum(cuts[rows], a) - a, axis=0, dtype=np.int64)
    set_ = (2 * ones > sizes[:, None]).astype(np.uint8)
    return np.packbits(set_, axis=1, bitorder="little").view("<u8").ravel().astype(bw.U)


def fingerprints(column: pa.Array, shingle_words: int) -> np.ndarray:
    """The fingerprint of each text: words between white space, A-Z lower-cased, in shingles joined by one space."""
    data, at = bw.texts(column, lower=True)
    raw = data.tobytes()
    split = [raw[a:b].split() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    n_words = np.array([len(s) for s in split], np.int64)
    line = b" ".join(w for s in split for w in s)
    lengths = np.fromiter((len(w) for s in split for w in s), np.int64, int(n_words.sum()))
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = starts + lengths
    first = np.concatenate([[0], np.cumsum(n_words)])
    size = np.minimum(n_words, shingle_words)
    count = np.where(n_words > 0, n_words - size + 1, 0)
    cuts = np.concatenate([[0], np.cumsum(count)])
    word = np.arange(cuts[-1]) + np.repeat(first[:-1] - cuts[:-1], count)
    last = word + np.repeat(size, count) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[word].tolist(), ends[last].tolist())), bw.U, len(word))
    return _majority(hashes, cuts)


def _widths(parts: int) -> list[int]:
    return [64 // parts + (i < 64 % parts) for i in range(parts)]


def _weights(parts: int, radius: int) -> list[int]:
    """The place value of each part's count in a tile's number; counts moved by the radius stay apart."""
    out, value = [], 1
    for width in _widths(parts):
        out.append(value)
        value *= width + 1 + 2 * radius
    if value >= 1 << 63:
        raise ValueError("too many parts for a 64-bit tile number")
    return out


def tile_number(fp: Column, parts: int, radius: int) -> Column:
    """The population counts of a fingerprint's parts as one number."""
    number, shift = F.lit(0).cast("long"), 0
    for width, weight in zip(_widths(parts), _weights(parts, radius)):
        own = F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        number, shift = number + F.bit_count(own) * F.lit(weight), shift + width
    return number


def tile_steps(parts: int, radius: int) -> list[int]:
    """The differences of tile numbers whose counts differ by at most `radius` in sum: 0, and one of each pair d and -d."""
    weights, found = _weights(parts, radius), {0}
    for n in range(1, radius + 1):
        for chosen in combinations_with_replacement(weights, n):
            found |= {abs(sum(s * w for s, w in zip(signs, chosen))) for signs in product((1, -1), repeat=n)}
    return sorted(found)


def near_pairs(left: list[np.ndarray], right: list[np.ndarray], radius: int, most: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Links between left[i] and right[i], for all i: small tiles many at a time, large ones as a matrix."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    na, nb = np.array([len(x) for x in left], np.int64), np.array([len(x) for x in right], np.int64)
    area = na * nb
    for i in np.flatnonzero(area > 4096):
        step = max(1, most // int(nb[i]))
        for a in range(0, int(na[i]), step):
            own = left[i][a : a + step]
            x, y = np.nonzero(np.bitwise_count(own[:, None] ^ right[i][None, :]) <= radius)
            found.append((own[x], right[i][y]))
    small = np.flatnonzero((area > 0) & (area <= 4096))
    flat_a, flat_b = (np.concatenate([side[i] for i in small]) if len(small) else np.zeros(0, bw.U) for side in (left, right))
    at_a, at_b = np.cumsum(na[small]) - na[small], np.cumsum(nb[small]) - nb[small]
    group = np.cumsum(area[small]) // most
    for g in np.unique(group):
        own = np.flatnonzero(group == g)
        size = area[small][own]
        k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        width = np.repeat(nb[small][own], size)
        x, y = flat_a[np.repeat(at_a[own], size) + k // width], flat_b[np.repeat(at_b[own], size) + k % width]
        near = np.bitwise_count(x ^ y) <= radius
        found.append((x[near], y[near]))
    if not found:
        return np.zeros(0, bw.U), np.zeros(0, bw.U)
    x, y = (np.concatenate(c) for c in zip(*found))
    return x[x != y], y[x != y]


def forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same fingerprints as the links x, y do, one fewer than the fingerprints of each component."""
    nodes, ends = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = ends[: len(x)], ends[len(x) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[other], nodes[root[other]]


def near_links(distinct: DataFrame, radius: int, parts: int, tile_size: int) -> DataFrame:
    """a and b: links that connect the distinct fingerprints `fp` just as all pairs within `radius` bits do."""
    tiled = written(distinct.select("fp", tile_number(F.col("fp"), parts, radius).alias("tile")), "tiled")
    large = tiled.groupBy("tile").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > tile_size)
    large = written(large.select("tile", F.ceil(F.col("n") / tile_size).alias("blocks")), "large")
    block = F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1)))
    tiles = tiled.join(large, "tile", "left").groupBy("tile", block.alias("block")).agg(F.collect_list("fp").alias("fps"))
    tiles = written(tiles, "tiles")
    steps = F.array(*[F.lit(s).cast("long") for s in tile_steps(parts, radius)])
    left = tiles.select(F.col("tile").alias("from"), F.col("block").alias("b1"), F.col("fps").alias("left"), F.explode(steps).alias("step"))
    left = left.withColumn("tile", F.col("from") + F.col("step"))
    right = tiles.select("tile", F.col("block").alias("b2"), F.col("fps").alias("right"))
    pairs = left.join(right, "tile").filter("step > 0 OR b1 <= b2").select("left", "right")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for name in ("left", "right"):
                column = batch.column(name)
                at = column.offsets.to_numpy()
                values = column.values.to_numpy().view(bw.U)
                sides.append([values[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())])
            x, y = near_pairs(*sides, radius)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64), pa.int64()) for v in forest(x, y)], ["a", "b"])

    return written(pairs.mapInArrow(compare, "a long, b long"), "links")


def simhash_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle_words: int = 3, radius: int = 2, parts: int = 6, tile_size: int = 1024
) -> DataFrame:
    """One row for each row of `docs`: doc_id, fingerprint (16 lowercase hex digits), component_id, n_same.

    A bit of the fingerprint is 1 if it is set in over half of the XXH64 hashes (seed 42) of the text's shingles, repeats
    included; a text of fewer words is one shingle, and null, empty and blank texts have the fingerprint 0, which links like
    any other. Fingerprints link at `radius` or fewer differing bits. component_id is the smallest id that can be reached, the
    row's own included; rows without an id are linked too, and a component of such rows only has none. n_same counts the rows
    with the same fingerprint. Repeated rows share fingerprint and component; empty tables give no rows.
    """
    rows = own_columns(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bw.small(batches, "text"):
            fp = fingerprints(batch.column("text"), shingle_words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64), pa.int64())], ["doc_id", "fp"])

    prints = written(rows.mapInArrow(run, "doc_id long, fp long"), "fingerprints")
    groups = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_same"))
    groups = written(groups, "groups")
    links = near_links(groups, radius, parts, tile_size)
    roots = components(links, links.count())
    linked = written(roots.withColumnRenamed("node", "fp").join(groups.select("fp", "least"), "fp"), "linked")
    least = linked.groupBy("root").agg(F.min("least").alias("reached"))
    named = linked.join(least, "root").select("fp", "reached", F.lit(True).alias("is_linked"))
    named = groups.join(named, "fp", "left").select(
        "fp", "n_same", F.when(F.col("is_linked"), F.col("reached")).otherwise(F.col("least")).alias("component_id")
    )
    return _told(prints, written(named, "named")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_same"
    )


def _told(prints: DataFrame, named: DataFrame, most: int = 1000) -> DataFrame:
    """Each row with what `named` says of its fingerprint. Fingerprints of more than one in `most` rows, at most so many,
    are looked up in a broadcast table and not shuffled, so that none of them fills a task."""
    total = int(named.agg(F.sum("n_same").alias("n")).first()["n"] or 0)
    shared = written(named.filter(F.col("n_same") * most > total), "common", most)
    common = prints.join(F.broadcast(shared), "fp")
    rest = prints.join(F.broadcast(shared.select("fp")), "fp", "left_anti").join(named, "fp")
    return common.unionByName(rest)
