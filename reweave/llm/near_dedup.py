"""Near-duplicates by bottom-k sketches of one hash function.

1. Each whole text becomes its set of word shingles, and of that set the k smallest hash values (the sketch) and a
   128-bit signature. Rows with equal sets form a class at once and go on as one.
2. Inverted lists: runs of two neighbouring retained values are the keys. Two sets with a Jaccard similarity of 0.8 share
   two such runs, as is asked of them, with a chance of failure of at most 1.6e-8 for 32 retained values, and always if
   the sets are retained whole.
3. Each list gives the pairs of its leader, the set that shares most runs, with all others, which is linear. The similarity
   estimated from the sketch of the union drops hopeless pairs, with a margin of six standard errors (a chance of 3.4e-8
   for a pair at 0.8); the full sets decide. Linked sets are contracted to components.
4. In a second round each list gives one set of each component, against one of the largest component there.
5. What is then still apart in some list is compared whole. Components that meet in a list form a family; families
   larger than a block are first taken apart by an exact prefix filter. The sets of a family are dealt into blocks, and every pair of blocks that can hold a link between components is compared in one task, on full
   sets, for exact counts. A task returns links that join components only, fewer than there are components in it, so the
   output never grows with the pairs of a group, and no link between different components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reweave.llm import bytewords as bw
from reweave.llm.common import maybe_among, own_columns, row_ids, written
from reweave.llm.components import components, joined

SIGN = ["sig_a", "sig_b", "n_shingles"]


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text, as positive 63-bit hashes of `size` words (or of all, if fewer)."""
    data, at = bw.texts(column, lower=True)
    starts, ends, first = bw.words(data, at, bw.NOT_SPACE)
    hashes = bw.range_hashes(data, starts, ends)
    full = (bw.shingles(hashes, size) >> bw.U(1)).astype(np.int64)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(full[a : b - size + 1]))
        elif b > a:
            out.append((bw.mix(bw.shingles(hashes[a:b], b - a) + bw.U(b - a)) >> bw.U(1)).astype(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def _signature(own: np.ndarray) -> tuple[int, int]:
    u = own.astype(bw.U)
    return tuple(int(bw.mix(u * bw.U(odd)).sum(dtype=bw.U).astype(np.int64)) for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))


def _per_text(docs: DataFrame, size: int, keep: int | None) -> DataFrame:
    """doc_id, signature, n_shingles, and the `keep` smallest shingles (all if None)."""
    names = ["doc_id", *SIGN, "sketch"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bw.small(batches, "text"):
            sets = shingle_sets(batch.column("text"), size)
            signs = [_signature(s) for s in sets]
            kept = [s[:keep] for s in sets]
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum([len(s) for s in kept])]), pa.int32()), pa.array(np.concatenate(kept), pa.int64())
            )
            columns = [batch.column("doc_id").cast(pa.int64()), *zip(*signs), [len(s) for s in sets]]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds)), lists], names)

    return docs.mapInArrow(run, "doc_id long, sig_a long, sig_b long, n_shingles long, sketch array<long>")


def _close(n1: str, n2: str, percent: int) -> Column:
    return (F.col(n1) * 100 >= F.col(n2) * percent) & (F.col(n2) * 100 >= F.col(n1) * percent)


def _with_both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """`pairs` (a, b) with `column` of both nodes as column_a and column_b."""
    for end in ("a", "b"):
        side = table.select(F.col("cid").alias(end), F.col(column).alias(f"{column}_{end}"))
        pairs = pairs.join(side, end)
    return pairs


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    both = _with_both(pairs.select("a", "b"), sets, "shingles")
    inter = F.size(F.array_intersect("shingles_a", "shingles_b"))
    union = F.size("shingles_a") + F.size("shingles_b") - inter
    return both.filter(inter * 100 >= union * percent).select("a", "b")


def _estimated(pairs: DataFrame, reps: DataFrame, percent: int, keep: int) -> DataFrame:
    """The pairs (a, b) that the sketch of the union does not rule out."""
    both = _with_both(pairs, reps, "sketch")
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, keep)
    shared = F.size(F.array_intersect(union, F.array_intersect("sketch_a", "sketch_b")))
    share = percent / 100
    margin = 6 * (share * (1 - share) / keep) ** 0.5
    return both.filter(shared >= F.size(union) * (share - margin)).select("a", "b")


def _second_round(known: DataFrame, ends: DataFrame, percent: int) -> DataFrame:
    """For each open list pairs (a, b) of a set of the component with most sets there and one of each other component."""
    picks = known.join(ends.select("key"), "key").groupBy("key", "root").agg(
        F.count(F.lit(1)).alias("n"), F.min_by(F.struct("cid", "n_shingles"), F.xxhash64("key", "cid")).alias("one")
    )
    picks = written(picks.select("key", "root", "n", "one.cid", "one.n_shingles"), "picks")
    largest = picks.groupBy("key").agg(F.max(F.struct("n", "root", "cid", "n_shingles")).alias("top"))
    # written, so that the join below has no aggregate on its side and a list of very many components can be split there
    largest = written(largest.select("key", F.col("top.root").alias("root_a"), F.col("top.cid").alias("a"), F.col("top.n_shingles").alias("n_a")), "largest")
    pairs = picks.join(largest, "key").filter((F.col("root") != F.col("root_a")) & _close("n_shingles", "n_a", percent))
    return pairs.select(F.least("a", "cid").alias("a"), F.greatest("a", "cid").alias("b")).distinct()


def _families(known: DataFrame, ends: DataFrame, most_rows: int) -> DataFrame:
    """The sets of open lists with their component and family: components that meet in a list are of one family."""
    own = known.join(ends.select("key", "a"), "key")
    families = components(own.select("a", F.col("root").alias("b")), most_rows).select(F.col("node").alias("root"), F.col("root").alias("family"))
    return own.select("cid", "n_shingles", "root").distinct().join(families, "root")


def _narrowed(nodes: DataFrame, sets: DataFrame, percent: int, most: int) -> DataFrame:
    """`nodes` with families of more than `most` shingles taken apart by an exact prefix filter on their full sets.

    A shingle of one component only is in no link. Of the others, two sets with enough in common share one among the
    rarest (n common - n needed + 1) of either; so components that share none of these can't be linked. A passage that
    many texts quote is frequent and keeps them together no more.
    """
    weight = nodes.groupBy("family").agg(F.sum(F.col("n_shingles") + 64).alias("w")).filter(F.col("w") > most).select("family")
    heavy = written(weight, "heavy")
    if heavy.isEmpty():
        return nodes
    asked = written(nodes.join(heavy, "family").drop("family"), "heavy-nodes")
    rows = asked.join(sets, "cid").select("cid", "n_shingles", "root", F.explode("shingles").alias("sh"))
    spread = rows.groupBy("sh").agg(F.count(F.lit(1)).alias("df"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    spread = written(spread.filter("lo <> hi").select("sh", "df"), "spread")
    needed = F.ceil(F.col("n_shingles") * percent / 100)
    common = written(rows.join(spread, "sh"), "common")
    alive = common.groupBy("cid").agg(F.count(F.lit(1)).alias("n_common"))
    ranked = common.join(alive, "cid").filter(F.col("n_common") >= needed)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("cid").orderBy("df", "sh")))
    prefix = written(ranked.filter(F.col("rank") <= F.col("n_common") - needed + 1).select("sh", "root", "cid", "n_shingles"), "prefixes")
    ends = prefix.groupBy("sh").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select(F.col("sh").alias("key"), "a")
    light = nodes.join(heavy, "family", "left_anti")
    return light.unionByName(_families(prefix.withColumnRenamed("sh", "key"), written(ends, "prefix-lists"), prefix.count()).select(*light.columns))


def _dealt(nodes: DataFrame, sets: DataFrame, *, most: int, slice_size: int = 1024) -> DataFrame:
    """The sets of all nodes, in slices, for each pair of blocks that they are to be compared in.

    nodes: cid, n_shingles, root, family. A block holds about `most` shingles. Blocks of one large component only are
    not compared with each other. Returns pair, side (0 and 1; 2 if a block meets itself), cid, n_shingles, root, part.
    """
    weight, c = F.sum(F.col("n_shingles") + 64).alias("w"), F.col  # a set costs some shingles more than it has
    sizes = nodes.groupBy("family", "root").agg(weight).withColumn("own", F.when(c("w") >= most, c("root")).otherwise(F.lit(-1)))
    parts = sizes.groupBy("family", "own").agg(F.ceil(F.sum("w") / most).cast("int").alias("parts"))
    placed = nodes.join(sizes.select("root", "own"), "root").join(parts, ["family", "own"])
    placed = placed.withColumn("no", F.pmod(F.xxhash64("cid"), c("parts")).cast("int")).drop("parts")
    placed = written(placed, "placed")
    blocks = parts.select("family", "own", F.explode(F.sequence(F.lit(0), c("parts") - 1)).alias("no"))
    left = blocks.select("family", c("own").alias("own_a"), c("no").alias("no_a"))
    right = blocks.select("family", c("own").alias("own_b"), c("no").alias("no_b"))
    after = (c("own_a") < c("own_b")) | ((c("own_a") == -1) & (c("own_b") == -1) & (c("no_a") <= c("no_b")))
    pairs = written(left.join(right, "family").filter(after).withColumn("pair", F.monotonically_increasing_id()), "block-pairs")
    itself = (c("own_a") == c("own_b")) & (c("no_a") == c("no_b"))
    ends = pairs.select("family", "pair", c("own_a").alias("own"), c("no_a").alias("no"), F.when(itself, 2).otherwise(0).alias("side"))
    ends = ends.unionByName(pairs.filter(~itself).select("family", "pair", c("own_b").alias("own"), c("no_b").alias("no"), F.lit(1).alias("side")))
    cut = F.transform(F.sequence(F.lit(1), c("n_shingles"), F.lit(slice_size)), lambda i: F.slice("shingles", i, slice_size))
    sliced = placed.join(sets, "cid").select("family", "own", "no", "cid", "n_shingles", "root", F.explode(cut).alias("part"))
    return sliced.join(ends, ["family", "own", "no"]).drop("family", "own", "no")


def _compared(dealt: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the components of each pair of blocks wherever any two of their sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, ["pair"]):
            if found := joining_links(rows, percent):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

    return dealt.repartition("pair").sortWithinPartitions("pair", "cid").mapInArrow(run, "a long, b long")


def joining_links(rows: pa.Table, percent: int, step: int = 4 << 20) -> list[tuple[int, int]]:
    """Pairs of similar sets, one at least for each two components of which any sets are similar, and never one within
    components that earlier pairs have joined. A set is counted against all others by its shingles' own lists."""
    ids, first, of = np.unique(rows.column("cid").to_numpy(), return_index=True, return_inverse=True)
    n, label, side = (rows.column(k).to_numpy()[first] for k in ("n_shingles", "root", "side"))
    label = label.copy()
    lists = rows.column("part").combine_chunks()
    holder = np.repeat(of, np.diff(lists.offsets.to_numpy()))
    values = lists.flatten().to_numpy()
    order = np.argsort(values, kind="stable")
    new = np.ones(len(values), bool)
    new[1:] = values[order][1:] != values[order][:-1]
    begin = np.flatnonzero(new)
    times = np.diff(np.append(begin, len(values)))
    held, column = holder[order], np.empty(len(values), np.int64)
    column[order] = np.cumsum(new) - 1
    shared = np.flatnonzero(times[column] > 1)  # a shingle of one set alone is in no intersection
    by_set = shared[np.argsort(holder[shared], kind="stable")]
    cuts = np.searchsorted(holder[by_set], np.arange(len(ids) + 1))
    lone = side == 2
    turn = np.flatnonzero(lone | (side == (0 if (side == 0).sum() <= (side == 1).sum() else 1)))
    out = []
    for s in turn.tolist():
        asked = (label != label[s]) & (n * 100 >= n[s] * percent) & (n[s] * 100 >= n * percent)
        asked[: s + 1 if lone[s] else 0] = False  # within a block each pair once
        if not lone[s]:
            asked &= side != side[s]
        if not asked.any():
            continue
        mine = column[by_set[cuts[s] : cuts[s + 1]]]
        common, sums = np.zeros(len(ids), np.int64), np.cumsum(times[mine])
        part = (sums - 1) // step if len(sums) else sums
        for k in range(int(part[-1]) + 1 if len(part) else 0):
            own = mine[part == k] if part[-1] else mine
            long = times[own]
            at = np.repeat(begin[own] - (np.cumsum(long) - long), long) + np.arange(int(long.sum()))
            common += np.bincount(held[at], minlength=len(ids))
        good = np.flatnonzero(asked & (common * (100 + percent) >= (n + n[s]) * percent))
        for other in good.tolist():
            if label[other] != label[s]:
                out.append((int(ids[s]), int(ids[other])))
                label[label == label[other]] = label[s]
    return out


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows with equal keys, which follow one another."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        values = list(zip(*(batch.column(k).to_pylist() for k in keys)))
        cuts = [0, *(i for i in range(1, len(values)) if values[i] != values[i - 1]), len(values)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and values[a] != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(a, b - a))
            last = values[a]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def near_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    shingle_words: int = 5,
    percent: int = 80,
    sketch_size: int = 48,
    list_size: int = 32,
    block_shingles: int = 500_000,
) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= percent * union of their shingle sets (A-Z lower-cased words
    between white space); component_id is the smallest doc_id reachable. Texts without words, or null, are linked
    with nothing. Null ids are ignored where another id names the component; a component without any other id has a null
    component_id, and one row of it is kept. Empty tables give no rows. With `percent` below 80 lists are keyed by single
    retained values; similar sets larger than `list_size` then share none with a chance of (1 - percent / 100) **
    list_size at most.
    """
    # of two different sets, the smaller one has at least so many shingles if they are similar
    least = -(-percent // (100 - percent)) if percent < 100 else 1 << 62
    # a shingle of one set only breaks one run of the other at most: two runs of similar sets are left if percent >= 80
    pairwise = percent >= 80
    rows = own_columns(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    sketched = written(_per_text(rows, shingle_words, sketch_size).withColumn("row", F.monotonically_increasing_id()), "sketches")
    reps = sketched.filter("n_shingles > 0").groupBy(*SIGN).agg(F.min("doc_id").alias("rep_id"), F.min("row").alias("first_row"), F.min_by("sketch", "row").alias("sketch"))
    reps = written(reps.withColumn("cid", F.monotonically_increasing_id()), "classes")

    low = F.slice("sketch", 1, list_size)
    runs = F.zip_with(F.slice(low, 1, F.size(low) - 1), F.slice(low, 2, F.size(low) - 1), lambda x, y: F.xxhash64(x, y))
    keys = reps.filter(F.col("n_shingles") >= least)
    keys = keys.filter(F.size("sketch") > 1).select("cid", "n_shingles", F.explode(runs).alias("key")) if pairwise else keys.select("cid", "n_shingles", F.explode(low).alias("key"))
    several = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    members = written(keys.join(several, "key"), "lists")
    # similar sets share two runs at least, or one single value
    listed = members.groupBy("cid").agg(F.count(F.lit(1)).alias("m")).filter("m > 1" if pairwise else "m > 0")
    members = written(members.join(listed, "cid"), "lists")
    # the set that shares most runs leads: it is nearest to the middle of a group of near copies
    leaders = members.groupBy("key").agg(F.max(F.struct("m", "cid", "n_shingles")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    leaders = written(leaders.select("key", F.col("first.cid").alias("a"), F.col("first.n_shingles").alias("n_a")), "leaders")
    stars = members.join(leaders, "key").filter((F.col("cid") != F.col("a")) & _close("n_shingles", "n_a", percent))
    chosen = written(reps.join(listed.select("cid"), "cid").select("cid", "rep_id", *SIGN, "sketch"), "chosen")
    stars = written(_estimated(stars.select("a", F.col("cid").alias("b")).distinct(), chosen, percent, sketch_size), "pairs")

    # the text is read a second time, for the sets of documents in lists, and not shuffled: the join on signatures decides
    texts = maybe_among(rows, "doc_id", chosen.select("rep_id"))
    sets = _per_text(texts, shingle_words, None).groupBy(*SIGN).agg(F.first("sketch").alias("shingles"))
    sets = written(chosen.select("cid", *SIGN).join(sets, SIGN).select("cid", "shingles"), "sets")
    links = written(_verified(stars, sets, percent), "links")
    roots = components(links, links.count())
    n_members = members.count()

    def placed(nodes: DataFrame, roots: DataFrame) -> DataFrame:
        return nodes.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))

    def open_lists(roots: DataFrame) -> tuple[DataFrame, DataFrame]:
        known = placed(members, roots)
        ends = known.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b")
        return known, written(ends, "open")

    known, ends = open_lists(roots)
    if not ends.isEmpty():
        more = written(_verified(_estimated(_second_round(known, ends, percent), chosen, percent, sketch_size), sets, percent), "links")
        if not more.isEmpty():
            roots = joined(roots, more, more.count())
            known, ends = open_lists(roots)
        nodes = written(_families(known, ends, n_members), "nodes")
        nodes = written(_narrowed(nodes, sets, percent, block_shingles), "nodes")
        last = written(_compared(_dealt(nodes, sets, most=block_shingles), percent), "links")
        if not last.isEmpty():
            roots = joined(roots, last, last.count())

    homes = placed(reps.select("cid", "rep_id", "first_row", *SIGN), roots)
    names = homes.groupBy("root").agg(F.min("rep_id").alias("component_id"), F.min("first_row").alias("first_row"))
    named = homes.select(*SIGN, "root").join(names, "root").select(*SIGN, "component_id", "first_row")
    named = written(named, "components")
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("component_id").isNotNull() | F.col("first_row").isNull() | (F.col("row") == F.col("first_row")))
    return (
        sketched.select("doc_id", "row", *SIGN)
        .join(named, SIGN, "left")
        .withColumn("component_id", F.coalesce("component_id", "doc_id"))
        .select("doc_id", "n_shingles", "component_id", kept.alias("kept"))
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """`docs` with one row of each group of near-duplicates, that of the smallest id; columns unchanged."""
    rows, key = row_ids(docs, id_col)
    kept = near_dedup(rows, key, text_col, **options).filter("kept").select("doc_id")
    return rows.join(kept, rows[key].eqNullSafe(kept["doc_id"]), "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
