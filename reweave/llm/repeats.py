"""What substring dedup over words and over bytes have in common.

A window is a fixed number of consecutive units (words or bytes) of one text. Each window has one anchor, its least
gram, chosen by the window's content alone (winnowing). So two equal windows have equal anchors at the same place, and
only windows around anchors that occur more than once need a closer look. The windows that share an anchor follow one
another: together they are a stretch of the text.

Stretches are told apart by two 64-bit hashes, that of the anchor and that of the whole stretch. Those that occur twice as
a whole are done. Of the others, a text that stands alone with its stretch meets the other kinds of stretches at its anchor
(one text for each kind, whatever the number of its copies), and the operator compares them unit by unit. Where more than
`most` kinds share an anchor (a passage in very many contexts), their windows are counted in an ordinary aggregation
instead, by the hashes of anchor and window, so that no task or pair list grows with such a group. Windows are taken in
blocks by their distance from the anchor. What all windows of a block have in common, its core, is part of each of them: a
core that occurs once has no repeated window. A block that occurs twice as a whole has no other. Only where a core has
blocks of several kinds are windows looked at one by one, once for each kind.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reweave.llm import bytewords as bw
from reweave.llm.common import maybe_among, own_columns, unique_ids, written

EMPTY_SHA = hashlib.sha256(b"").hexdigest()
STRETCHES = "rid long, h long, whole long, place long, start long, n_windows long"


@dataclass
class Units:
    """How an operator sees a text: its units, their transport as bytes, and what is left after cuts."""

    split: Callable  # bytes of a text -> sequence of units
    pack: Callable  # units -> bytes
    unpack: Callable  # bytes -> units
    between: bytes  # what stands between two units
    span_hashes: Callable  # (bytes of a text, starts, lengths) -> hash of each span
    digest: Callable  # bytes of a text -> hex digest of all its units


def surveyed(docs: DataFrame, id_col: str, text_col: str, survey: Callable, digest: Callable) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, heads, classes) of `docs`.

    `survey(column)` gives the digest, the number of units and the anchors of each text. heads: a row for each row of
    docs (doc_id, sha, n). classes: a row for each distinct text (rid, rep_id, sha, n, copies, anchors). rows: doc_id and
    text, and where ids repeat also sha, so that texts are found by both.
    """
    rows = own_columns(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bw.small(batches, "text"):
            sha, n, anchors, cuts = survey(batch.column("text"))
            columns = [batch.column("doc_id"), pa.array(sha, pa.string()), pa.array(n, pa.int64()), bw.lists(anchors.view(np.int64), cuts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "sha", "n", "anchors"])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bw.small(batches, "text"):
            sha = [digest((t or "").encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sha, pa.string())], ["doc_id", "text", "sha"])

    heads = written(rows.mapInArrow(run, "doc_id long, sha string, n long, anchors array<long>"), "heads")
    classes = heads.groupBy("sha").agg(
        F.min("doc_id").alias("rep_id"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"), F.first("anchors").alias("anchors")
    )
    classes = written(classes.withColumn("rid", F.monotonically_increasing_id()), "classes")
    if not unique_ids(heads, "doc_id"):
        rows = rows.mapInArrow(digested, "doc_id long, text string, sha string")
    return rows, heads.select("doc_id", "sha", "n"), classes


def with_repeated_anchors(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """rid, text and its repeated anchors, once for each distinct text that has any.

    Texts are found by id, and by digest too where ids repeat. A null rep_id (all ids of the class null) joins null ids.
    """
    anchors = classes.select("rid", F.explode("anchors").alias("h"))
    repeated = anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    repeated = written(repeated, "repeated")
    wanted = anchors.join(repeated, "h").groupBy("rid").agg(F.collect_set("h").alias("wanted"))
    wanted = written(classes.select("rid", "rep_id", F.col("sha").alias("rep_sha")).join(wanted, "rid"), "wanted")
    rows = maybe_among(rows, "doc_id", wanted.select("rep_id"))
    same = rows["doc_id"].eqNullSafe(wanted["rep_id"])
    if "sha" not in rows.columns:
        return written(rows.join(wanted, same).select("rid", "text", "wanted"), "texts")
    found = rows.join(wanted, same & (rows["sha"] == wanted["rep_sha"])).select("rid", "text", "wanted")
    return written(found.dropDuplicates(["rid"]), "texts")


def kept_anchors(column: pa.Array, anchors: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """Which anchors are among those wanted of their row."""
    cuts, keep = np.searchsorted(row, np.arange(n_rows + 1)), np.zeros(len(anchors), bool)
    for i, wanted in enumerate(column):
        a, b = cuts[i], cuts[i + 1]
        keep[a:b] = np.isin(anchors[a:b].view(np.int64), wanted.values.to_numpy())
    return keep


def repeated_ranges(
    texts: DataFrame, stretches: DataFrame, units: Units, compare: Callable, *, window: int, reach: int, most: int
) -> DataFrame:
    """rid, a, b: all ranges of units that a repeated window covers, of texts that stand alone at least.

    stretches: rid, h, whole, place, start, n_windows. `compare(rows)` gets (rid, place, lone, left, right) of one anchor:
    the units before it, reversed, up to `reach`, and those from it on; it yields (rid, a, b) for lone rows.
    """
    found = written(stretches, "stretches")
    counted = found.groupBy("h", "whole").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "place", "start", "n_windows")).alias("one")
    )
    counted = written(counted, "counted")
    mixed = counted.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"))
    mixed = written(mixed.filter("kinds > 1 AND least = 1").select("h", "kinds"), "mixed")
    twice = counted.filter("n > 1").select("h", "whole")
    complete = found.join(twice, ["h", "whole"], "left_semi").select(
        "rid", F.col("start").alias("a"), (F.col("start") + F.col("n_windows") - 1 + window).alias("b")
    )
    asked = counted.join(mixed, "h").select(
        "one.rid",
        F.struct("h", "one.place", "one.start", "one.n_windows", (F.col("n") == 1).alias("lone"), (F.col("kinds") > most).alias("hot")).alias("ask"),
    )
    asked = asked.groupBy("rid").agg(F.collect_list("ask").alias("asks"))
    asking = texts.select("rid", "text").join(written(asked, "asked"), "rid")

    names, fields = ["h", "rid", "place", "lone", "left", "right"], [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rid, text, asks in zip(*(batch.column(c).to_pylist() for c in ("rid", "text", "asks"))):
                own = [a for a in asks if not a["hot"]]
                line = units.split((text or "").encode()) if own else None
                for ask in own:
                    p = ask["place"]
                    left, right = units.pack(line[max(0, p - reach) : p][::-1]), units.pack(line[p : p + window])
                    out.append((ask["h"], rid, p, ask["lone"], left, right))
                    if len(out) >= 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), fields)], names)
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), fields)], names)

    step = max(1, math.isqrt(reach + 1))

    def hot_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, text, asks in zip(*(batch.column(c).to_pylist() for c in ("rid", "text", "asks"))):
                if own := [a for a in asks if a["hot"]]:
                    n = np.array([a["n_windows"] for a in own])
                    which = np.repeat(np.arange(len(own)), n)
                    place, first = (np.array([a[c] for a in own])[which] for c in ("place", "start"))
                    starts = first + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                    block = (place - starts) // step
                    cuts = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (block[1:] != block[:-1])]))
                    sizes = np.diff(np.append(cuts, len(which)))
                    begin, at, block, which = starts[cuts], place[cuts], block[cuts], which[cuts]
                    spans = np.concatenate([starts, at - block * step, begin])
                    lengths = np.concatenate([np.full(len(starts), window), np.full(len(cuts), window - step + 1), sizes - 1 + window])
                    hashes = units.span_hashes((text or "").encode(), spans, lengths)
                    each, core, whole = np.split(hashes, [len(starts), len(starts) + len(cuts)])
                    whole = bw.mix(whole + (at - begin).astype(bw.U))
                    columns = [pa.array([rid] * len(cuts), pa.int64()), pa.array(np.array([a["h"] for a in own], np.int64)[which]), pa.array(block, pa.int64())]
                    columns += [pa.array(v.view(np.int64)) for v in (core, whole)] + [pa.array(begin, pa.int64()), pa.array(np.array([a["lone"] for a in own])[which])]
                    columns += [bw.lists(each.view(np.int64), np.append(cuts, len(starts)), pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["rid", "h", "block", "core", "whole", "start", "lone", "windows"])

    around = asking.mapInArrow(contexts, "h long, rid long, place long, lone boolean, left binary, right binary")
    around = around.repartition("h").sortWithinPartitions("h")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, out = None, [], []
        for batch in batches:
            for h, rid, place, lone, left, right in zip(*(c.to_pylist() for c in batch.columns)):
                if h != now:
                    out += compare(group)
                    now, group = h, []
                group.append((rid, place, lone, units.unpack(left), units.unpack(right)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["rid", "a", "b"])
                out = []
        if out := list(compare(group)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["rid", "a", "b"])

    near = around.mapInArrow(meet, "rid long, a long, b long")
    hot = asking.filter(F.exists("asks", lambda a: a["hot"]))
    hot = hot.mapInArrow(hot_blocks, "rid long, h long, block long, core long, whole long, start long, lone boolean, windows array<long>")
    hot = written(hot, "hot")
    # a stretch that is not lone stands for two at least
    blocks = hot.groupBy("h", "block", "core", "whole").agg(
        F.sum(F.when(F.col("lone"), 1).otherwise(2)).alias("n"), F.min(F.struct("rid", "start")).alias("one"), F.first("windows").alias("windows")
    )
    blocks = written(blocks, "blocks")
    alike = hot.filter("lone").join(blocks.filter("n > 1").select("h", "block", "core", "whole"), ["h", "block", "core", "whole"], "left_semi")
    alike = alike.select("rid", F.col("start").alias("a"), (F.col("start") + F.size("windows") - 1 + window).alias("b"))
    mixed_cores = written(blocks.groupBy("h", "block", "core").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").drop("kinds"), "cores")
    each = blocks.join(mixed_cores, ["h", "block", "core"], "left_semi")
    each = written(each.select("h", "n", "one.rid", "one.start", F.posexplode("windows").alias("i", "w")), "each")
    often = each.groupBy("h", "w").agg(F.sum(F.when(F.col("n") == 1, 1).otherwise(2)).alias("n")).filter("n > 1").select("h", "w")
    often = written(often, "windows")
    frequent = each.filter("n = 1").join(often, ["h", "w"], "left_semi").select("rid", "h", "start", "i").repartition("rid")
    # neighbouring windows of a block as one range, before anything is gathered for a text
    at = frequent.groupBy("rid", "h", "start").agg(F.array_sort(F.collect_list("i")).alias("at"))  # a block has `step` windows at most
    begins = F.filter("at", lambda x, k: F.coalesce(F.get("at", k - 1) != x - 1, F.lit(True)))
    ends = F.filter("at", lambda x, k: F.coalesce(F.get("at", k + 1) != x + 1, F.lit(True)))
    runs = at.select("rid", "start", F.explode(F.arrays_zip(begins.alias("a"), ends.alias("b"))).alias("run"))
    frequent = runs.select("rid", (F.col("start") + F.col("run.a")).alias("a"), (F.col("start") + F.col("run.b") + window).alias("b"))
    return complete.unionByName(near).unionByName(alike).unionByName(frequent)


def assembled(heads: DataFrame, classes: DataFrame, cut: DataFrame, window: int) -> DataFrame:
    """doc_id, n, n_removed, n_spans and kept_sha256 of every row, from what was cut out of single texts (rid,
    n_removed, n_spans, kept_sha256). Texts with copies repeat as a whole, if they have a window at all."""
    homes = classes.select("rid", "sha", "copies").join(cut, "rid", "left").drop("rid")
    homes = written(homes, "homes")
    whole = (F.col("copies") > 1) & (F.col("n") >= window)
    return heads.join(homes, "sha").select(
        "doc_id",
        "n",
        F.when(whole, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def merged(ranges: list[tuple[int, int]]) -> list[list[int]]:
    """Overlapping or touching ranges as one."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def cut_out(texts: DataFrame, ranges: DataFrame, classes: DataFrame, units: Units) -> DataFrame:
    """rid, n_removed, n_spans and kept_sha256 for texts without copies; ranges: rid, a, b."""
    single = classes.filter("copies = 1").select("rid")
    per_text = ranges.groupBy("rid").agg(F.collect_list(F.struct("a", "b")).alias("ranges")).join(single, "rid")
    found = texts.select("rid", "text").join(per_text, "rid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rid, text, own in zip(*(batch.column(c).to_pylist() for c in ("rid", "text", "ranges"))):
                line, last, gone, kept = units.split((text or "").encode()), 0, 0, []
                spans = merged([(r["a"], r["b"]) for r in own])
                for a, b in spans:
                    kept.append(units.pack(line[last:a]))
                    gone, last = gone + b - a, b
                kept.append(units.pack(line[last:]))
                out.append((rid, gone, len(spans), units.digest(units.between.join(k for k in kept if k))))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            names = ["rid", "n_removed", "n_spans", "kept_sha256"]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return found.mapInArrow(run, "rid long, n_removed long, n_spans long, kept_sha256 string")
