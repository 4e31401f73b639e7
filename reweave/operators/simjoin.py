"""Similarity joins of labels and vectors without cross joins.

Each join takes distinct strings on both sides (a column `label`), finds candidates by an equi-join that loses no true
match, and scores each candidate pair once. Thresholds must be above 0.
"""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from reweave.functions.labels import jaccard, ngrams, tokens


def _positive(threshold: float) -> float:
    if threshold <= 0:
        raise ValueError("a similarity join needs a threshold above 0")
    return threshold


def cosine_join(left: DataFrame, right: DataFrame, grams: Column, threshold: float) -> DataFrame:
    """left_label, right_label, similarity of pairs whose gram counts have a cosine of `threshold` or more.

    `grams` is an array expression over `label`. Grams are ordered from rare to frequent. The first gram that two labels
    share leaves either of them at least `threshold` of its norm from there on, or the rest could not add up to it; so
    labels meet on these rare grams only, and frequent grams make no pairs.
    """
    t = _positive(threshold)

    def counted(df: DataFrame) -> DataFrame:
        return df.select("label", F.explode(grams).alias("gram")).groupBy("label", "gram").agg(F.count(F.lit(1)).alias("n"))

    sides = {"left": counted(left), "right": counted(right)}
    often = sides["left"].unionByName(sides["right"]).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))

    def rare(side: str) -> DataFrame:
        own, square = Window.partitionBy("label").orderBy("df", "gram"), F.col("n") * F.col("n")
        rest = F.sum(square).over(own.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        rows = sides[side].join(often, "gram").withColumns({"rest": rest, "all": F.sum(square).over(Window.partitionBy("label"))})
        return rows.filter(F.col("rest") >= F.col("all") * (t * t - 1e-9)).select("gram", F.col("label").alias(f"{side}_label"))

    def counts(side: str) -> DataFrame:
        entries = F.map_from_entries(F.collect_list(F.struct("gram", "n")))
        return sides[side].groupBy(F.col("label").alias(f"{side}_label")).agg(entries.alias(f"{side}_n"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias(f"{side}_norm"))

    met = rare("left").join(rare("right"), "gram").select("left_label", "right_label").distinct()
    pairs = met.join(counts("left"), "left_label").join(counts("right"), "right_label")
    dot = F.aggregate(F.map_entries("left_n"), F.lit(0).cast("long"), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at("right_n", e["key"]), F.lit(0).cast("long")))
    score = dot / (F.col("left_norm") * F.col("right_norm"))
    return pairs.select("left_label", "right_label", score.alias("similarity")).filter(F.col("similarity") >= t - 1e-12)


def char_join(left: DataFrame, right: DataFrame, threshold: float, n: int = 3) -> DataFrame:
    return cosine_join(left, right, ngrams(F.col("label"), n), threshold)


def word_join(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    return cosine_join(left, right, tokens(F.col("label")), threshold)


def jaccard_join(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose word sets have a Jaccard similarity of `threshold` or more.

    Of a set of n words, t * n at least must be shared. So with words ordered from rare to frequent, the first shared word is
    among the first n - t * n + 1 of both sets, and labels meet on these only: a frequent word makes no pairs.
    """
    t = _positive(threshold)
    words = lambda df: df.select("label", F.explode(F.array_distinct(tokens(F.col("label")))).alias("word"))
    often = words(left).unionByName(words(right)).groupBy("word").agg(F.count(F.lit(1)).alias("df"))

    def rare(df: DataFrame, side: str) -> DataFrame:
        own = Window.partitionBy("label")
        rows = words(df).join(often, "word").withColumns({"at": F.row_number().over(own.orderBy("df", "word")), "size": F.count(F.lit(1)).over(own)})
        rows = rows.filter(F.col("at") <= F.col("size") - F.ceil(F.col("size") * t - 1e-9) + 1)
        return rows.select("word", F.col("label").alias(f"{side}_label"), F.col("size").alias(f"{side}_size"))

    near = (F.col("left_size") >= F.col("right_size") * t - 1e-9) & (F.col("right_size") >= F.col("left_size") * t - 1e-9)
    pairs = rare(left, "left").join(rare(right, "right"), "word").filter(near).select("left_label", "right_label").distinct()
    score = jaccard(tokens(F.col("left_label")), tokens(F.col("right_label")))
    return pairs.withColumn("similarity", score).filter(F.col("similarity") >= t)


def edit_join(left: DataFrame, right: DataFrame, most: int) -> DataFrame:
    """left_label, right_label, distance of pairs at most `most` edits apart.

    The left string is cut into most + 1 pieces. One of them occurs unchanged in the right string, shifted by at most
    `most` places (pigeonhole), so an equi-join on piece and place finds all; strings shorter than most + 1 characters
    have an empty piece and meet on lengths instead.
    """
    length = F.char_length("label")
    cut = lambda i: F.floor(length * i / (most + 1)).cast("int")
    pieces = F.array(*[F.struct(cut(i).alias("at"), F.substring("label", cut(i) + 1, cut(i + 1) - cut(i)).alias("piece")) for i in range(most + 1)])
    mine = left.filter(length > most).select(F.col("label").alias("left_label"), F.explode(pieces).alias("x")).select("left_label", "x.*")
    shifted = F.explode(F.array(*[F.col("at") + s for s in range(-most, most + 1)]))
    mine = mine.withColumn("at", shifted).filter("at >= 0").withColumn("n", F.char_length("piece"))
    # a left string within reach has at most `most` characters more or fewer, which bounds its pieces' lengths
    least, largest = F.floor((length - most) / (most + 1)), F.ceil((length + most) / (most + 1))
    sizes = F.sequence(F.greatest(F.lit(1), least).cast("int"), F.least(largest, length).cast("int"))
    theirs = right.filter(length >= 1).withColumn("n", F.explode(F.filter(sizes, lambda n: n <= length)))
    theirs = theirs.withColumn("at", F.explode(F.sequence(F.lit(0), length - F.col("n"))))
    theirs = theirs.select(F.col("label").alias("right_label"), "at", "n", F.substring("label", F.col("at") + 1, F.col("n")).alias("piece"))
    met = mine.join(theirs, ["piece", "n", "at"]).select("left_label", "right_label")
    reach = F.explode(F.sequence(F.greatest(F.lit(0), length - most), length + most))
    short = left.filter(length <= most).select(F.col("label").alias("left_label"), reach.alias("n"))
    near = right.filter(length <= 2 * most).select(F.col("label").alias("right_label"), length.alias("n"))
    met = met.unionByName(short.join(near, "n").select("left_label", "right_label")).distinct()
    return met.withColumn("distance", F.levenshtein("left_label", "right_label", most)).filter("distance >= 0")


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The sequence matcher's ratio; 0 if either string is empty or null."""
    return pd.Series([difflib.SequenceMatcher(a=x, b=y).ratio() if x and y else 0.0 for x, y in zip(a, b)])


def ratio_from(threshold: float) -> Callable:
    """As `sequence_ratio`, but 0 below `threshold`: pairs with too few letters in common are not matched."""

    @F.pandas_udf(DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        letters = {x: Counter(x) for x in {*a, *b} if x}

        def of(x: str, y: str) -> float:
            if not x or not y or 2 * (letters[x] & letters[y]).total() < threshold * (len(x) + len(y)) - 1e-9:
                return 0.0
            found = difflib.SequenceMatcher(a=x, b=y).ratio()
            return found if found >= threshold else 0.0

        return pd.Series([of(x, y) for x, y in zip(a, b)])

    return ratio


def subsequence_candidates(left: DataFrame, right: DataFrame, threshold: float, counted: int = 3) -> DataFrame:
    """left_label and right_label of all pairs that could have a common subsequence of t times their mean length.

    Strings of n and m characters with such a subsequence of c lose n - c and m - c characters. Each loss spoils q at most of
    the string's own substrings of length q (grams), and parts the letters of q - 1 of the other's. The other grams are
    shared, at places that the losses shift. With grams ordered from rare to frequent, the first `counted` of the shared ones
    are among the first q (n - c) + (q - 1) (m - c) + `counted` of the first string, and likewise of the second. So pairs meet
    on these grams, for each pair of lengths, and must meet that often (or as often as there must be shared grams). q is the
    largest of 3, 2 and 1 for which a gram must be shared.
    """
    t, n = _positive(threshold), F.char_length("label")
    least = lambda size, partner: F.ceil((size + partner) * (t / 2) - 1e-9).cast("int")

    def grams(df: DataFrame) -> DataFrame:
        of = lambda q: F.when(n >= q, F.transform(F.sequence(F.lit(0), n - q), lambda i: F.struct(F.lit(q).alias("q"), F.substring("label", i + 1, F.lit(q)).alias("gram"), i.alias("at"))))
        each = F.flatten(F.filter(F.array(of(1), of(2), of(3)), lambda x: x.isNotNull()))
        return df.filter("label <> ''").select("label", n.alias("n"), F.explode(each).alias("x")).select("label", "n", "x.*")

    every = {"left": grams(left), "right": grams(right)}
    often = every["left"].unionByName(every["right"]).groupBy("q", "gram").agg(F.count(F.lit(1)).alias("df"))

    def shared(q: int, size: Column, partner: Column) -> Column:
        c = least(size, partner)
        return c - q + 1 - (q - 1) * (size + partner - 2 * c)

    def rare(side: str, other: DataFrame) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct("df", "gram", "at")))
        rows = every[side].join(often, ["q", "gram"]).groupBy("label", "n", "q").agg(ordered.alias("grams"))
        reach = F.sequence(F.ceil(F.col("n") * (t / (2 - t)) - 1e-9).cast("int"), F.floor(F.col("n") * ((2 - t) / t) + 1e-9).cast("int"))
        rows = rows.withColumn("m", F.explode(reach)).join(other.select(n.alias("m")).distinct(), "m")
        best = F.when(shared(3, F.col("n"), F.col("m")) >= 1, 3).when(shared(2, F.col("n"), F.col("m")) >= 1, 2).otherwise(1)
        rows = rows.filter((F.col("q") == best) & (least(F.col("n"), F.col("m")) <= F.least("n", "m")))
        must = F.least(F.lit(counted), F.when(F.col("q") == 3, shared(3, F.col("n"), F.col("m"))).when(F.col("q") == 2, shared(2, F.col("n"), F.col("m"))).otherwise(shared(1, F.col("n"), F.col("m"))))
        lost = F.col("n") - least(F.col("n"), F.col("m"))
        take = F.col("q") * F.col("lost") + (F.col("q") - 1) * (F.col("lost") + F.col("m") - F.col("n")) + F.col("must")
        rows = rows.withColumns({"must": must, "lost": lost}).withColumn("x", F.explode(F.slice("grams", F.lit(1), take)))
        a, b = ("n", "m") if side == "left" else ("m", "n")
        return rows.select(
            F.col("label").alias(f"{side}_label"), F.col(a).alias("left_n"), F.col(b).alias("right_n"), "q", F.col("x.gram").alias("gram"),
            F.col("x.at").alias(f"{side}_at"), F.col("lost").alias(f"{side}_lost"), F.col("must").alias(f"{side}_must"),
        )

    met = rare("left", right).join(rare("right", left), ["left_n", "right_n", "q", "gram"])
    shift = F.col("left_at") - F.col("right_at")
    met = met.filter((shift <= F.col("left_lost")) & (-shift <= F.col("right_lost")))
    pairs = met.groupBy("left_label", "right_label").agg(F.count(F.lit(1)).alias("n"), F.min("left_must").alias("must"))
    return pairs.filter("n >= must").select("left_label", "right_label")


def ratio_join(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Pairs with a sequence ratio of `threshold` or more: what the matcher counts is a common subsequence."""
    pairs = subsequence_candidates(left, right, threshold)
    return pairs.withColumn("similarity", ratio_from(threshold)("left_label", "right_label")).filter(F.col("similarity") >= threshold)


def label_join(left: DataFrame, right: DataFrame, threshold: float, edits: int = 0) -> DataFrame:
    """The best of word Jaccard, sequence ratio and 1 - distance / length, at `threshold` or more; up to `edits` edits
    count as equal.

    Strings d edits apart keep a common subsequence of the longer one's length less d, so the ratio's candidates are
    those of the distance too."""
    found = jaccard_join(left, right, threshold).select("left_label", "right_label").unionByName(subsequence_candidates(left, right, threshold))
    if edits:
        found = found.unionByName(edit_join(left, right, edits).select("left_label", "right_label"))
    found = found.distinct()
    distance = F.levenshtein("left_label", "right_label")
    edit = 1 - distance / F.greatest(F.char_length("left_label"), F.char_length("right_label"))
    score = F.greatest(jaccard(tokens(F.col("left_label")), tokens(F.col("right_label"))), ratio_from(threshold)("left_label", "right_label"), edit)
    score = F.when(distance <= edits, F.lit(1.0)).otherwise(score) if edits else score
    return found.withColumn("similarity", score).filter(F.col("similarity") >= threshold)


def vector_join(queries: DataFrame, vectors: DataFrame, threshold: float, *, key: str = "vec_id", block: int = 2048, chunk: int = 32_768) -> DataFrame:
    """query_id, `key`, similarity of query vectors and vectors with a cosine of `threshold` or more.

    Both sides have `key` and embedding. Queries are dealt into blocks of about `block` rows and vectors into chunks of
    about `chunk`, by hash; each block meets each chunk in a task of its own, so vectors move once for every block of queries
    and nothing passes through the driver. Vectors without length or null match nothing.
    """
    counts = queries.select(F.lit(1).alias("q")).unionByName(vectors.select(F.lit(0).alias("q"))).groupBy("q").count()
    n = {r["q"]: r["count"] for r in counts.collect()}
    blocks, chunks = (max(1, -(-n.get(q, 0) // most)) for q, most in ((1, block), (0, chunk)))
    own, all_of = (lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")), (lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    q = queries.filter("embedding IS NOT NULL").select(F.col(key).alias("query_id"), F.col("embedding").alias("query"), own(blocks).alias("i")).withColumn("j", all_of(chunks))
    v = vectors.filter("embedding IS NOT NULL").select(F.col(key).alias(key), F.col("embedding").alias("vector"), own(chunks).alias("j")).withColumn("i", all_of(blocks))

    kind = dict(vectors.dtypes)[key]
    return q.groupBy("i", "j").cogroup(v.groupBy("i", "j")).applyInPandas(meeting(key, threshold), f"query_id {kind}, {key} {kind}, similarity double")


def meeting(key: str, threshold: float) -> Callable:
    """A function of queries (query_id, query) and vectors (`key`, vector) that gives the pairs at `threshold` or more."""

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": left["query_id"][:0], key: right[key][:0], "similarity": pd.Series([], dtype=float)})
        sims = unit(np.stack(left["query"].to_numpy()).astype(float)) @ unit(np.stack(right["vector"].to_numpy()).astype(float)).T
        x, y = np.nonzero(sims >= threshold)
        return pd.DataFrame({"query_id": left["query_id"].to_numpy()[x], key: right[key].to_numpy()[y], "similarity": sims[x, y]})

    return meet


def unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True) if rows.size else np.ones((len(rows), 1))
    return rows / np.where(norms == 0, 1, norms)


def gated_join(left: DataFrame, right: DataFrame, threshold: float, prefilter: float, vectors: DataFrame) -> DataFrame:
    """left_label matched by character cosine, or, where its best one is in [prefilter - 0.05, threshold), by vectors.

    vectors: left_label and similarity of vector matches at `threshold` or more.
    """
    close = char_join(left, right, prefilter - 0.05)
    best = close.groupBy("left_label").agg(F.max("similarity").alias("best"))
    by_char = best.filter(F.col("best") >= threshold).select("left_label", F.lit("char").alias("by"))
    gate = best.filter(F.col("best") < threshold).select("left_label")
    by_vector = vectors.filter(F.col("similarity") >= threshold).join(gate, "left_label", "left_semi").select("left_label").distinct()
    return by_char.unionByName(by_vector.withColumn("by", F.lit("vector")))
