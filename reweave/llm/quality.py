"""Quality classifier: a sparse ensemble of rules.

Boosted shallow trees over text statistics propose rules: every path from a root is a conjunction of thresholds. A
logistic model with an L1 penalty gives each rule a weight, most of them zero. The rules left are compiled into one
Spark column expression, so scoring is plain arithmetic on the statistics.

The statistics of every whole text are computed where it is read. Training takes a bounded sample of the labelled rows
(`max_rows`, those with the smallest hash of their id), which is all that reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reweave.llm import bytewords as bw
from reweave.llm.common import own_columns, written

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" \t\r\n\x0b\x0c",
    "stop": b".,;:?'\"()-",
    "bang": b"!",
    "pipe": b"|",
    "noise": b"#$%&*@^~<>{}[]=+\\/_`",
}
STATISTICS = (
    "n_bytes", "n_words", *(f"{c}_share" for c in _CLASSES), "high_share", "mean_word", "max_word", "distinct_words",
    "same_as_before", "distinct_triples", "top_word", "n_lines", "distinct_lines", "line_words",
)


def _means(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (sums[at[1:]] - sums[at[:-1]]) / np.maximum(1, np.diff(at))


def text_statistics(column: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text; the empty text has zeros, and ones where a share of distinct things is meant."""
    data, at = bw.texts(column, lower=False)
    starts, ends, first = bw.words(data, at, bw.NOT_SPACE)
    n, count = np.diff(at), np.diff(first)
    out = {"n_bytes": n, "n_words": count}
    for name, members in _CLASSES.items():
        table = np.zeros(256, bool)
        table[list(members)] = True
        out[f"{name}_share"] = _means(table[data], at)
    out["high_share"] = _means(data >= 128, at)
    lengths = ends - starts
    sums = np.concatenate([[0], np.cumsum(lengths)])
    out["mean_word"] = (sums[first[1:]] - sums[first[:-1]]) / np.maximum(1, count)
    low = bw.LOWER[data]
    hashes = bw.range_hashes(low, starts, ends)
    triples = bw.shingles(hashes, 3)
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    breaks = np.flatnonzero(data == 10)
    split = np.searchsorted(breaks, at)
    # the lines of all texts at once: each text begins one, and so does each break in it
    text = np.concatenate([np.arange(len(n)), np.searchsorted(at, breaks, side="right") - 1])
    begin = np.concatenate([at[:-1], breaks + 1])
    order = np.lexsort((begin, text))
    text, begin = text[order], begin[order]
    end = np.append(begin[1:] - 1, 0)
    last = np.append(text[1:] != text[:-1], True)
    end[last] = at[text[last] + 1]
    line_hashes, line_cuts = bw.range_hashes(low, begin, end), np.searchsorted(text, np.arange(len(n) + 1))
    more, top = np.zeros((len(n), 7)), np.zeros(len(n))
    for i in range(len(n)):
        a, b = first[i], first[i + 1]
        count_of = split[i + 1] - split[i] + 1
        lines = np.unique(line_hashes[line_cuts[i] : line_cuts[i + 1]])
        more[i, 4:] = count_of, len(lines) / count_of, (b - a) / count_of
        more[i, 1] = more[i, 3] = 1
        if b > a:
            own, times = np.unique(hashes[a:b], return_counts=True)
            more[i, 0], more[i, 1] = lengths[a:b].max(), len(own) / (b - a)
            more[i, 2] = same[a + 1 : b].sum() / (b - a)
            if b - a > 2:
                more[i, 3] = len(np.unique(triples[a : b - 2])) / (b - a - 2)
            top[i] = times.max() / (b - a)
    out["max_word"], out["distinct_words"], out["same_as_before"], out["distinct_triples"] = more[:, :4].T
    out["top_word"] = top
    out["n_lines"], out["distinct_lines"], out["line_words"] = more[:, 4:].T
    return np.column_stack([out[s].astype(float) for s in STATISTICS])


def with_statistics(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, str]:
    """`docs` with a column for each of STATISTICS of its whole text (null counts as empty), and the prefix of their
    names, which no column of `docs` has."""
    prefix = "stat_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    schema = T.StructType([*docs.schema.fields, *(T.StructField(prefix + name, T.DoubleType()) for name in STATISTICS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bw.small(batches, text_col):
            values = text_statistics(batch.column(text_col))
            columns = [*batch.columns, *(pa.array(v, pa.float64()) for v in values.T)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *(prefix + s for s in STATISTICS)])

    return docs.mapInArrow(run, schema), prefix


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, threshold), all of which must hold


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for j, above, threshold in rule:
        ok &= (x[:, j] > threshold) == above
    return ok


def tree_rules(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 3, rate: float = 0.3, least: int = 5) -> list[Rule]:
    """The distinct paths of boosted regression trees on the gradient of the logistic loss."""
    rng, n = np.random.RandomState(7), len(y)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 33))) for j in range(x.shape[1])]
    codes = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    margin, found = np.full(n, 0.0), {}

    def grow(rows: np.ndarray, rule: Rule, grad: np.ndarray, hess: np.ndarray, columns: np.ndarray) -> None:
        best = None
        if len(rule) < depth and len(rows) >= 2 * least:
            g, h = grad[rows].sum(), hess[rows].sum()
            for j in columns:
                k = len(edges[j])
                gs, hs, ns = (np.bincount(codes[rows, j], weights=w, minlength=k + 1)[:k].cumsum() for w in (grad[rows], hess[rows], None))
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                gain[(ns < least) | (len(rows) - ns < least)] = -1
                if k and (i := int(gain.argmax())) >= 0 and gain[i] > 1e-6 and (best is None or gain[i] > best[0]):
                    best = (gain[i], j, i)
        if rule:
            found.setdefault(tuple(sorted(rule)), None)
        if best is None:
            margin[rows] += rate * -grad[rows].sum() / (hess[rows].sum() + 1)
            return
        _, j, i = best
        low = codes[rows, j] <= i
        grow(rows[low], (*rule, (int(j), False, float(edges[j][i]))), grad, hess, columns)
        grow(rows[~low], (*rule, (int(j), True, float(edges[j][i]))), grad, hess, columns)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        columns = rng.choice(x.shape[1], max(1, x.shape[1] * 2 // 3), replace=False)
        grow(np.arange(n), (), p - y, np.maximum(p * (1 - p), 1e-6), np.sort(columns))
    return list(found)


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights of a logistic model with an L1 penalty on the weights, by accelerated proximal gradient."""
    z1 = np.column_stack([np.ones(len(z)), z])
    v = np.ones(z1.shape[1])
    for _ in range(30):  # the largest curvature, by power iteration
        v = z1.T @ (z1 @ v)
        v /= np.linalg.norm(v)
    step = 4 * len(y) / max(1e-9, float(np.linalg.norm(z1 @ v) ** 2))
    w = u = np.zeros(z1.shape[1])
    t = 1.0
    for _ in range(steps):
        grad = z1.T @ (1 / (1 + np.exp(-(z1 @ u))) - y) / len(y)
        new = u - step * grad
        new[1:] = np.sign(new[1:]) * np.maximum(0, np.abs(new[1:]) - step * penalty)
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        w, u = new, new + (before - 1) / t * (new - w)
    return float(w[0]), w[1:]


@dataclass
class RuleEnsemble:
    intercept: float = 0.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.intercept + sum((w * holds(r, x) for r, w in self.rules), np.zeros(len(x))))))

    def column(self, prefix: str) -> Column:
        """The score as a Spark expression over columns named as STATISTICS, after a prefix."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            test = F.lit(True)
            for j, above, threshold in rule:
                c = F.col(prefix + STATISTICS[j])
                test = test & ((c > threshold) if above else (c <= threshold))
            total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, *, penalty: float = 0.0015) -> RuleEnsemble:
    """Learn from statistics and 0/1 labels. Without rows the score is 0.5; with one class only, its smoothed share."""
    if not len(y) or len(np.unique(y)) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return RuleEnsemble(float(np.log(share / (1 - share))))
    rules = tree_rules(x, y)
    z = np.column_stack([holds(r, x) for r in rules]).astype(float)
    intercept, weights = lasso_logistic(z, y, penalty)
    return RuleEnsemble(intercept, [(r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-6])


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, label_col: str = "quality", max_rows: int = 20_000
) -> RuleEnsemble:
    """The model fitted to labelled rows that are not held out.

    Of several labels for one document the mean decides, null labels don't count. Of the labelled documents in `docs`,
    the `max_rows` with the smallest hash of their id train the model; only their texts are read for it. Where rows share
    an id, each of them is a row to learn from, and again at most `max_rows` of all rows, in the same order, are taken.
    """
    rows = own_columns(docs, doc_id=id_col, text=text_col)
    marks = own_columns(labels, doc_id=id_col, y=label_col).filter("y IS NOT NULL").groupBy("doc_id").agg(F.avg("y").alias("y"))
    chosen = (
        marks.filter(~held_out(F.col("doc_id")))
        .join(rows.select("doc_id"), "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    chosen = written(chosen, "sample")
    stats, prefix = with_statistics(rows.join(F.broadcast(chosen), "doc_id"))  # at most max_rows small rows
    names = [prefix + s for s in STATISTICS]
    found = stats.orderBy(F.xxhash64("doc_id"), "doc_id", *names).select("y", *names).limit(max_rows).collect()
    known = np.array(sorted(tuple(map(float, r)) for r in found)).reshape(-1, 1 + len(STATISTICS))
    return fit(known[:, 1:], (known[:, 0] >= 0.5).astype(float))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    label_col: str = "quality",
    max_rows: int = 20_000,
    threshold: float = 0.7,
) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of `docs`; null texts count as empty, and an empty table
    gives no rows. See `learn` for what trains the model."""
    model = learn(docs, labels, id_col, text_col, label_col=label_col, max_rows=max_rows)
    stats, prefix = with_statistics(own_columns(docs, doc_id=id_col, text=text_col))
    scored = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.column(prefix).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, text_col: str = "text", *, threshold: float = 0.7, **options: object) -> DataFrame:
    """The rows of `docs` that the classifier predicts as good, with their columns unchanged."""
    model = learn(docs, labels, text_col=text_col, **options)
    stats, prefix = with_statistics(docs, text_col)
    return stats.filter(model.column(prefix) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
