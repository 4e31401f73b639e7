"""Ranked lexical search: the best documents for each of many queries, by hashed max-sketches and exact rescoring.

The weight that a term adds to a document's score, its impact, is folded into a short sketch of the document: each
coordinate keeps the largest impact of the terms hashed to it. Looking up a query's terms in the sketch and adding what is
there bounds the document's score from above, for all queries and a block of documents in one matrix product. Each query then
takes documents in the order of falling bounds and scores them exactly, until the next bound is below its k-th best score.

Texts are read twice, each time where they lie: once to count documents, terms and how many documents hold each term of a
query, once to rank. A task hands on its own k best of each query, and these few rows are all that is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reweave.llm import bytewords as bw
from reweave.llm.common import own_columns

BLOCK_DOCS = 2048
RESCORED = 64
NO_ID = np.iinfo(np.int64).max


class Terms:
    """The distinct terms of some queries by their hashes, and which of them each query has."""

    def __init__(self, texts: list[bytes]):
        data, at = bw.texts(pa.array(texts, pa.large_binary()), lower=True)
        starts, ends, first = bw.words(data, at, bw.WORDLIKE)
        hashes = bw.range_hashes(data, starts, ends)
        self.known = np.unique(hashes)
        self.queries = [np.unique(np.searchsorted(self.known, hashes[a:b])) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
        self.flags = np.zeros(1 << 20, bool)
        self.flags[(self.known >> bw.U(44)).astype(np.int64)] = True

    def count(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(terms of each text, with repeats; sorted text * len(known) + term of each query term in it; its occurrences)."""
        data, at = bw.texts(column, lower=True)
        starts, ends, first = bw.words(data, at, bw.WORDLIKE)
        hashes = bw.range_hashes(data, starts, ends)
        word = np.flatnonzero(self.flags[(hashes >> bw.U(44)).astype(np.int64)])
        term = np.searchsorted(self.known, hashes[word])
        found = self.known[np.minimum(term, len(self.known) - 1)] == hashes[word] if len(self.known) else np.zeros(0, bool)
        word, term = word[found], term[found]
        text = np.searchsorted(first, word, side="right") - 1
        keys, often = np.unique(text * max(1, len(self.known)) + term, return_counts=True)
        return np.diff(first), keys, often


def _statistics(rows: DataFrame, shared: object) -> tuple[int, int, np.ndarray]:
    """(documents with terms, all their terms, documents holding each query term), from one row a task and term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        holding, texts, length = np.zeros(len(terms.known), np.int64), 0, 0
        for batch in bw.small(batches, "text"):
            sizes, keys, _ = terms.count(batch.column("text"))
            texts, length = texts + int((sizes > 0).sum()), length + int(sizes.sum())
            holding += np.bincount(keys % max(1, len(holding)), minlength=len(holding))[: len(holding)]
        own = np.flatnonzero(holding)
        columns = [np.concatenate([[-2, -1], own]), np.concatenate([[texts, length], holding[own]])]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["term", "n"])

    out, all_texts, all_terms = np.zeros(len(shared.value.known), np.int64), 0, 0
    for r in rows.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        if r["term"] == -2:
            all_texts = r["n"]
        elif r["term"] == -1:
            all_terms = r["n"]
        else:
            out[r["term"]] = r["n"]
    return all_texts, all_terms, out


class Best:
    """The k best documents of a query: highest score first, equal ones by ascending id, without an id last."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """What a document must reach to be looked at: its score may equal the last one's, with a smaller id."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.k]
        order = order[scores[order] > 0]
        self.scores, self.ids = scores[order], ids[order]


def rescore(bounds: np.ndarray, ids: np.ndarray, exact: object, best: Best) -> int:
    """Takes rows by falling bound, scores them by `exact` and stops where no bound reaches the k-th best score; how many
    were scored."""
    rows = np.flatnonzero(bounds >= best.least)
    rows, done = rows[np.argsort(-bounds[rows], kind="stable")], 0
    while done < len(rows) and bounds[rows[done]] >= best.least:
        own = rows[done : done + RESCORED]
        best.add(exact(own), ids[own])
        done += len(own)
    return done


def _ranked(rows: DataFrame, shared: object, items: list, k: int, width: int) -> DataFrame:
    texts, all_terms, holding = _statistics(rows, shared)
    weight = np.array([math.floor(1000 * math.log((2 * texts + 2) / (2 * n + 1))) for n in holding.tolist()], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        n_terms = max(1, len(terms.known))
        place = (bw.mix(terms.known) % bw.U(width)).astype(np.int64)
        looked = np.zeros((width, len(terms.queries)))
        for q, own in enumerate(terms.queries):
            np.add.at(looked[:, q], place[own], 1)
        best = [Best(k) for _ in terms.queries]
        for batch in bw.small(batches, "text"):
            sizes, keys, often = terms.count(batch.column("text"))
            doc, term = keys // n_terms, keys % n_terms
            norm = 10 + (90 * sizes * texts) // max(1, all_terms)
            impact = weight[term] * ((1_000_000_000 * often) // (1000 * often + 8 * norm[doc]))
            ids = batch.column("doc_id").fill_null(NO_ID).to_numpy()
            for a in range(0, len(ids), BLOCK_DOCS):
                b = min(a + BLOCK_DOCS, len(ids))
                i, j = np.searchsorted(keys, [a * n_terms, b * n_terms])
                sketch = np.zeros((b - a) * width)
                np.maximum.at(sketch, (doc[i:j] - a) * width + place[term[i:j]], impact[i:j])
                bounds = sketch.reshape(b - a, width) @ looked  # whole numbers below 2**53, so exact
                own_keys, own_impact = keys[i:j], np.append(impact[i:j], 0)
                for q in np.flatnonzero((bounds >= [x.least for x in best]).any(axis=0)).tolist():

                    def exact(rows: np.ndarray, q: int = q) -> np.ndarray:
                        want = (rows[:, None] + a) * n_terms + terms.queries[q][None, :]
                        at = np.searchsorted(own_keys, want)
                        there = np.append(own_keys, -1)[at] == want
                        return np.where(there, own_impact[at], 0).sum(axis=1)

                    rescore(bounds[:, q], ids[a:b], exact, best[q])
        which = np.repeat(np.arange(len(best)), [len(x.ids) for x in best])
        if len(which):
            found = np.concatenate([x.ids for x in best])
            columns = [pa.array([items[q] for q in which.tolist()], pa.int64()), pa.array(found, pa.int64(), mask=found == NO_ID)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate([x.scores for x in best]), pa.int64())], ["item_id", "doc_id", "score"])

    return rows.mapInArrow(run, "item_id long, doc_id long, score long")


def lexical_search(
    docs: DataFrame,
    queries: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    item_col: str = "item_id",
    k: int = 10,
    width: int = 1024,
    max_terms: int = 1_000_000,
) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the `k` highest-scoring rows of `docs` for each row of `queries`.

    Terms are runs of letters, digits and characters beyond ASCII, A-Z lower-cased, told apart by 64-bit hashes. With N the
    documents that hold any term, L all their terms, n those of one document, df the documents that hold a term and tf its
    occurrences in one, a term weighs w = floor(1000 ln((2N + 2) / (2df + 1))), and a document's score is the sum of
    w * (10**9 tf div (1000 tf + 8 (10 + 90 n N div L))) over the query's distinct terms. Scores of 0 are left out.

    Equal scores rank by ascending id, rows without an id last. Rows of `docs` that share an id are ranked each for itself;
    rows of `queries` that share an id are one query with the terms of all of them (a null id is an id). Null, empty and
    wordless texts hold no terms: as documents they count nowhere, as queries they have no rows. Empty tables give no rows.

    Tasks hold the terms of at most `max_terms` query words at a time; more are split into parts by a hash of the query's
    id, and texts are read for each part.
    """
    rows = own_columns(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    asked = own_columns(queries, item_id=item_col, text=text_col).withColumn("item_id", F.col("item_id").cast("long"))
    total = asked.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n"), F.count(F.lit(1)).alias("k")).first()
    parts = max(1, -(-(int(total["n"] or 0) // 2 + int(total["k"])) // max_terms))
    found = []
    for part in range(parts):
        own = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
        texts: dict = {}
        for r in own.collect():  # bounded by max_terms
            texts.setdefault(r["item_id"], []).append((r["text"] or "").encode())
        shared = docs.sparkSession.sparkContext.broadcast(Terms([b" ".join(t) for t in texts.values()]))
        found.append(_ranked(rows, shared, list(texts), k, width))
    best = reduce(lambda a, b: a.unionByName(b), found)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    some = Window.partitionBy("item_id", F.pmod(F.xxhash64("doc_id"), F.lit(32))).orderBy(*order)  # no query's rows meet in one task at once
    best = best.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= k).drop("rank")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
