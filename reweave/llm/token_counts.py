"""Token counts under a unigram model by dynamic programming over a trie of pre-tokens.

The distinct pre-tokens of a batch of texts are sorted, which walks their trie depth first: a prefix that several
pre-tokens share is scored once. Each trie node holds the least cost of cutting its prefix into vocabulary pieces
(the forward score), the number of pieces, and the pieces still under way; a terminal node stores its pre-token's count.
Nodes are held to a depth of `DEPTH` bytes; what a longer pre-token has beyond, an unbroken run of letters say, is scored
with its last node only, so that its length takes no memory.

A piece's cost comes from its rank in the vocabulary file by Zipf's law, -log(1 / (rank + 1)) in whole ten-thousandths,
so sums are exact; of cuts with equal cost the one with the fewest pieces counts.

Map-only: tries live within a task and are bounded by `cache_size`, beyond which they start afresh (counts stay the same).
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from reweave.llm import bytewords as bw
from reweave.llm.common import own_columns

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Bytes of a pre-token that others can share. Longer ones are scored from there on alone, with the same results.
DEPTH = 256


def read_pieces(path: str) -> dict[bytes, int]:
    """Piece -> cost, from a vocabulary file with a base64 piece and its rank in each line."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines)}
    return {piece: round(10_000 * math.log(rank + 2)) for piece, rank in ranks.items()}


class UnigramTrie:
    """Counts pieces of pre-tokens. Every single byte must be a piece."""

    def __init__(self, costs: dict[bytes, int]):
        self.step: dict[int, int] = {}
        self.cost: list[int | None] = [None]
        for piece, cost in costs.items():
            node = 0
            for b in piece:
                key = node << 8 | b
                if key not in self.step:
                    self.step[key] = len(self.cost)
                    self.cost.append(None)
                node = self.step[key]
            self.cost[node] = cost

    def counts(self, words: list[bytes]) -> dict[bytes, tuple[int, int]]:
        """word -> (pieces, cost) for all distinct `words`."""
        step, cost, out = self.step, self.cost, {}
        # for each prefix of the word at hand: (cost, pieces) and pieces under way as (node, cost before, pieces before)
        best, active = [(0, 0)], [[(0, 0, 0)]]
        last = b""
        for word in sorted(words):
            shared = 0
            for x, y in zip(last[:DEPTH], word):
                if x != y:
                    break
                shared += 1
            del best[shared + 1 :], active[shared + 1 :]
            score, pending = best[-1], active[-1]
            for at in range(shared, len(word)):
                b, under, least = word[at], [], None
                for node, c, n in pending:
                    node = step.get(node << 8 | b)
                    if node is not None:
                        under.append((node, c, n))
                        if (own := cost[node]) is not None and (least is None or (c + own, n + 1) < least):
                            least = (c + own, n + 1)
                under.append((0, *least))
                score, pending = least, under
                if at < DEPTH:
                    best.append(score)
                    active.append(pending)
            out[word] = (score[1], score[0])
            last = word
        return out


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str, cache_size: int = 400_000
) -> DataFrame:
    """doc_id, n_chars, n_pretokens, n_tokens and cost (in ten-thousandths) of each row's whole text.

    Null and empty texts have no tokens. `vocabulary` is the path of a vocabulary file on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, find, known = UnigramTrie(read_pieces(vocabulary)), regex.compile(PATTERN).findall, {}
        for batch in bw.small(batches, "text"):
            rows = [t or "" for t in batch.column("text").to_pylist()]
            tokens = [find(t) for t in rows]
            if len(known) > cache_size:
                known = {}
            new = {w for words in tokens for w in words if w not in known}
            found = trie.counts([w.encode() for w in new])
            known.update((w, found[w.encode()]) for w in new)
            sums = [(sum(known[w][0] for w in words), sum(known[w][1] for w in words)) for words in tokens]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(map(len, rows), pa.int64()),
                    pa.array(map(len, tokens), pa.int64()),
                    pa.array([s[0] for s in sums], pa.int64()),
                    pa.array([s[1] for s in sums], pa.int64()),
                ],
                ["doc_id", "n_chars", "n_pretokens", "n_tokens", "cost"],
            )

    return own_columns(docs, doc_id=id_col, text=text_col).mapInArrow(
        run, "doc_id long, n_chars long, n_pretokens long, n_tokens long, cost long"
    )
