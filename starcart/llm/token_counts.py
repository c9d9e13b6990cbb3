"""Token counts by a unigram model over a trie of pre-tokens (operator 1).

A text's pre-tokens are its white-space separated words with the word mark in front. The
best segmentation of a pre-token into vocabulary pieces is the one with the highest sum of
scores; its best score up to each position depends on the prefix alone. Distinct pre-tokens
are therefore inserted in a trie whose nodes hold the forward score of their prefix and the
number of pieces on its best path: a prefix shared by many words is scored once, and the
count at a word's last node is its answer. Texts are then counted by adding up terminal
counts.

Every Python worker grows its own trie over the texts it meets and starts anew when the trie
has ``nodes`` nodes, so memory is bounded and nothing is shuffled or sent to the driver.

Scores: the vocabulary file ranks its pieces and has no probabilities; by Zipf's law a piece
of rank r gets -log(r + 2). A character outside the vocabulary is spelled in byte pieces,
each scored as the last rank. Equal scores are decided for the longer last piece.

Edge cases: null and empty texts have no tokens, repeated rows are counted alike, an empty
table gives an empty result, other columns pass through (a column named like a result is
replaced).
"""

from __future__ import annotations

import math
from array import array
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache, fresh, texts, worker_value

MARK = "▁"


def load_scores(path: str) -> dict[str, float]:
    """Scores of the ordinary pieces of a sentencepiece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary = [
        model.id_to_piece(i) for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]
    return {piece: -math.log(rank + 2) for rank, piece in enumerate(ordinary)}


class PrefixTrie:
    """Forward scores and piece counts of prefixes; terminal counts of inserted pre-tokens."""

    def __init__(self, scores: dict[str, float], nodes: int = 800_000, words: int = 400_000):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.byte_score = -math.log(len(scores) + 2)
        self.limit = nodes
        self.terminals = BoundedCache(words)
        self._clear()

    def _clear(self) -> None:
        self.children: dict[tuple[int, str], int] = {}
        self.best, self.pieces = array("d", [0.0]), array("q", [0])

    def _extend(self, word: str, path: list[int], end: int) -> int:
        """A new node for ``word[:end]``, scored from the nodes on ``path``."""
        score, pieces = -math.inf, 0
        for start in range(max(0, end - self.longest), end):
            gain = self.scores.get(word[start:end])
            if gain is not None:
                parent = path[start]
                if self.best[parent] + gain > score:
                    score, pieces = self.best[parent] + gain, self.pieces[parent] + 1
        if word[end - 1] not in self.scores:
            size, parent = len(word[end - 1].encode()), path[end - 1]
            if self.best[parent] + size * self.byte_score > score:
                score, pieces = self.best[parent] + size * self.byte_score, self.pieces[parent] + size
        self.best.append(score)
        self.pieces.append(pieces)
        return len(self.best) - 1

    def insert(self, word: str) -> int:
        """Tokens of a pre-token."""
        path, children = [0], self.children
        for end in range(1, len(word) + 1):
            edge = (path[-1], word[end - 1])
            node = children.get(edge)
            if node is None:
                node = children[edge] = self._extend(word, path, end)
            path.append(node)
        count = self.pieces[path[-1]]
        if len(self.best) > self.limit:
            self._clear()
        return count

    def count(self, text: str) -> tuple[int, int]:
        """Pre-tokens and tokens of a text."""
        words = Counter(text.encode().split())
        self.terminals.fill(words, lambda new: [self.insert(MARK + w.decode()) for w in new])
        known = self.terminals
        return words.total(), sum(known[w] * n for w, n in words.items())


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with n_words and n_tokens for every row; ``path`` is a sentencepiece file."""

    @F.arrow_udf("n_words long, n_tokens long")
    def counted(column: pa.Array) -> pa.Array:
        trie = worker_value(("trie", path), lambda: PrefixTrie(load_scores(path)))
        rows = [trie.count(t) for t in texts(column)]
        return pa.StructArray.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["n_words", "n_tokens"]
        )

    kept = [c for c in docs.columns if c.lower() not in ("n_words", "n_tokens")]
    (both,) = fresh(docs, "_counted")
    return docs.withColumn(both, counted(F.col("text"))).select(*[F.col(f"`{c}`") for c in kept], f"{both}.n_words", f"{both}.n_tokens")
