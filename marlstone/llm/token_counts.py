"""Token counts under a unigram model, with scores shared along a trie of pre-tokens.

A pre-token's count is the number of pieces in its likeliest segmentation.  The forward score
of a prefix (the best log-probability of reaching its end, and the pieces used) depends on
nothing behind it, so pre-tokens with a common prefix share its scores: distinct pre-tokens
are inserted in a trie that a worker keeps over its batches, a node is scored when it is first
reached, and the count at every terminal goes into a bounded memo.  A full trie starts anew;
that changes no count.  Words of more than ``LONG_WORD`` characters share nothing worth keeping:
their forward pass holds only the scores that a piece can still reach back to.

The pieces come from a public vocabulary file in rank order; no tokenizer is trained.  Rank r
(from 0) of n pieces has probability 1 / ((r + 1) H(n)), kept as whole micro-nats so that sums
are exact; equal scores go to fewer pieces.  Every single byte is a piece, so every text can
be segmented.  Null and empty texts have no tokens.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.memo import Memo

MEMO_WORDS, TRIE_NODES = 300_000, 400_000
LONG_WORD = 1_024
# fixed value: contractions, words and numbers and symbols with the blank before them, other white space
PRETOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Unigram:
    """Costs of byte pieces, read from a vocabulary of lines ``base64 rank``."""

    def __init__(self, vocabulary: bytes, pretoken: str = PRETOKEN):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        norm = math.log(math.fsum(1 / (r + 1) for r in range(len(ranks))))
        self.cost = {piece: round(1e6 * (math.log(r + 1) + norm)) for piece, r in ranks.items()}
        missing = [b for b in range(256) if bytes([b]) not in self.cost]
        if missing:
            raise ValueError(f"the vocabulary lacks single bytes: {missing[:5]}")
        self.reach = [1] * 256  # the longest piece that ends with a byte
        for piece in ranks:
            self.reach[piece[-1]] = max(self.reach[piece[-1]], len(piece))
        self.pretoken = regex.compile(pretoken)
        self.memo = Memo(MEMO_WORDS)
        self._clear()

    def terminal_counts(self, words: Iterable[bytes]) -> dict[bytes, int]:
        """Pieces in the best segmentation of every word."""
        return {word: self._insert(word) for word in words}

    def _insert(self, word: bytes) -> int:
        if len(self.score) > TRIE_NODES:
            self._clear()
        edges, score, used, cost = self.edges, self.score, self.used, self.cost.get
        node, path = 0, [0]
        for end, byte in enumerate(word, 1):
            edge = node << 8 | byte
            node = edges.get(edge)
            if node is None:
                best = most = None
                for start in range(max(0, end - self.reach[byte]), end):
                    c = cost(word[start:end])
                    if c is not None:
                        at = path[start]
                        s, n = score[at] + c, used[at] + 1
                        if best is None or s < best or s == best and n < most:
                            best, most = s, n
                node = edges[edge] = len(score)
                score.append(best)
                used.append(most)
            path.append(node)
        return used[node]

    def long_count(self, word: bytes) -> int:
        """Pieces in the best segmentation of a word of any length, in room for the longest piece."""
        cost, room = self.cost.get, max(self.reach) + 1
        score, used = [0] * room, [0] * room
        for end, byte in enumerate(word, 1):
            best = most = None
            for start in range(max(0, end - self.reach[byte]), end):
                c = cost(word[start:end])
                if c is not None:
                    at = start % room
                    s, n = score[at] + c, used[at] + 1
                    if best is None or s < best or s == best and n < most:
                        best, most = s, n
            score[end % room], used[end % room] = best, most
        return used[len(word) % room]

    def _clear(self) -> None:
        """The root alone: nodes have the score and the pieces of their prefix, ``edges`` a child by node and byte."""
        self.edges: dict[int, int] = {}
        self.score, self.used = [0], [0]

    def count_batch(self, texts: list[str | None]) -> Iterator[tuple[int, int]]:
        """Tokens and pre-tokens of every text."""
        cut, pending = [], 0
        for i, text in enumerate(texts):
            cut.append(self.pretoken.findall(text or ""))
            pending += len(cut[-1])
            if pending > 300_000 or i == len(texts) - 1:
                words = set().union(*cut)
                long = {w: self.long_count(w.encode("utf-8", "surrogatepass")) for w in words if len(w) > LONG_WORD}
                fresh = self.memo.missing(words - long.keys())
                known = self.memo.young
                by_bytes = {w.encode("utf-8", "surrogatepass"): w for w in fresh}
                for raw, n in self.terminal_counts(by_bytes).items():
                    known[by_bytes[raw]] = n
                for words in cut:
                    yield sum(long[w] if w in long else known[w] for w in words) if long else sum(map(known.__getitem__, words)), len(words)
                cut, pending = [], 0


_loaded: dict[str, Unigram] = {}


def _model(vocabulary: bytes) -> Unigram:
    key = hashlib.sha256(vocabulary).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Unigram(vocabulary)
    return _loaded[key]


def count_tokens(df: DataFrame, vocabulary_path: str, text: str = "text") -> DataFrame:
    """Add ``n_tokens`` and ``n_pretokens`` (longs) for every whole text, replacing columns of these names.

    The vocabulary file (a few MB) is read on the driver and broadcast.
    """
    with open(vocabulary_path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("n_tokens long, n_pretokens long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = _model(shared.value)
        for texts in batches:
            yield pd.DataFrame(list(model.count_batch(texts.tolist())), columns=["n_tokens", "n_pretokens"], dtype="int64")

    kept = [c for c in df.columns if c not in ("n_tokens", "n_pretokens")]
    rows = df.select(F.struct(*kept).alias("row"), run(F.col(text)).alias("counts"))
    return rows.select("row.*", "counts.n_tokens", "counts.n_pretokens")
