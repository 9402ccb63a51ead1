"""An embedder without a model: words and runs of letters, hashed with a sign into a vector and weighted by rarity.

A text's features are its tokens and the runs of three to five characters of every token (with
marks at its ends).  Every feature adds ``sign * sqrt(count) * idf`` to one place of the vector;
place, sign and the slot of its document frequency come from one 64-bit hash.  Frequencies are
counted over a corpus in ``SLOTS`` slots, so that they are of a size that doesn't grow.  Both
sides of a search use the same embedder.  Texts without tokens are zero vectors.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.session import bounded_batches

SLOTS, WIDTH, SHORTEST, LONGEST = 1 << 17, 256, 3, 5
_BASE, _STEP, _WHOLE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


class Features:
    """Hashes of the features of a text's tokens, all tokens at once."""

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The distinct features of a text and how often each occurs; a token has a feature once."""
        tokens = Counter(tx.token_list(text))
        if not tokens:
            return np.zeros(0, np.uint64), np.zeros(0)
        found, owner = hashes(list(tokens))
        order = np.argsort(found, kind="stable")  # owners of the same feature stay in order
        found, owner = found[order], owner[order]
        new = np.append(True, found[1:] != found[:-1])
        once = new | np.append(True, owner[1:] != owner[:-1])
        times = np.fromiter(tokens.values(), float, len(tokens))
        return found[new], np.bincount(np.cumsum(new)[once] - 1, times[owner[once]])


def hashes(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens and of the runs in them, and which token each is of.

    A run's hash mixes a polynomial of its code points and its length; a whole token's has a mark of its own.
    """
    marked = "".join(f"<{t}>" for t in tokens)
    points = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    size = np.fromiter((len(t) + 2 for t in tokens), np.int64, len(tokens))
    first = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(tokens)), size)
    left = np.repeat(first + size, size) - np.arange(len(points))  # characters to the token's end
    found, owners, runs = [], [], np.zeros(len(points), np.uint64)
    for n in range(1, LONGEST + 1):
        runs = runs[: len(points) - n + 1] * _BASE + points[n - 1 :]
        if n >= SHORTEST:
            whole = left[: len(runs)] >= n
            found.append(_mixed(runs[whole] + np.array([n], np.uint64) * _STEP))
            owners.append(owner[: len(runs)][whole])
    place = np.arange(len(points)) - np.repeat(first, size)
    power = np.multiply.accumulate(np.append(np.uint64(1), np.full(int(size.max()) - 1, _BASE)))
    found.append(_mixed(np.add.reduceat(points * power[place], first) + size.astype(np.uint64) * _STEP + _WHOLE))
    return np.concatenate(found), np.concatenate([*owners, np.arange(len(tokens))])


def _mixed(x: np.ndarray) -> np.ndarray:
    """All bits of a hash depend on all of its input (splitmix64's finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def learn(corpus: DataFrame, text: str = "text") -> np.ndarray:
    """Inverse document frequencies by slot over all texts of a corpus."""

    bounded_batches(corpus.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, docs = np.zeros(SLOTS, np.int64), 0
        for batch in batches:
            for t in batch["text"]:
                if tokens := set(tx.token_list(t)):
                    held = np.zeros(SLOTS, bool)
                    held[(hashes(list(tokens))[0] % np.uint64(SLOTS)).astype(np.int64)] = True
                    seen += held
                docs += 1
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"slot": np.append(at, -1), "n": np.append(seen[at], docs)})

    rows = corpus.select(F.col(text).alias("text")).mapInPandas(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # SLOTS rows at most
    docs = int(rows.loc[rows["slot"] == -1, "n"].sum())
    seen = np.zeros(SLOTS)
    rows = rows[rows["slot"] >= 0]
    seen[rows["slot"].to_numpy()] = rows["n"]
    return np.log((1 + docs) / (1 + seen)) + 1


def vector(features: Features, text: str | None, idf: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The vector of one text, of length 1 unless it is zero."""
    found, times = features.counts(text)
    weights = np.sqrt(times) * idf[(found % np.uint64(SLOTS)).astype(np.int64)]
    signs = np.where((found >> np.uint64(63)).astype(bool), 1.0, -1.0)
    out = np.bincount(((found >> np.uint64(20)) % np.uint64(width)).astype(np.int64), signs * weights, width)
    length = np.linalg.norm(out)
    return out / length if length > 0 else out


def embedder(df: DataFrame, idf: np.ndarray, width: int = WIDTH):
    """A function from a text column to a column of vectors, under frequencies that are broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(idf)

    def encode(text: Column) -> Column:
        @F.pandas_udf("array<double>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            features = Features()
            for texts in batches:
                yield pd.Series([vector(features, t, shared.value, width) for t in texts], dtype=object)

        return run.asNondeterministic()(text)  # else a filter on the vectors would make them once more

    return encode
