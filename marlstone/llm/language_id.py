"""Language identification by rank-order n-gram profiles.

A profile is the list of a language's most frequent character n-grams (one to three letters,
words padded with a blank), most frequent first.  A document's own most frequent n-grams are
compared with each profile by the out-of-place distance: the sum over the document's n-grams
of how far the rank in the profile is from the rank in the document, an absent n-gram counting
as the profile's full length.  The nearest profile wins; equal distances go to the first
language in code point order.

Profiles are broadcast, ``MAX_LANGUAGES`` at a time; more languages take more passes over the
n-grams of a text, each of which hands on its two nearest.

Counting is exact over all whole texts.  A null text, or one without letters, is ``und`` with
score 0, as is every text when nothing was learned.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.memo import of_worker
from marlstone.llm.storage import Scratch

UNDETERMINED = "und"
PROFILE_SIZE = 300
MAX_LANGUAGES = 1000
_BITS = 21  # of a code point plus one
_FLUSH = 400_000  # distinct n-grams that a learning task holds per language

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _letters


def ngrams(text: str | None) -> np.ndarray:
    """Packed codes of a text's n-grams of one to three characters, with repeats."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letter_table()[points]
    if not letter.any():
        return np.zeros(0, np.int64)
    codes = np.ones(points.size + 2, np.int64)  # 1 is a blank
    codes[1:-1][letter] = points[letter].astype(np.int64) + 2
    keep = np.ones(codes.size, bool)
    keep[1:] = (codes[1:] != 1) | (codes[:-1] != 1)
    codes = codes[keep]
    blank = codes == 1
    pairs = codes[:-1] << _BITS | codes[1:]
    triples = pairs[:-1] << _BITS | codes[2:]
    return np.concatenate([codes[~blank], pairs, triples[~blank[1:-1]]])


def counted(codes: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, with their counts."""
    if weights is None:
        codes = np.sort(codes)
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        return codes[first], np.diff(np.append(first, codes.size))
    order = np.argsort(codes, kind="stable")
    codes, weights = codes[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.add.reduceat(weights, first)


def _top(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, most frequent first, ties by code."""
    if codes.size > size:
        least = np.partition(counts, counts.size - size)[counts.size - size]
        sure = counts >= least
        codes, counts = codes[sure], counts[sure]
    return codes[np.argsort(-counts, kind="stable")][:size]


def learn_profiles(df: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE_SIZE) -> DataFrame:
    """Profiles (``lang, rank, code, n``) from every row whose text and language are not null.

    Each task adds up its own n-grams before the shuffle, so what is shuffled is the number of
    distinct n-grams per language and task, whatever one language's share of the rows.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[str, list[np.ndarray]] = {}

        def fold(name: str) -> None:
            codes, counts = held.get(name, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
            parts = [counted(np.concatenate(waiting.pop(name)))]
            held[name] = counted(np.concatenate([codes, parts[0][0]]), np.concatenate([counts, parts[0][1]]))

        def out(name: str) -> pd.DataFrame:
            codes, counts = held.pop(name)
            return pd.DataFrame({"lang": name, "code": codes, "n": counts})

        for batch in batches:
            for name, value in zip(batch["lang"], batch["text"], strict=True):
                if (codes := ngrams(value)).size:
                    waiting.setdefault(name, []).append(codes)
                    if sum(map(len, waiting[name])) > 2_000_000:
                        fold(name)
            for name in [*waiting]:
                fold(name)
                if held[name][0].size > _FLUSH:
                    yield out(name)
        for name in [*held]:
            yield out(name)

    rows = df.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    counts = rows.mapInPandas(partial, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= size).select("lang", "rank", "code", "n")


class Profiles:
    """All languages' ranks by n-gram, for the out-of-place distance."""

    def __init__(self, langs: list[str], lang_at: np.ndarray, ranks: np.ndarray, codes: np.ndarray, size: int):
        self.langs, self.size = langs, size
        self.codes = np.unique(codes)
        self.ranks = np.full((self.codes.size + 1, len(langs)), -1, np.int64)  # the last row: n-grams in no profile
        self.ranks[np.searchsorted(self.codes, codes), lang_at] = ranks

    def distances(self, text: str | None) -> np.ndarray | None:
        """Mean out-of-place distance to each language, from 0 to 1; None without letters."""
        codes = ngrams(text)
        if not codes.size or not self.langs:
            return None
        mine = _top(*counted(codes), self.size)
        at = np.minimum(np.searchsorted(self.codes, mine), self.codes.size - 1)
        there = self.ranks[np.where(self.codes[at] == mine, at, self.codes.size)]
        own = np.arange(mine.size)[:, None]
        return np.where(there < 0, self.size, np.abs(there - own)).sum(axis=0) / (mine.size * self.size)

    def nearest(self, text: str | None) -> tuple[str | None, float | None, float | None]:
        """The nearest language, its distance, and that of the next (None where there is none)."""
        d = self.distances(text)
        if d is None:
            return None, None, None
        best = int(np.argmin(d))
        return self.langs[best], float(d[best]), float(np.partition(d, 1)[1]) if d.size > 1 else None


def identify(df: DataFrame, profiles: DataFrame, text: str = "text", size: int = PROFILE_SIZE) -> DataFrame:
    """Add ``lang_pred``, ``score`` (0 to 1) and ``distance`` (0 to 1) to every row.

    The score is the nearest profile's share of the closeness of the two nearest.  Profiles
    come to the driver and are broadcast in blocks of about ``MAX_LANGUAGES`` languages.
    """
    spark, most = df.sparkSession, size * MAX_LANGUAGES
    whole = profiles.limit(most + 1).toPandas()
    if len(whole) <= most:
        parts = [lambda: whole]
    else:
        profiles = Scratch(spark, "profiles").keep(profiles, "all")
        blocks = -(-profiles.select("lang").distinct().count() // MAX_LANGUAGES)
        dealt = profiles.withColumn("block", F.pmod(F.xxhash64("lang"), F.lit(blocks)))
        parts = [lambda b=b: dealt.where(F.col("block") == b).toPandas() for b in range(blocks)]

    def nearest(rows: pd.DataFrame):
        langs = sorted(set(rows["lang"]))
        at = {name: i for i, name in enumerate(langs)}
        shared = spark.sparkContext.broadcast((langs, rows["lang"].map(at).to_numpy(np.int64), rows["rank"].to_numpy(np.int64) - 1, rows["code"].to_numpy(np.int64), size))

        @F.pandas_udf("lang string, near double, next double")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            of_worker("language_id")
            model = Profiles(*shared.value)
            for texts in batches:
                yield pd.DataFrame([model.nearest(x) for x in texts], columns=["lang", "near", "next"])

        return run(F.col(text))

    kept = [c for c in df.columns if c not in ("lang_pred", "score", "distance")]
    rows = df.select(F.struct(*kept).alias("row"), *[nearest(part()).alias(f"found{b}") for b, part in enumerate(parts)])
    each = [F.col(f"found{b}") for b in range(len(parts))]
    best = F.array_min(F.filter(F.array(*[F.struct(x["near"].alias("near"), x["lang"].alias("lang")) for x in each]), lambda x: x["lang"].isNotNull()))
    second = F.get(F.array_sort(F.filter(F.array(*[x[c] for x in each for c in ("near", "next")]), lambda d: d.isNotNull())), 1)
    rows = rows.select("row", best.alias("best"), second.alias("second"))
    near, other = 1 - F.col("best.near"), F.coalesce(1 - F.col("second"), F.lit(0.0))
    score = F.when(near + other > 0, near / (near + other)).otherwise(F.lit(0.0))
    return rows.select("row.*", F.coalesce("best.lang", F.lit(UNDETERMINED)).alias("lang_pred"), F.coalesce(score, F.lit(0.0)).alias("score"), F.coalesce("best.near", F.lit(1.0)).alias("distance"))
