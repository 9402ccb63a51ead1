"""Toxicity scores from gradient-boosted trees over dense features, isotonically calibrated.

Learning has three parts on three disjoint folds of the labelled rows: a lexicon of words and
word beginnings that toxic documents use and clean ones do not, the trees over features of
that lexicon and of the writing, and the isotonic map from the trees' probability to the
share of toxic documents.  The labelled rows are a sample of bounded size (``max_rows``);
every document is scored by its whole text.

Null and empty texts have all features 0 and get a score like any other.  Several labels of
one key count as toxic if any is.  If the labelled rows hold fewer than two classes, or too few
to fill the folds, the model ranks nothing (``trees`` is None) and every score is the share of
toxic rows (0 without rows).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.memo import of_worker

MAX_ROWS = 20_000
LEXICON_SIZE = 2_000
STEM = 4
LEXICON_SPECIES = ("word", "stem")

# fixed values: pronouns of the second person
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deinen ihr euch euer tú ti usted ustedes vosotros tus su sus".split()
)
# fixed values: characters that stand for letters in disguised words; a one may be an l or an i
DISGUISES = (str.maketrans("013457@$!|", "oleastasil"), str.maketrans("013457@$!|", "oieastasil"))

FEATURES = ("word_hits", "word_strength", "word_density", "word_peak", "stem_hits", "stem_strength", "stem_density", "stem_peak", "hidden_hits", "hidden_rate", "near_second_person", "second_person", "capitals", "shouted", "punctuation", "exclamations", "disguised", "log_words")

_WORD = re.compile(r"[^\W_]+")
_RUN = re.compile(r"([^\W\d_]+)|([0-9@$!|*._\-]+)")  # letters, or what may stand between them
_MARKS = re.compile(r"[^\w\s]")
_NOT_LETTER = re.compile(r"[\W\d_]+")


def tangled(word: str) -> list[str]:
    """Letter runs that marks or digits join, and those with digits, @ or $ right before them, from left to right.

    One pass over the word's runs, whatever their length.
    """
    runs, out, i = [(m.start(), m.end(), m.lastindex == 1) for m in _RUN.finditer(word)], [], 0
    touch = lambda j: j < len(runs) and runs[j][0] == runs[j - 1][1]
    while i < len(runs):
        start, end, letters = runs[i]
        last = i
        if letters:
            while touch(last + 1) and touch(last + 2):  # runs that touch alternate
                last += 2
            if last > i:
                out.append(word[start : runs[last][1]])
        elif touch(i + 1):
            sign = len(word[start:end].rstrip("0123456789@$"))
            if start + sign < end:
                last = i + 1
                out.append(word[start + sign : runs[last][1]])
        i = last + 1
    return out


class Writing:
    """Dense features of texts under one lexicon (entries to log-odds of words and of beginnings).

    No feature but one looks beyond white space, so every distinct token is measured once and
    kept in a table of bounded size; a text's sums are those of its tokens.
    """

    TOKENS = 200_000

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = words, stems
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.table = np.zeros((1_024, 14))

    def _measure(self, token: str) -> tuple[float, ...]:
        low = token.lower()
        core = low.rstrip(".,;:!?")
        if core.isalpha():  # one word and the marks behind it
            word, stem = core in self.words, len(core) > STEM and core[:STEM] in self.stems
            odds, more = self.words[core] if word else 0.0, self.stems[core[:STEM]] if stem else 0.0
            capitals = 0 if token == low else sum(map(str.isupper, token))
            shout = capitals and len(core) > 2 and token[: len(core)].isupper()
            return (1, word, odds, stem, more, word or stem, core in SECOND_PERSON, 0, 0, capitals, shout, len(low) - len(core), odds, more)
        words = _WORD.findall(low)
        by_word = [self.words[w] for w in words if w in self.words]
        by_stem = [self.stems[w[:STEM]] for w in words if w[:STEM] in self.stems and len(w) > STEM]
        hits = sum(w in self.words or (w[:STEM] in self.stems and len(w) > STEM) for w in words)
        disguised = tangled(low)
        hidden = sum(any(_NOT_LETTER.sub("", x) in self.words for x in (t, *(t.translate(d) for d in DISGUISES))) for t in disguised)
        capitals = sum(map(str.isupper, token))
        shouted = sum(w.isupper() and len(w) > 2 for w in _WORD.findall(token)) if capitals else 0
        return (
            len(words), len(by_word), sum(by_word), len(by_stem), sum(by_stem), hits, sum(w in SECOND_PERSON for w in words),
            len(disguised), hidden, capitals, shouted, len(_MARKS.findall(token)), max(by_word, default=0.0), max(by_stem, default=0.0),
        )

    def _rows(self, tokens) -> list[int]:
        at = list(map(self.at.get, tokens))
        if None in at:
            if len(self.at) > self.TOKENS:
                self._clear()
            fresh = [t for t, known in zip(tokens, map(self.at.get, tokens), strict=True) if known is None]
            first, last = len(self.at), len(self.at) + len(fresh)
            self.at.update(zip(fresh, range(first, last), strict=True))
            while last > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[first:last] = [self._measure(t) for t in fresh]
            at = list(map(self.at.get, tokens))
        return at

    def features(self, text: str | None) -> list[float]:
        """Dense features of a whole text, in the order of ``FEATURES``."""
        text = text or ""
        counts = Counter(text.split())
        at = self._rows(counts)  # may put a larger table in place
        rows = self.table[at] if at else np.zeros((1, 14))
        sums = (np.fromiter(counts.values(), float, len(at)) @ rows).tolist() if at else rows[0].tolist()
        tokens, by_word, word_odds, by_stem, stem_odds, at, second, tangled, hidden, capitals, shouted, marks = sums[:12]
        word_peak, stem_peak = rows[:, 12].max(), rows[:, 13].max()
        n, chars = max(1, tokens), max(1, len(text))
        return [
            np.log1p(by_word), np.log1p(word_odds), word_odds / n, word_peak, np.log1p(by_stem), np.log1p(stem_odds), stem_odds / n, stem_peak,
            np.log1p(hidden), hidden / n, self._near(text) / at if at and second else 0.0, second / n if at else 0.0,
            capitals / chars, shouted / n, marks / chars, text.count("!") / n, tangled / n, np.log1p(tokens),
        ]

    def _near(self, text: str) -> int:
        """Hits of the lexicon with a second person among the three words on either side."""
        tokens = _WORD.findall(text.lower())
        second = np.concatenate([[0], np.cumsum([t in SECOND_PERSON for t in tokens])])
        hits = [i for i, t in enumerate(tokens) if t in self.words or (t[:STEM] in self.stems and len(t) > STEM)]
        return sum(second[min(len(tokens), i + 4)] > second[max(0, i - 3)] for i in hits)


def features(text: str | None, words: dict[str, float], stems: dict[str, float]) -> list[float]:
    """Dense features of one text; lexicons map entries to log-odds."""
    return Writing(words, stems).features(text)


def learn_lexicon(rows: DataFrame, size: int = LEXICON_SIZE, support: int = 4, odds: float = 8.0) -> DataFrame:
    """``species, entry, log_odds``: words and beginnings whose document rate is ``odds`` times higher in toxic rows.

    ``rows`` has ``text`` and ``toxic``.  At most ``size`` entries of each species are kept,
    those with the highest log-odds first.
    """

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                seen = set(_WORD.findall((text or "").lower()))
                out += [("word", w, toxic) for w in seen]
                out += [("stem", w, toxic) for w in {w[:STEM] for w in seen if len(w) > STEM}]
            frame = pd.DataFrame(out, columns=["species", "entry", "toxic"])
            yield frame.groupby(["species", "entry"], as_index=False).agg(toxic_docs=("toxic", "sum"), docs=("toxic", "size"))

    totals = rows.agg(F.sum("toxic").alias("all_toxic"), F.count(F.lit(1)).alias("all_docs"))
    found = rows.select("text", F.col("toxic").cast("long").alias("toxic")).mapInPandas(entries, "species string, entry string, toxic_docs long, docs long")
    found = found.groupBy("species", "entry").agg(F.sum("toxic_docs").alias("toxic_docs"), F.sum("docs").alias("docs"))
    ratio = ((F.col("toxic_docs") + 0.5) / (F.col("all_toxic") + 1)) / ((F.col("docs") - F.col("toxic_docs") + 0.5) / (F.col("all_docs") - F.col("all_toxic") + 1))
    ranked = found.where(F.col("toxic_docs") >= support).join(F.broadcast(totals)).withColumn("ratio", ratio).where(F.col("ratio") >= odds)
    both = None
    for species in LEXICON_SPECIES:
        top = ranked.where(F.col("species") == species).orderBy(F.desc("ratio"), "entry").limit(size).select("species", "entry", F.log("ratio").alias("log_odds"))
        both = top if both is None else both.unionByName(top)
    return both


def add_features(df: DataFrame, lexicon: list[tuple[str, str, float]], text: str = "text", out: str = "features") -> DataFrame:
    """Add the feature vector of every row; ``lexicon`` is at most ``LEXICON_SIZE`` entries of each species."""
    shared = df.sparkSession.sparkContext.broadcast(lexicon)
    schema = ", ".join(f"{name} double" for name in FEATURES)

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        of_worker("toxicity")
        writing = Writing(*({e: odds for s, e, odds in shared.value if s == species} for species in LEXICON_SPECIES))
        for texts in batches:
            yield pd.DataFrame([writing.features(t) for t in texts], columns=list(FEATURES), dtype=float)

    kept = [c for c in df.columns if c != out]
    rows = df.withColumn("_dense", run(F.col(text))).select(*kept, *[F.col(f"_dense.{c}").alias(f"_f_{c}") for c in FEATURES])
    vectors = VectorAssembler(inputCols=[f"_f_{c}" for c in FEATURES], outputCol=out).transform(rows)
    return vectors.select(*kept, out)


class ToxicityModel:
    """A lexicon, trees and a calibration map; ``score`` applies them to any table of texts."""

    def __init__(self, lexicon, trees, calibration, constant: float = 0.0):
        self.lexicon, self.trees, self.calibration, self.constant = lexicon, trees, calibration, constant

    def score(self, df: DataFrame, text: str = "text") -> DataFrame:
        """Add ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on), replacing columns of these names."""
        kept = [c for c in df.columns if c not in ("score", "predicted")]
        if self.trees is None:
            scored = df.select(*kept, F.lit(float(self.constant)).alias("score"))
        else:
            rows = add_features(df.select(F.struct(*kept).alias("_row"), F.col(text).alias("_text")), self.lexicon, "_text", out="_features")
            rows = self.trees.transform(rows).withColumn("_p", vector_to_array("_probability")[1])
            scored = self.calibration.transform(rows).select("_row.*", F.least(F.greatest("_calibrated", F.lit(0.0)), F.lit(1.0)).alias("score"))
        return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def train(df: DataFrame, labels: DataFrame, scratch, key: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS, seed: int = 11) -> ToxicityModel:
    """Learn from the rows of ``df`` that have a label.

    About ``max_rows`` labelled rows are used, chosen by a hash of their key; their labels are
    broadcast.  The folds are dealt by the same hash: half for the lexicon, three tenths for
    the trees, one fifth for the calibration.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("int").alias("toxic"))
    available = known.count()
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("_key").cast("string")), F.lit(1_000_000)) / 1_000_000
    known = known.withColumn("_draw", draw).where(F.col("_draw") < min(1.0, max_rows / max(1, available))).limit(2 * max_rows)
    fold = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("_key").cast("string")), F.lit(10)).cast("int")
    rows = df.select(F.col(key).alias("_key2"), F.col(text).alias("text")).join(F.broadcast(known), F.col("_key2") == F.col("_key"))
    rows = scratch.keep(rows.select("text", "toxic", fold.alias("fold")), "labelled")
    share = rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("fold").between(5, 7)).alias("trees"), F.count_if(F.col("fold") >= 8).alias("calibration")).collect()
    by = {r["toxic"]: r for r in share}
    total = sum(r["n"] for r in share)
    if len(by) < 2 or min(min(r["trees"], r["calibration"]) for r in share) < 1:
        return ToxicityModel([], None, None, by[1]["n"] / total if 1 in by and total else 0.0)
    lexicon = [(r["species"], r["entry"], r["log_odds"]) for r in learn_lexicon(rows.where("fold < 5")).collect()]
    learned = add_features(rows.where("fold >= 5").select("text", "toxic", "fold"), lexicon).select("features", "toxic", "fold")
    learned = scratch.keep(learned.coalesce(4), "features")
    learner = GBTClassifier(labelCol="toxic", featuresCol="features", maxIter=20, maxDepth=3, stepSize=0.2, seed=seed)
    learner.setProbabilityCol("_probability").setRawPredictionCol("_raw").setPredictionCol("_prediction")
    trees = learner.fit(learned.where("fold < 8"))
    trees.setFeaturesCol("_features")
    held = trees.copy().setFeaturesCol("features").transform(learned.where("fold >= 8")).withColumn("_p", vector_to_array("_probability")[1])
    calibration = IsotonicRegression(featuresCol="_p", labelCol="toxic", predictionCol="_calibrated").fit(held.select("_p", F.col("toxic").cast("double").alias("toxic")))
    return ToxicityModel(lexicon, trees, calibration)
