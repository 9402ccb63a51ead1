"""Quality scores from a sparse ensemble of rules.

A text is described by statistics of its writing: lengths, repetition, capitals, marks, lines.
Shallow trees are grown on a bounded sample of labelled rows (``max_rows``); every path from a
root to a node is a rule, the conjunction of the comparisons along it.  A logistic regression
under an l1 penalty gives each rule a weight, mostly 0; the penalty is the one with the least
loss on a fold that neither trees nor weights have seen.  The rules left are compiled into one
column expression over the statistics: no model runs when texts are scored.

Null and empty texts have all statistics 0 and get a score like any other.  Several labels of
one key count as good if any is.  If the labelled rows hold fewer than two classes, or too few
to fill the folds, no rules are learned and every score is the share of good rows (0 without
rows).  Columns named ``score`` or ``predicted`` are replaced, all others kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ROWS, THRESHOLD = 20_000, 0.3
TREES, DEPTH, PENALTIES = 20, 3, (0.01, 0.003, 0.001)

STATISTICS = (
    "log_words", "word_length", "long_words", "short_words", "distinct_words", "distinct_runs", "commonest_word", "letters", "capitals", "upper_words", "digits", "marks", "doubled_marks",
    "symbol_words", "sentence_ends", "log_lines", "line_words", "repeated_lines", "blank",
)


class Describer:
    """Statistics of texts.  A token's own share is measured once and kept in a table of bounded size."""

    TOKENS = 200_000

    def __init__(self):
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.table = np.zeros((1_024, 10))

    @staticmethod
    def _measure(token: str) -> tuple[float, ...]:
        if token.isalpha() and token.islower():
            n = len(token)
            return (n, n > 12, n < 4, n, 0, 0, 0, 0, 0, 0)
        core = token.rstrip(".,;:!?")
        letters, capitals, digits = sum(map(str.isalpha, token)), sum(map(str.isupper, token)), sum(map(str.isdigit, token))
        marks = len(token) - letters - digits
        tail = token[len(token.rstrip("!?*#%&$.,;:|~=-_+^")) :]
        return (len(token), len(core) > 12, len(core) < 4, letters, capitals, capitals > 1 and capitals == letters, digits, marks, len(tail) > 1, letters + digits == 0)

    def _rows(self, tokens) -> list[int]:
        if len(self.at) > self.TOKENS:
            self._clear()
        fresh = [t for t in tokens if t not in self.at]
        first, last = len(self.at), len(self.at) + len(fresh)
        self.at.update(zip(fresh, range(first, last), strict=True))
        while last > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        if fresh:
            self.table[first:last] = [self._measure(t) for t in fresh]
        return list(map(self.at.__getitem__, tokens))

    def statistics(self, text: str | None) -> list[float]:
        """The statistics of a whole text, in the order of ``STATISTICS``."""
        text = text or ""
        tokens = text.split()
        if not tokens:
            return [0.0] * len(STATISTICS)
        counts = Counter(tokens)
        at, times = self._rows(counts), np.fromiter(counts.values(), float, len(counts))
        chars, long, short, letters, capitals, upper, digits, marks, doubled, symbols = (times @ self.table[at]).tolist()
        place = dict(zip(counts, range(len(counts)), strict=True))
        order = np.fromiter(map(place.__getitem__, tokens), np.uint64, len(tokens))
        runs = order[:-2] * np.uint64(0x9E3779B97F4A7C15) + order[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + order[2:] * np.uint64(0x165667B19E3779F9)
        lines = [line for line in text.split("\n") if line.strip()]
        n, ends = len(tokens), text.count(".") + text.count("!") + text.count("?")
        return [
            np.log1p(n), chars / n, long / n, short / n, len(counts) / n, np.unique(runs).size / runs.size if runs.size else 1.0, times.max() / n, letters / chars, capitals / max(1, letters), upper / n,
            digits / chars, marks / chars, doubled / n, symbols / n, ends / n, np.log1p(len(lines)), n / len(lines), 1 - len(set(lines)) / len(lines), 1 - chars / len(text),
        ]


def add_statistics(df: DataFrame, text: str = "text", out: str = "_statistics") -> DataFrame:
    """Add the statistics of every row's text as one struct."""
    schema = ", ".join(f"{name} double" for name in STATISTICS)

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        describer = Describer()
        for texts in batches:
            yield pd.DataFrame([describer.statistics(t) for t in texts], columns=list(STATISTICS), dtype=float)

    return df.withColumn(out, run(F.col(text)))


#: One comparison: the place of a statistic, whether it is to be at most the bound, the bound.
Rule = tuple[tuple[int, bool, float], ...]


def paths(node, above: Rule = ()) -> Iterator[Rule]:
    """The rules of a fitted tree: the comparisons from the root to every other node."""
    if above:
        yield _tightest(above)
    if node.subtreeDepth() == 0:
        return
    split = node.split()
    place, bound = split.featureIndex(), split.threshold()
    yield from paths(node.leftChild(), (*above, (place, True, bound)))
    yield from paths(node.rightChild(), (*above, (place, False, bound)))


def _tightest(rule: Rule) -> Rule:
    """The same rule with one bound for each statistic and side, in order."""
    best: dict[tuple[int, bool], float] = {}
    for place, at_most, bound in rule:
        held = best.setdefault((place, at_most), bound)
        best[place, at_most] = min(held, bound) if at_most else max(held, bound)
    return tuple((place, at_most, bound) for (place, at_most), bound in sorted(best.items()))


def condition(rule: Rule, statistics: str = "_statistics") -> Column:
    """A rule as a column expression over the struct of statistics."""
    whole = F.lit(True)
    for place, at_most, bound in rule:
        value = F.col(f"{statistics}.{STATISTICS[place]}")
        whole = whole & (value <= bound if at_most else value > bound)
    return whole


class RuleEnsemble:
    """Rules with their weights and an intercept; without rules, a constant score."""

    def __init__(self, rules: list[tuple[Rule, float]], intercept: float, constant: float = 0.0, threshold: float = THRESHOLD):
        self.rules, self.intercept, self.constant, self.threshold = rules, intercept, constant, threshold

    def expression(self, statistics: str = "_statistics") -> Column:
        """The score as one column expression."""
        if not self.rules:
            return F.lit(float(self.constant))
        held = F.array(*[F.when(condition(rule, statistics), F.lit(weight)).otherwise(F.lit(0.0)) for rule, weight in self.rules])  # an array: Spark compiles it in pieces
        return 1 / (1 + F.exp(-F.aggregate(held, F.lit(self.intercept), lambda total, x: total + x)))

    def score(self, df: DataFrame, text: str = "text") -> DataFrame:
        """Add ``score`` (0 to 1) and ``predicted`` (1 from the threshold on), replacing columns of these names."""
        kept = [c for c in df.columns if c not in ("score", "predicted")]
        rows = df.select(F.struct(*kept).alias("_row"), F.col(text).alias("_text"))
        if self.rules:
            rows = add_statistics(rows, "_text")
        scored = rows.select("_row", self.expression().alias("score"))
        return scored.select(*[F.col("_row")[c].alias(c) for c in kept], "score", (F.col("score") >= self.threshold).cast("int").alias("predicted"))


def _held(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """``label, fold`` and the vector of which rules hold."""
    return rows.select("label", "fold", array_to_vector(F.array(*[condition(r).cast("double") for r in rules])).alias("rules"))


def train(df: DataFrame, labels: DataFrame, scratch, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = MAX_ROWS, seed: int = 13) -> RuleEnsemble:
    """Learn from the rows of ``df`` that have a label.

    About ``max_rows`` labelled rows are used, chosen by a hash of their key; their labels are
    broadcast.  The folds are dealt by the same hash: half for the trees, half again for the
    weights, of which a fifth chooses the penalty.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("int").alias("label"))
    available = known.count()
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("_key").cast("string")), F.lit(1_000_000)) / 1_000_000
    known = known.where(draw < min(1.0, max_rows / max(1, available))).limit(2 * max_rows)
    fold = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("_key").cast("string")), F.lit(10)).cast("int")
    rows = df.select(F.col(key).alias("_key2"), F.col(text).alias("text")).join(F.broadcast(known), F.col("_key2") == F.col("_key"))
    rows = add_statistics(rows.select("text", "label", fold.alias("fold"))).select("label", "fold", "_statistics")
    rows = scratch.keep(rows, "statistics")
    share = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("fold") < 5).alias("trees"), F.count_if(F.col("fold").between(5, 8)).alias("weights"), F.count_if(F.col("fold") == 9).alias("choice")).collect()
    by, total = {r["label"]: r["n"] for r in share}, sum(r["n"] for r in share)
    if set(by) != {0, 1} or min(min(r["trees"], r["weights"]) for r in share) < 1:
        return RuleEnsemble([], 0.0, by.get(1, 0) / total if total else 0.0)
    rows = scratch.keep(rows.coalesce(2), "together")
    vectors = VectorAssembler(inputCols=[f"_f_{c}" for c in STATISTICS], outputCol="features").transform(rows.select("label", "fold", *[F.col(f"_statistics.{c}").alias(f"_f_{c}") for c in STATISTICS]))
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, subsamplingRate=0.7, featureSubsetStrategy="onethird", minInstancesPerNode=4, seed=seed)
    grown = forest.fit(vectors.where("fold < 5").select("label", "features"))
    rules = sorted({rule for tree in grown.trees for rule in paths(tree._java_obj.rootNode())})
    if not rules:
        return RuleEnsemble([], 0.0, by[1] / total)
    held = scratch.keep(_held(rows.where("fold >= 5"), rules), "rules")
    fitting, choice = held.where("fold < 9").cache(), held.where("fold = 9")
    best = None
    for penalty in PENALTIES:
        learner = LogisticRegression(labelCol="label", featuresCol="rules", elasticNetParam=1.0, regParam=penalty, maxIter=40, standardization=False)
        fitted = learner.fit(fitting)
        loss = fitted.transform(choice).select("label", vector_to_array("probability")[1].alias("p")).agg(F.avg(-F.log(F.greatest(F.when(F.col("label") == 1, F.col("p")).otherwise(1 - F.col("p")), F.lit(1e-12))))).first()[0]
        if best is None or (loss is not None and loss < best[0]):
            best = (loss if loss is not None else float("inf"), fitted)
    fitting.unpersist()
    weights = best[1].coefficients.toArray()
    chosen = [(rules[i], float(weights[i])) for i in np.flatnonzero(weights)]
    return RuleEnsemble(chosen, float(best[1].intercept), by[1] / total)
