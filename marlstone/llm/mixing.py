"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target number of words.  A document's expected number of copies is its
source's target over its source's size; the whole part is taken for certain, the fraction is
rounded.  Rounding pairs two documents of a source and moves words from one fraction to the
other, in a random direction chosen so that no expectation changes, until one of the two is a
whole number of copies.  The words of the pair together stay the same, so a source's taken
words differ from its target by less than one document.

Documents are dealt into small groups within their source, each group leaves at most one
fraction, and these residuals are combined in a reduction tree of Spark stages.  Randomness
comes from hashes of a seed and the document ids, so reruns agree.

Null texts have size 0; documents of size 0 take 0 words.  A null source is a source of its
own, last in order.  Repeated rows are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.memo import of_worker
from marlstone.llm.storage import Scratch

WEIGHTS = (3.0, 1.0, 2.0)
GROUP_ROWS = 2048
FAN_IN = 64
_EPS = 1e-9


def word_count(text: Column) -> Column:
    r"""Number of runs of characters other than ``[\x20\x09-\x0D]``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _sums_before(rows: DataFrame, order: Sequence[Column], columns: Sequence[str], scratch, name: str) -> DataFrame:
    """Add ``<column>_before``: the column's sum over all earlier rows of one global order without ties.

    Rows are dealt in ranges of the order and written; a range adds what the ranges before it
    hold.  Only those sums, one row for each range, meet in one task.
    """
    dealt = scratch.keep(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), name)
    earlier = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(F.col("range").alias("r")).agg(*[F.sum(c).alias(c) for c in columns])
    totals = totals.select("r", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_ranges") for c in columns])
    within = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"{c}_within") for c in columns])
    # no more ranges than shuffle partitions
    found = dealt.join(F.broadcast(totals), F.col("range") == F.col("r"))
    return found.select(*rows.columns, *[(F.col(f"{c}_ranges") + F.col(f"{c}_within")).alias(f"{c}_before") for c in columns])


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float, scratch=None) -> DataFrame:
    """Add ``target`` to sources (``source, source_size``): ``share`` of all words by repeating weights.

    A target stops at ``most`` times its source's size and the excess goes to the others by
    weight.  Sources that reach their cap are the first ones in order of cap per weight, so
    one pass over running sums finds the level at which the rest settles.  There is one row
    per source here, not per document; running sums are taken range by range, so sources may
    be as many as hosts.
    """
    scratch = scratch or Scratch(sizes.sparkSession, "targets")
    name, columns = F.col("source").asc_nulls_last(), sizes.columns
    rows = _sums_before(sizes.withColumn("one", F.lit(1)), [name], ["one"], scratch, "by_name")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("one_before") % len(weights) + 1).cast("int"))
    rows = rows.select(*columns, weight.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap"))
    rows = rows.withColumn("per_weight", F.col("cap") / F.col("weight"))
    rows = scratch.keep(_sums_before(rows, [F.col("per_weight"), name], ["cap", "weight"], scratch, "by_level"), "levels")
    words, all_weight = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(float(share) * (words or 0)) - F.col("cap_before")) / (F.lit(all_weight or 0.0) - F.col("weight_before"))
    # the final level is that of the first source which stays below its cap
    below = rows.select("per_weight", "cap", "weight", level.alias("level")).where(F.col("level") * F.col("weight") <= F.col("cap"))
    settled = below.agg(F.min(F.struct("per_weight", "level")).alias("first")).first()["first"]
    final = F.lit(float("inf") if settled is None else settled["level"])
    return rows.select(*columns, F.least(F.col("cap"), final * F.col("weight")).alias("target"))


def _unit(*parts: object) -> float:
    """A number in [0, 1) that depends on nothing but its arguments."""
    return xxhash.xxh64_intdigest("|".join(map(str, parts))) / 2**64


def pivot(ids: Sequence[object], sizes: np.ndarray, fractions: np.ndarray, seed: int) -> tuple[np.ndarray, int]:
    """Round fractions in order, carrying one; returns them and the place of what is left (-1: none).

    Moving ``d`` words between documents of sizes s and t changes their fractions by d / s and
    -d / t.  The step up and the step down to the next whole number are taken with the odds
    that keep both expectations.
    """
    p = fractions.astype(float).copy()
    open_ = -1
    for i in range(len(p)):
        if not _EPS < p[i] < 1 - _EPS:
            p[i] = round(p[i])
            continue
        if open_ < 0:
            open_ = i
            continue
        j = open_
        up = min((1 - p[i]) * sizes[i], p[j] * sizes[j])
        down = min(p[i] * sizes[i], (1 - p[j]) * sizes[j])
        move = up if _unit(seed, ids[i], ids[j]) * (up + down) < down else -down
        p[i] += move / sizes[i]
        p[j] -= move / sizes[j]
        open_ = -1
        for k in (j, i):
            if _EPS < p[k] < 1 - _EPS:
                open_ = k
            else:
                p[k] = round(p[k])
    return p, open_


def _rounding(seed: int, last: bool):
    """One level of the tree: rounds a group and marks what is left open."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        of_worker("mixing")
        # large documents first, so that what stays open in the end is small
        rows = rows.sort_values(["size", "draw", "key"], ascending=[False, True, True], kind="stable", ignore_index=True)
        p, left = pivot(rows["key"].tolist(), rows["size"].to_numpy(float), rows["fraction"].to_numpy(), seed)
        if left >= 0 and last:
            p[left] = float(_unit(seed, "last", rows["key"][left]) < p[left])
            left = -1
        rows["fraction"] = p
        rows["open"] = np.arange(len(rows)) == left
        return rows

    return run


def mix(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
    keep: Sequence[str] = (),
    scratch=None,
) -> DataFrame:
    """One row per document: ``key, size, source_size, target, copies, taken``.

    ``scratch`` (a ``storage.Scratch``) holds the sizes and the levels of the tree.  A source
    with a third of all documents is dealt over as many groups as it needs.
    """
    base = scratch.keep(df.select(F.col(key), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), *keep), "sizes")
    per_source = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    per_source = scratch.keep(per_source, "per_source")
    targets = scratch.keep(source_targets(per_source, weights, share, most, scratch).withColumnRenamed("source", "name"), "targets")
    deepest = per_source.agg(F.max("docs")).first()[0] or 0

    rows = base.join(targets, F.col("source").eqNullSafe(F.col("name")))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(expected + F.lit(_EPS))
    draw = F.xxhash64(F.lit(seed), F.col(key).cast("string"), F.col("size"))
    groups = F.ceil(F.col("docs") / F.lit(GROUP_ROWS))
    rows = rows.select(
        F.col(key).cast("string").alias("key"), F.col(key).alias("_id"), "source", "size", "source_size", "target", *keep,
        whole.cast("long").alias("whole"),
        F.when(F.col("size") > 0, F.greatest(expected - whole, F.lit(0.0))).otherwise(F.lit(0.0)).alias("fraction"),
        draw.alias("draw"), F.pmod(draw, groups).alias("part"),
    )
    small = ["key", "source", "size", "fraction", "draw", "part", "_id", "source_size", "target", "whole", *keep]
    schema = rows.select(*small).withColumn("open", F.lit(False)).schema
    parts, level, done = -(-deepest // GROUP_ROWS) or 1, 0, []
    state = rows.select(*small)
    while True:
        last = parts <= 1
        rounded = scratch.keep(state.groupBy("source", "part").applyInPandas(_rounding(seed + level, last), schema), f"level{level}")
        done.append(rounded.where(~F.col("open")))
        if last:
            break
        parts, level = -(-parts // FAN_IN), level + 1
        state = rounded.where("open").withColumn("part", F.floor(F.col("part") / FAN_IN)).select(*small)
    whole_rows = done[0]
    for more in done[1:]:
        whole_rows = whole_rows.unionByName(more)
    copies = F.col("whole") + F.round("fraction").cast("long")
    return whole_rows.select(F.col("_id").alias(key), *keep, "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
