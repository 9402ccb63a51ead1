"""Fusion of rankings: reciprocal ranks, calibration, weights, diversity and the confidence gate."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def reciprocal_rank(rank: Column, k: int = RRF_K) -> Column:
    return 1 / (k + rank)


def pool_size(k: int) -> int:
    """Dense candidates fetched for k results."""
    return max(6 * k, 30)


def calibrated(score: Column, by: str = "query_id") -> Column:
    """Min-max over a query's candidates; equal scores become 1 if positive, else 0."""
    w = Window.partitionBy(by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high > low, (score - low) / (high - low)).otherwise((score > 0).cast("double"))


def candidate_pool(dense: DataFrame, sparse: DataFrame, most_sparse: int | None = None) -> DataFrame:
    """Dense hits and then sparse ones outside them: ``query_id, id, pool_pos, distance, dense_rank``.

    Sparse-only rows, at most ``most_sparse`` of a query that has dense hits, have distance -1
    and no dense rank; they follow the last dense rank, best score first.
    """
    none = lambda t: F.lit(None).cast(t)
    rows = dense.select("query_id", "id", "distance", F.col("rank").alias("dense_rank"), none("double").alias("score"))
    rows = rows.unionByName(sparse.select("query_id", "id", none("double").alias("distance"), none("int").alias("dense_rank"), "score"))
    rows = rows.groupBy("query_id", "id").agg(F.min("distance").alias("distance"), F.min("dense_rank").alias("dense_rank"), F.max("score").alias("score"))
    extra = F.col("dense_rank").isNull()
    place = F.row_number().over(Window.partitionBy("query_id", extra).orderBy(F.desc("score"), "id"))
    rows = rows.withColumn("last", F.max("dense_rank").over(Window.partitionBy("query_id"))).withColumn("place", place).where("last is not null")
    rows = rows if most_sparse is None else rows.where(~extra | (F.col("place") <= most_sparse))
    return rows.select("query_id", "id", F.coalesce("dense_rank", F.col("last") + F.col("place")).alias("pool_pos"), F.coalesce("distance", F.lit(-1.0)).alias("distance"), "dense_rank")


def fuse(pool: DataFrame, weights: Column, depth: int, k: int = RRF_K) -> DataFrame:
    """Final scores of a pool with ``dense_rank, pool_pos, sparse_score, colbert_score``.

    The reciprocal-rank part adds the dense rank (a floor for sparse-only rows) and the rank
    by sparse score.  All three parts are calibrated per query and weighted.
    """
    by_sparse = Window.partitionBy("query_id").orderBy(F.desc("sparse_score"), "pool_pos")
    dense_part = F.when(F.col("dense_rank").isNotNull(), reciprocal_rank(F.col("dense_rank"), k)).otherwise(F.lit(0.5 / (k + depth)))
    rows = pool.withColumn("sparse_rank", F.row_number().over(by_sparse)).withColumn("rrf", dense_part + reciprocal_rank(F.col("sparse_rank"), k))
    score = weights["dense"] * calibrated(F.col("rrf")) + weights["sparse"] * calibrated(F.col("sparse_score")) + weights["colbert"] * calibrated(F.col("colbert_score"))
    return rows.withColumn("score", F.round(score, 6)).withColumn("rrf", F.round("rrf", 8))


def ranked(fused: DataFrame, k: int | None = None) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "pool_pos")
    rows = fused.withColumn("rank", F.row_number().over(order))
    return rows if k is None else rows.where(F.col("rank") <= k)


def _diverse(scores: list[float], distances: list[float], k: int, trade: float) -> list[int]:
    """Greedy choice of k candidates (best first) that weighs score against likeness to those chosen."""
    if len(scores) <= k:
        return list(range(len(scores)))
    chosen, likeness = [0], [0.0] * len(scores)
    while len(chosen) < k:
        newest = distances[chosen[-1]]
        likeness = [max(s, 1 - abs(d - newest) / 2) for s, d in zip(likeness, distances, strict=True)]
        rest = [i for i in range(len(scores)) if i not in chosen]
        chosen.append(max(rest, key=lambda i: (trade * scores[i] - (1 - trade) * likeness[i], -i)))
    return chosen


def diversify(fused: DataFrame, k: int, trade: float = 0.7) -> DataFrame:
    """Maximal marginal relevance per query over its pool: ``query_id, rank, id, score, distance``.

    A pool holds at most the dense depth and twice k sparse rows, so a group is small.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "pool_pos"], ascending=[False, True], ignore_index=True)
        at = _diverse(rows["score"].tolist(), rows["distance"].tolist(), k, trade)
        return rows.loc[at, ["query_id", "id", "score", "distance"]].assign(rank=range(1, len(at) + 1))[["query_id", "rank", "id", "score", "distance"]]

    return fused.select("query_id", "id", "score", "distance", "pool_pos").groupBy("query_id").applyInPandas(run, "query_id long, rank int, id long, score double, distance double")


def _near(distance: Column) -> Column:
    return F.when(distance >= 0, F.round(1 - distance / 2, 6))


def confident(score: Column, distance: Column, least_score: float = 0.3, least_similarity: float = 0.55) -> Column:
    """Whether a first row is good enough; a sparse-only row has no similarity and fails."""
    return (score >= least_score) & F.coalesce(_near(distance) >= least_similarity, F.lit(False))


def confidence_gate(top: DataFrame, least_score: float = 0.3, least_similarity: float = 0.55) -> DataFrame:
    """Every query's first row with its similarity and whether it is good enough."""
    ok = confident(F.col("score"), F.col("distance"), least_score, least_similarity)
    return top.where("rank = 1").select("query_id", "id", "score", _near(F.col("distance")).alias("similarity"), ok.alias("confidence_ok"))


def compare_rankings(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """Per query: rows in common among the first k, and whether the first row differs."""
    a = left.where(F.col("rank") <= k).groupBy("query_id").agg(F.collect_set("id").alias("a"), F.min_by("id", "rank").alias("first_a"))
    b = right.where(F.col("rank") <= k).groupBy("query_id").agg(F.collect_set("id").alias("b"), F.min_by("id", "rank").alias("first_b"))
    both = a.join(b, "query_id", "full_outer")
    shared = F.size(F.array_intersect(F.coalesce("a", F.array().cast("array<long>")), F.coalesce("b", F.array().cast("array<long>"))))
    return both.select("query_id", shared.cast("long").alias("overlap"), (~F.col("first_a").eqNullSafe(F.col("first_b"))).alias("top1_changed"))


def comparison_summary(compared: DataFrame) -> DataFrame:
    """One row over all queries: how many changed their first row, and the mean overlap to one digit."""
    return compared.agg(F.count(F.lit(1)).alias("queries"), F.count_if("top1_changed").alias("top1_changed"), F.round(F.avg("overlap"), 1).alias("mean_overlap"))
