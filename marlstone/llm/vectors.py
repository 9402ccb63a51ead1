"""What the two vector searches share: clean vectors, shards that meet their queries, and merging."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(df: DataFrame, key: str, vector: str, zero: bool = True) -> DataFrame:
    """``id, vector`` (doubles) of the vectors without null or non-finite components; ``zero``: keep zero vectors."""
    rows = df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vector")).where("id is not null and size(vector) > 0")
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~odd)
    return rows if zero else rows.where(F.exists("vector", lambda x: x != 0))


def stacked(column) -> np.ndarray:
    """A column of equally long arrays as a matrix."""
    return np.stack([np.asarray(v, float) for v in column]) if len(column) else np.zeros((0, 1))


def meet(index: DataFrame, asked: DataFrame, shards: int, load: Callable[[pd.DataFrame], object], answer: Callable[[object, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """What ``answer`` finds for all of a shard's queries in the shard that ``load`` makes of its rows.

    ``index`` and ``asked`` have the same columns, ``width, shard, place`` among them, and no
    nulls in whole numbers.  A shard's rows come to one task once and in order of ``place``; its
    queries follow in batches, so that a task holds one shard and one batch, however many
    queries there are.  Shards are of bounded size and many, which is what spreads the work.
    """
    both = index.withColumn("_kind", F.lit(0)).unionByName(asked.withColumn("_kind", F.lit(1)))
    both = both.repartition(max(1, shards * 4 if shards <= 1_000 else shards), "width", "shard").sortWithinPartitions("width", "shard", "_kind", "place")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, held, loaded = None, [], None
        for batch in batches:
            for (width, shard, kind), rows in batch.groupby(["width", "shard", "_kind"], sort=True):
                if (width, shard) != here:
                    here, held, loaded = (width, shard), [], None
                if kind == 0:
                    held.append(rows)
                elif held:
                    if loaded is None:
                        loaded = load(pd.concat(held, ignore_index=True))
                    yield answer(loaded, rows.reset_index(drop=True))

    return both.mapInPandas(run, schema)


def nearest(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` highest ``score`` of every ``query_id`` with their rank, ties to the smaller ``vec_id``.

    Every task keeps its own best before the shuffle.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
