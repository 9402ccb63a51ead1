"""Exact top-k search by inner product with a KD-tree per shard.

Vectors become whole numbers, ``floor(scale * x)``.  They are dealt into shards of bounded
size; each shard builds a KD-tree by median splits along the widest side, once, and its rows
are written in the order of the tree, from which the tight bounding boxes follow.  A query
walks the tree best first: a box bounds the inner products inside it, the box with the highest
bound is opened next, and the walk ends when that bound is below the query's kth score.  The
kth score is propagated: every query first searches one shard, and the score it finds there
prunes all other shards from the start.

Inner products are exact.  Where doubles can't hold them (a box whose products may reach
2^53), they only rule rows out, with their error counted in, and the rest is added up in whole
numbers.  A score beyond the range of a 64-bit integer is the end of that range, and such
scores tie.  ``scale * x`` beyond the range of a double counts as the largest double.

A task holds one shard and one batch of queries.  Vectors of different widths are searched
apart.  Vectors that are null or hold null or non-finite components take no part.  A query
with fewer than k candidates gets them all; several rows with one id are candidates of their
own, except for queries of that id.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm import vectors

SHARD_ROWS, LEAF_ROWS = 16_384, 128
_EXACT = float(1 << 53)
_LONG = 1 << 63
_LARGEST = np.finfo(float).max
_FIT = 2.0**480  # doubles up to here can be multiplied and added without overflow


def whole(points: np.ndarray, scale: float) -> np.ndarray:
    """``floor(scale * x)`` as doubles."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(points * scale), -_LARGEST, _LARGEST)


def splits(n: int, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of a tree over n rows as slices, and their two children (-1: a leaf); parents come first."""
    slices, children, todo = [], [], [(0, n, -1, 0)]
    while todo:
        a, b, parent, side = todo.pop()
        node = len(slices)
        if parent >= 0:
            children[parent][side] = node
        slices.append((a, b))
        children.append([-1, -1])
        if b - a > leaf:
            middle = a + (b - a) // 2
            todo += [(middle, b, node, 1), (a, middle, node, 0)]
    return np.array(slices), np.array(children)


def tree_order(points: np.ndarray, leaf: int) -> np.ndarray:
    """The rows in the order of their tree: every slice is split at its median along its widest side."""
    order = np.arange(len(points))
    for a, b in splits(len(points), leaf)[0]:
        if b - a > leaf:
            here = points[order[a:b]]
            axis = int(np.argmax(here.max(axis=0) / 2 - here.min(axis=0) / 2))
            order[a:b] = order[a:b][np.argpartition(here[:, axis], (b - a) // 2)]
    return order


class KdTree:
    """The tree over rows that are in its order, with the tight box of every node."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int):
        self.points, self.ids = points, ids
        self.slices, self.children = splits(len(points), leaf)
        self.low = np.array([points[a:b].min(axis=0) for a, b in self.slices])
        self.high = np.array([points[a:b].max(axis=0) for a, b in self.slices])
        self.width = points.shape[1]

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query and node: no inner product is higher; and how far doubles may be off (0: not at all)."""
        if max(np.abs(queries).max(initial=0.0), np.abs(self.low).max(initial=0.0), np.abs(self.high).max(initial=0.0)) > _FIT:
            return (np.full((len(queries), len(self.slices)), np.inf),) * 2
        size = np.abs(queries) @ np.maximum(np.abs(self.low), np.abs(self.high)).T
        bound = np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T
        off = np.where(size < _EXACT, 0.0, size * (self.width + 1) * 2.0**-52)
        return bound + off, off

    def search(self, query: np.ndarray, own: int, bounds: np.ndarray, off: np.ndarray, k: int, kth: float) -> list[tuple[int, int]]:
        """Best-first: ``(-score, id)`` of the k best with a score of ``kth`` or more, best first."""
        best: list[tuple[int, int]] = []
        heap = [(-bounds[0], 0)]
        exact_query = None
        while heap and -heap[0][0] >= kth:
            _, node = heapq.heappop(heap)
            left, right = self.children[node]
            if left >= 0:
                for child in (left, right):
                    if bounds[child] >= kth:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            a, b = self.slices[node]
            if off[node] == 0:
                scores = self.points[a:b] @ query
                at = np.flatnonzero((scores >= kth) & (self.ids[a:b] != own))
                if at.size > k:
                    least = np.partition(scores[at], at.size - k)[at.size - k]
                    at = at[scores[at] >= least]
                fresh = [(-int(scores[i]), int(self.ids[a + i])) for i in at]
            else:
                if exact_query is None:
                    exact_query = [int(x) for x in query]
                at = np.arange(b - a)
                if np.isfinite(off[node]):
                    at = np.flatnonzero(self.points[a:b] @ query + off[node] >= kth)
                at = at[self.ids[a:b][at] != own]
                sums = (sum(x * int(y) for x, y in zip(exact_query, self.points[a + i], strict=True)) for i in at)
                fresh = [(-min(max(s, -_LONG), _LONG - 1), int(self.ids[a + i])) for s, i in zip(sums, at, strict=True)]
            if fresh:
                best = sorted(best + fresh)[:k]
                if len(best) == k:
                    kth = max(kth, -best[-1][0])
        return best


def _load(index: pd.DataFrame) -> KdTree:
    return KdTree(vectors.stacked(index["vector"]), index["id"].to_numpy(np.int64), LEAF_ROWS)


def _answer(k: int):
    def run(tree: KdTree, asked: pd.DataFrame) -> pd.DataFrame:
        queries = vectors.stacked(asked["vector"])
        bounds, off = tree.bounds(queries)
        kth = [-np.inf if none else int(x) for x, none in zip(asked["kth"], asked["open"], strict=True)]
        out: list[tuple] = []
        for n, own in enumerate(asked["id"]):
            out += [(own, i, -s) for s, i in tree.search(queries[n], own, bounds[n], off[n], k, kth[n])]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"], dtype="int64")

    return run


def build_index(rows: DataFrame, scratch, scale: float) -> DataFrame:
    """``width, shard, place, id, vector`` (whole numbers) of ``id, vector``, every shard in the order of its tree."""
    rows = scratch.keep(rows.select(F.col("id").cast("long").alias("id"), "vector", F.size("vector").alias("width")), "rows")
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id", "vector"), F.lit(shards)).cast("int"))

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("id", ignore_index=True)
        points = whole(vectors.stacked(shard["vector"]), scale)
        order = tree_order(points, LEAF_ROWS)
        shard = shard.loc[order].assign(vector=list(points[order]), place=np.arange(len(order)))
        return shard[["width", "shard", "place", "id", "vector"]]

    return scratch.keep(dealt.groupBy("width", "shard").applyInPandas(run, "width int, shard int, place int, id long, vector array<double>"), "index")


def top_k(df: DataFrame, is_query: Column, k: int, scratch, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """``query_id, rank, vec_id, score`` (long) for the rows of ``df`` that ``is_query`` picks, against all others."""
    index = build_index(vectors.usable(df, key, vector), scratch, scale)
    floors = F.pandas_udf(lambda v: pd.Series([whole(np.asarray(x, float), scale) for x in v], dtype=object), "array<double>")
    asked = vectors.usable(df.where(is_query), key, vector)
    asked = scratch.keep(asked.select(F.col("id").cast("long").alias("id"), floors("vector").alias("vector"), F.size("vector").alias("width")), "asked")
    places = scratch.keep(index.groupBy("width", "shard").agg(F.count(F.lit(1)).alias("rows")).coalesce(1), "places")
    shards = places.count()
    schema = "query_id long, vec_id long, score long"
    stored = index.select("width", "shard", "place", "id", "vector", F.lit(0).cast("long").alias("kth"), F.lit(True).alias("open"))
    columns = ["width", "shard", F.lit(0).alias("place"), "id", "vector", "kth", "open"]

    # the first shard of every query, then all others with the score that it has found
    numbered = places.groupBy("width").agg(F.array_sort(F.collect_list("shard")).alias("shards"))
    home = F.element_at("shards", (F.pmod(F.xxhash64("id"), F.size("shards")) + 1).cast("int"))
    asked = asked.join(numbered, "width").withColumn("home", home).drop("shards")
    first = asked.select("width", F.col("home").alias("shard"), "id", "vector", F.lit(0).cast("long").alias("kth"), F.lit(True).alias("open")).select(*columns)
    first = scratch.keep(vectors.meet(stored, first, shards, _load, _answer(k), schema), "first")
    if shards <= 1:
        return vectors.nearest(first, k)
    kth = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.min("score").alias("score"))
    rest = asked.join(kth, asked["id"] == kth["query_id"], "left").withColumn("open", F.coalesce(F.col("found") < k, F.lit(True)))
    rest = rest.withColumn("kth", F.when(~F.col("open"), F.col("score")).otherwise(F.lit(0).cast("long")))
    # the list of shards joins last: no query is shuffled with it
    rest = rest.join(numbered, "width").withColumn("shard", F.explode("shards")).where("shard <> home").select(*columns)
    others = vectors.meet(stored, rest, shards, _load, _answer(k), schema)
    return vectors.nearest(first.unionByName(others), k)
