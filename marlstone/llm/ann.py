"""Approximate nearest neighbours by inner product with robust-pruned graphs in every shard.

A shard's vectors are put in bands of nearly equal length.  Within a band the largest inner
product is, but for the small differences in length, the smallest angle, so a band's graph
connects directions.  It is built in batches: a greedy beam search proposes neighbours for
each new vector, robust pruning keeps the nearest one and drops whatever is closer to it, by a
factor ``alpha``, than to the new vector, and the edges are returned with the same pruning.  A
second round with ``alpha`` above 1 adds the longer edges.  Points that no walk from the
middle reaches become starts of their own.

Queries walk the graphs with a beam that follows the inner product itself, longest band first;
a band is left out when its greatest length times the query's is below what the query has
found.  Each band's beam is widened until it finds nearly all true neighbours of a sample of
the band, so recall doesn't rest on a kind of data.  What a walk finds is scored exactly in
double precision on the original vectors, and the best of all shards are merged.

The index is a table of rows (vector, neighbours), built once and written; every vector is in
it.  Equal vectors are one node that names its ``k + 1`` smallest ids, all that any result can
show.  Vectors that are null, zero, or hold null or non-finite components take no part.
Vectors of different widths are indexed apart.  A query with fewer than k candidates gets all
that the walks reach.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm import vectors

SHARD_ROWS = 8_192
BAND_RATIO, BAND_ROWS = 1.25, 1_024  # lengths of a band differ by such a factor, if it has so many rows
DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA = 32, 48, 80, 1.2
SAMPLE, SAMPLE_RECALL = 64, 0.97  # rows of a band that set its beam, and what it has to find of their neighbours
_WIDE, _BATCH = 4, 512
_FAR = np.inf


def directions(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1 and the logarithms of their lengths, without overflow or loss at either end."""
    largest = np.abs(points).max(axis=1, keepdims=True)
    part = points / largest
    length = np.sqrt((part * part).sum(axis=1))
    return part / length[:, None], np.log(largest[:, 0]) + np.log(length)


def bands(lengths: np.ndarray) -> list[np.ndarray]:
    """Places of the rows of every band, longest vectors first; ``lengths`` are logarithms."""
    order = np.argsort(-lengths, kind="stable")
    falling, out, a = -lengths[order], [], 0
    while a < len(order):
        b = int(np.searchsorted(falling, falling[a] + np.log(BAND_RATIO), side="right"))
        b = max(b, a + BAND_ROWS)
        b = b if len(order) - b >= BAND_ROWS else len(order)
        out.append(np.sort(order[a:b]))
        a = b
    return out


class Graph:
    """Out-neighbours of every point, -1 where there are fewer, and the points where walks start."""

    def __init__(self, points: np.ndarray, neighbours: np.ndarray | None = None, starts: np.ndarray | None = None):
        self.points = points.astype(np.float32)
        self.neighbours = np.full((len(points), DEGREE), -1, np.int32) if neighbours is None else neighbours
        self.starts = starts

    def beam_search(self, queries: np.ndarray, beam: int) -> np.ndarray:
        """Point numbers (-1: none) of the largest inner products found."""
        queries = queries.astype(np.float32)
        b = len(queries)
        seen = np.zeros((b, len(self.points) + 1), bool)  # the last column stands for -1
        seen[:, -1] = True
        seen[:, self.starts] = True
        ids = np.full((b, beam), -1, np.int64)
        dist = np.full((b, beam), _FAR, np.float32)
        done = np.ones((b, beam), bool)
        first = -(queries @ self.points[self.starts].T)
        take = np.argsort(first, axis=1, kind="stable")[:, :beam]
        n = take.shape[1]
        ids[:, :n], dist[:, :n], done[:, :n] = self.starts[take], np.take_along_axis(first, take, 1), False
        active = np.arange(b)
        while active.size:
            waiting = np.where(done[active], _FAR, dist[active])
            pick = np.argpartition(waiting, min(_WIDE, beam) - 1, axis=1)[:, :_WIDE]
            at = active[:, None]
            chosen = np.where(np.isfinite(np.take_along_axis(waiting, pick, 1)), ids[at, pick], -1)
            done[at, pick] = True
            near = np.where(chosen[:, :, None] >= 0, self.neighbours[chosen], -1).reshape(len(active), -1)
            near = np.where(seen[at, near], -1, near)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            r, c = np.nonzero(near >= 0)
            found = near[r, c]
            seen[active[r], found] = True
            fresh = np.full(near.shape, _FAR, np.float32)
            fresh[r, c] = -np.einsum("ij,ij->i", self.points[found], queries[active[r]])
            all_ids = np.concatenate([ids[active], near], axis=1)
            all_dist = np.concatenate([dist[active], fresh], axis=1)
            all_done = np.concatenate([done[active], near < 0], axis=1)
            best = np.argpartition(all_dist, beam - 1, axis=1)[:, :beam]
            ids[active] = np.take_along_axis(all_ids, best, 1)
            dist[active] = np.take_along_axis(all_dist, best, 1)
            done[active] = np.take_along_axis(all_done, best, 1)
            active = active[~(done[active] | ~np.isfinite(dist[active])).all(axis=1)]
        return np.where(np.isfinite(dist), ids, -1)

    def prune(self, nodes: np.ndarray, candidates: np.ndarray, alpha: float) -> None:
        """Robust pruning of each node's candidates (-1: none) into its out-neighbours."""
        candidates = np.where(candidates == nodes[:, None], -1, candidates)
        candidates = np.sort(candidates, axis=1)
        candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
        gap = self.points[candidates] - self.points[nodes][:, None, :]
        dist = np.where(candidates >= 0, np.einsum("ijk,ijk->ij", gap, gap), _FAR)
        order = np.argsort(dist, axis=1, kind="stable")
        candidates, dist = np.take_along_axis(candidates, order, 1), np.take_along_axis(dist, order, 1)
        cand_points = self.points[candidates]
        squares = np.einsum("ijk,ijk->ij", cand_points, cand_points)
        alive = np.isfinite(dist)
        kept = np.full((len(nodes), DEGREE), -1, np.int32)
        rows = np.arange(len(nodes))
        for slot in range(DEGREE):
            first = alive.argmax(axis=1)
            some = alive[rows, first]
            if not some.any():
                break
            kept[some, slot] = candidates[rows, first][some]
            chosen = cand_points[rows, first]
            between = squares + squares[rows, first][:, None] - 2 * np.einsum("ijk,ik->ij", cand_points, chosen)
            alive &= (alpha * alpha * between > dist) & some[:, None]
            alive[rows, first] = False
        self.neighbours[nodes] = kept

    def insert(self, nodes: np.ndarray, alpha: float) -> None:
        found = self.beam_search(self.points[nodes], BUILD_BEAM)
        self.prune(nodes, np.concatenate([found, self.neighbours[nodes]], axis=1), alpha)
        # the way back
        to = self.neighbours[nodes].astype(np.int64)
        back, source = to[to >= 0], np.repeat(nodes, (to >= 0).sum(axis=1))
        order = np.lexsort((source, back))
        back, source = back[order], source[order]
        target, first, count = np.unique(back, return_index=True, return_counts=True)
        widest = int(count.max()) if count.size else 0
        if not widest:
            return
        extra = np.full((len(target), widest), -1, np.int64)
        extra[np.repeat(np.arange(len(target)), count), np.arange(len(back)) - np.repeat(first, count)] = source
        both = np.concatenate([self.neighbours[target], extra], axis=1)
        for a in range(0, len(target), _BATCH):
            part = both[a : a + _BATCH]
            width = int((part >= 0).sum(axis=1).max())
            part = -np.sort(-part, axis=1)[:, : max(width, 1)]
            room = (part >= 0).sum(axis=1) <= DEGREE
            fit = np.full((len(part), DEGREE), -1, np.int32)
            take = min(DEGREE, part.shape[1])
            fit[:, :take] = part[:, :take]
            rows = target[a : a + _BATCH]
            self.neighbours[rows[room]] = fit[room]
            if not room.all():
                self.prune(rows[~room], part[~room], alpha)

    def open_all(self) -> None:
        """Add starts until every point can be reached from one."""
        seen = np.zeros(len(self.points) + 1, bool)
        seen[-1] = True
        starts, front = list(self.starts), self.starts
        while True:
            seen[front] = True
            while front.size:
                front = np.unique(self.neighbours[front])
                front = front[~seen[front]]
                seen[front] = True
            rest = np.flatnonzero(~seen)
            if not rest.size:
                break
            starts.append(rest[0])
            front = rest[:1]
        self.starts = np.array(starts, np.int64)


def build(points: np.ndarray, seed: int = 3) -> Graph:
    """The graph of the directions of a band."""
    n = len(points)
    graph = Graph(points, starts=np.array([np.argmin(((points - points.mean(axis=0)) ** 2).sum(axis=1))], np.int64))
    order = np.random.default_rng(seed).permutation(n)
    for alpha in (1.0, ALPHA):
        at = 0
        while at < n:
            size = min(_BATCH, max(1, at)) if alpha == 1.0 else _BATCH  # few at first: they find each other's edges
            graph.insert(order[at : at + size], alpha)
            at += size
    graph.open_all()
    return graph


def fitting_beam(graph: Graph, k: int, least: int = SEARCH_BEAM) -> int:
    """The beam, doubled as often as it takes, that finds the k best of sampled points nearly whole."""
    n = len(graph.points)
    asked = np.random.default_rng(5).permutation(n)[:SAMPLE]
    scores = graph.points[asked] @ graph.points.T
    scores[np.arange(len(asked)), asked] = -np.inf
    k = min(k, n - 1)
    beam = max(least, k + 1)
    if k < 1:
        return beam
    last = -np.partition(-scores, k - 1, axis=1)[:, k - 1]  # any k points of this score or more will do
    while beam < n:
        found = graph.beam_search(graph.points[asked], beam)
        got = np.where(found >= 0, np.take_along_axis(scores, np.maximum(found, 0), 1), -np.inf)
        if np.minimum((got >= last[:, None]).sum(axis=1), k).mean() >= SAMPLE_RECALL * k:
            break
        beam *= 2
    return beam


def build_index(df: DataFrame, scratch, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per distinct vector: ``width, shard, band, place, members, vector, neighbours, start, beam``."""
    rows = vectors.usable(df, key, vector, zero=False).select(F.col("id").cast("long").alias("id"), F.transform("vector", lambda x: x + 0.0).alias("vector"))
    order = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    rows = rows.withColumn("order", order).where(F.col("order") <= k + 1)
    nodes = rows.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("members"))
    nodes = scratch.keep(nodes.withColumn("width", F.size("vector")), "nodes")
    shards = max(1, -(-nodes.count() // SHARD_ROWS))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int"))

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.assign(first=[m[0] for m in shard["members"]]).sort_values("first", ignore_index=True)
        ways, lengths = directions(vectors.stacked(shard["vector"]))
        out = []
        for number, at in enumerate(bands(lengths)):
            graph = build(ways[at])
            walked = Graph(ways[at] * np.exp(lengths[at] - lengths[at].max())[:, None], graph.neighbours, graph.starts)
            rows = shard.loc[at].assign(band=number, beam=fitting_beam(walked, k), start=np.isin(np.arange(len(at)), graph.starts))
            rows["neighbours"] = [list(row[row >= 0]) for row in graph.neighbours]
            out.append(rows)
        whole = pd.concat(out, ignore_index=True)
        whole["place"] = np.arange(len(whole))
        return whole[["width", "shard", "band", "place", "members", "vector", "neighbours", "start", "beam"]]

    schema = "width int, shard int, band int, place int, members array<long>, vector array<double>, neighbours array<int>, start boolean, beam int"
    return scratch.keep(dealt.groupBy("width", "shard").applyInPandas(run, schema), "index")


@dataclass
class _Band:
    graph: Graph
    points: np.ndarray
    longest: float
    beam: int


def _load(index: pd.DataFrame) -> tuple[list[_Band], list]:
    """The bands of a shard, longest first, and the ids of every point."""
    found = []
    for _, rows in index.groupby("band", sort=True):
        points = vectors.stacked(rows["vector"])
        neighbours = np.full((len(rows), DEGREE), -1, np.int32)
        for row, near in zip(neighbours, rows["neighbours"], strict=True):
            row[: len(near)] = near
        ways, lengths = directions(points)
        graph = Graph(ways * np.exp(lengths - lengths.max())[:, None], neighbours, np.flatnonzero(rows["start"]))
        found.append(_Band(graph, points, float(lengths.max()), int(rows["beam"].iloc[0])))
    return found, index["members"].tolist()


def _scores(points: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Inner products, added up from the first component to the last."""
    total = np.zeros(points.shape[:-1])
    for j in range(points.shape[-1]):
        total += points[..., j] * queries[:, None, j]
    return total


def _walk(k: int, beam: int):
    def run(loaded: tuple[list[_Band], list], asked: pd.DataFrame) -> pd.DataFrame:
        shard, members = loaded
        queries, own = vectors.stacked(asked["vector"]), asked["id"].to_numpy(np.int64)
        ways, lengths = directions(queries)
        most = k + 1  # one node may be the query's own
        best, scores = np.full((len(asked), most), -1, np.int64), np.full((len(asked), most), -np.inf)
        offset = 0
        for band in shard:
            with np.errstate(over="ignore"):
                active = np.flatnonzero(np.exp(lengths + band.longest) * (1 + 1e-9) >= scores[:, most - 1])
            if active.size:
                found = band.graph.beam_search(ways[active], max(beam, band.beam))
                with np.errstate(over="ignore", invalid="ignore"):
                    fresh = np.where(found >= 0, np.nan_to_num(_scores(band.points[found], queries[active]), nan=0.0, posinf=np.inf, neginf=-np.inf), -np.inf)
                ids = np.concatenate([best[active], np.where(found >= 0, found + offset, -1)], axis=1)
                both = np.concatenate([scores[active], fresh], axis=1)
                order = np.argsort(-both, axis=1, kind="stable")
                # equal scores at the end stay together: their ids decide
                ids, both = np.take_along_axis(ids, order, 1), np.take_along_axis(both, order, 1)
                width = max(most, int((both >= both[:, most - 1 : most]).sum(axis=1).max()))
                if width > best.shape[1]:
                    more = width - best.shape[1]
                    best, scores = np.pad(best, ((0, 0), (0, more)), constant_values=-1), np.pad(scores, ((0, 0), (0, more)), constant_values=-np.inf)
                best[active], scores[active] = ids[:, : best.shape[1]], both[:, : best.shape[1]]
            offset += len(band.points)
        out = []
        for row, me in enumerate(own):
            hits: list[tuple[float, int]] = []
            for node, score in zip(best[row], scores[row], strict=True):
                if node < 0 or len(hits) >= k and score < hits[-1][0]:
                    break
                hits += [(score, int(i)) for i in members[node] if i != me]
            hits.sort(key=lambda h: (-h[0], h[1]))
            out += [(int(me), i, float(s)) for s, i in hits[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def search(index: DataFrame, queries: DataFrame, k: int, scratch, key: str = "vec_id", vector: str = "embedding", beam: int = SEARCH_BEAM) -> DataFrame:
    """``query_id, rank, vec_id, score``: every query's ``k`` nearest found, without its own id.

    ``beam`` is the least; a band that needs a wider one has it in the index.
    """
    asked = vectors.usable(queries, key, vector, zero=False).select(F.col("id").cast("long").alias("id"), "vector", F.size("vector").alias("width"))
    places = index.groupBy(F.col("width").alias("width"), F.col("shard").alias("shard")).agg(F.count(F.lit(1)).alias("nodes")).select("width", "shard")
    places = scratch.keep(places.coalesce(1), "places")
    empty = {"band": "int", "place": "int", "members": "array<long>", "neighbours": "array<int>", "start": "boolean", "beam": "int"}
    zero = {"band": F.lit(0), "place": F.lit(0), "members": F.array(), "neighbours": F.array(), "start": F.lit(False), "beam": F.lit(0)}
    asked = asked.join(places, "width").select("width", "shard", "id", "vector", *[zero[c].cast(t).alias(c) for c, t in empty.items()])
    index = index.select("width", "shard", F.lit(0).cast("long").alias("id"), "vector", *empty)
    found = vectors.meet(index, asked, places.count(), _load, _walk(k, beam), "query_id long, vec_id long, score double")
    return vectors.nearest(found, k)


def neighbours(df: DataFrame, is_query: Column, k: int, scratch, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Index all rows and search with those that ``is_query`` picks."""
    return search(build_index(df, scratch, k, key, vector), df.where(is_query), k, scratch, key, vector)
