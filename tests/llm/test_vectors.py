"""Exact and approximate search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import ann, exact_topk
from marlstone.llm.storage import Scratch

SCHEMA = "vec_id long, embedding array<float>, score string"


def points(n, dim, seed, copies=0):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, dim)).astype(np.float32)
    x[:copies] = x[0]
    return x


def frame(spark, x, extra=()):
    rows = [(i, [float(c) for c in v], "clash") for i, v in enumerate(x)]
    return spark.createDataFrame([*rows, *extra], SCHEMA).repartition(3)


def brute(x, queries, k):
    out = set()
    for q in queries:
        s = x @ x[q]
        s[q] = -np.inf
        for rank, i in enumerate(np.lexsort((np.arange(len(x)), -s))[: min(k, len(x) - 1)], 1):
            out.add((q, rank, int(i), float(s[i])))
    return out


ODD = [(900, None, ""), (950, [], ""), (1000, [1.0, None, 2.0, 3.0, 0.0, 0.0], ""), (1050, [float("nan")] * 6, ""), (1100, [float("inf")] * 6, ""), (None, [1.0] * 6, "")]


@pytest.mark.parametrize("shard", [10_000, 60])
def test_exact(spark, monkeypatch, shard):
    monkeypatch.setattr(exact_topk, "SHARD_ROWS", shard)
    monkeypatch.setattr(exact_topk, "LEAF_ROWS", 8)
    x = points(300, 6, 1, copies=90)
    got = exact_topk.top_k(frame(spark, x, ODD), F.col("vec_id") % 50 == 0, 5, Scratch(spark, "t")).collect()
    whole = np.floor(x.astype(float) * 256)
    want = {(q, r, i, int(s)) for q, r, i, s in brute(whole, range(0, 300, 50), 5)}
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == want and len(got) == len(want)


def test_exact_small_and_large_values(spark):
    df = spark.createDataFrame([(0, [1e30, 1.0], ""), (50, [1e30, 2.0], ""), (3, [-1.0, 0.5], "")], SCHEMA)
    got = exact_topk.top_k(df, F.col("vec_id") % 50 == 0, 5, Scratch(spark, "t")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, 50), (0, 3), (50, 0), (50, 3)] and got[0].score == 2**63 - 1
    assert exact_topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0, 5, Scratch(spark, "t")).count() == 0


def test_exact_beyond_doubles(spark, monkeypatch):
    """Whole numbers decide where doubles can't: large components, and small rows beside them."""
    monkeypatch.setattr(exact_topk, "SHARD_ROWS", 40)
    monkeypatch.setattr(exact_topk, "LEAF_ROWS", 4)
    draw = np.random.default_rng(6)
    x = draw.normal(size=(150, 5)) * 10.0 ** draw.choice([0, 6, 8], size=150)[:, None]
    x[40:60] = x[50] + draw.integers(-1, 2, size=(20, 5)) / 256
    df = spark.createDataFrame([(i, [float(c) for c in v], "") for i, v in enumerate(x)], "vec_id long, embedding array<double>, score string").repartition(3)
    got = exact_topk.top_k(df, F.col("vec_id") % 50 == 0, 5, Scratch(spark, "t")).collect()
    ints = [[int(c) for c in v] for v in np.floor(x * 256)]
    clip = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    want = set()
    for q in range(0, 150, 50):
        scored = sorted((-clip(sum(a * b for a, b in zip(ints[q], p, strict=True))), i) for i, p in enumerate(ints) if i != q)[:5]
        want |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)}
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == want


def test_exact_huge_components(spark):
    rows = [(0, [1.0, 1.0], ""), (1, [1e17, -1e17], ""), (2, [2e17, -1e17], ""), (3, [1e308, 1e308], ""), (4, [-1e308, 5.0], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = exact_topk.top_k(df, F.col("vec_id") == 0, 5, Scratch(spark, "t")).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(2, 2**63 - 1), (3, 2**63 - 1), (1, 0), (4, -(2**63))]


def test_ann_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 700)
    x = points(2000, 24, 2, copies=60)
    x[300:500] = x[300] + 1e-4 * points(200, 24, 3)  # a dense cluster
    x /= np.linalg.norm(x, axis=1)[:, None]
    got = ann.neighbours(frame(spark, x, [*ODD[:2], (2100, [0.0] * 24, "")]), F.col("vec_id") % 20 == 0, 20, Scratch(spark, "t")).collect()
    stored = x.astype(np.float32).astype(float)
    want = brute(stored, range(0, 2000, 20), 20)
    hits = {(r.query_id, r.vec_id) for r in got} & {(q, i) for q, _, i, _ in want}
    assert len(got) == len(want) and len(hits) >= 0.9 * len(want)
    for r in got[:200]:
        assert abs(r.score - stored[r.query_id] @ stored[r.vec_id]) < 1e-9


KINDS = ["normal", "lognormal 0.1", "lognormal 0.3", "lognormal 0.5", "lognormal 1.0", "line"]


def uneven(kind, n, dim, seed=4):
    """Vectors whose lengths differ; ``line``: most point one of two ways."""
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, dim))
    if kind == "line":
        x[: n // 2] = x[0] * draw.uniform(0.1, 9, size=n // 2)[:, None]
    elif kind != "normal":
        x *= (np.exp(float(kind.split()[1]) * draw.normal(size=n)) / np.linalg.norm(x, axis=1))[:, None]
    return x.astype(np.float32)


def share_found(spark, x):
    got = ann.neighbours(frame(spark, x), F.col("vec_id") % 20 == 0, 20, Scratch(spark, "t")).collect()
    stored = x.astype(float)
    best = {}
    for q in range(0, len(x), 20):
        s = stored @ stored[q]
        s[q] = -np.inf
        best[q] = np.sort(s)[-20]  # equal scores are equally good
    assert len(got) == 20 * len(best) and len({(r.query_id, r.vec_id) for r in got}) == len(got)
    for r in got[:100]:
        assert abs(r.score - stored[r.query_id] @ stored[r.vec_id]) <= 1e-9 * max(1, abs(r.score))
    return np.mean([r.score >= best[r.query_id] - 1e-9 * abs(best[r.query_id]) for r in got])


@pytest.mark.parametrize("kind", KINDS)
def test_ann_recall_of_uneven_lengths_over_shards_and_batches(spark, monkeypatch, kind):
    monkeypatch.setattr(ann, "SHARD_ROWS", 700)
    monkeypatch.setattr(ann, "BAND_ROWS", 128)
    assert share_found(spark, uneven(kind, 2000, 64)) >= 0.9


@pytest.mark.parametrize("kind", ["normal", "lognormal 0.3", "lognormal 1.0"])
def test_ann_recall_of_a_full_shard(spark, kind):
    assert share_found(spark, uneven(kind, ann.SHARD_ROWS, 64)) >= 0.9


def test_ann_ties_across_shards(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 8)
    x = np.zeros((60, 2), np.float32)
    x[:, 0], x[:, 1] = 1, np.arange(60)  # all score 1 with row 0
    got = ann.neighbours(frame(spark, x), F.col("vec_id") == 0, 20, Scratch(spark, "t")).orderBy("rank").collect()
    assert [(r.rank, r.vec_id, r.score) for r in got] == [(i, i, 1.0) for i in range(1, 21)]


def test_ann_extreme_lengths(spark):
    rows = [(0, [1.0, 0.0], ""), (1, [1e-200, 0.0], ""), (2, [1e150, 1e150], ""), (3, [-5.0, 1.0], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = ann.neighbours(df, F.col("vec_id") == 0, 20, Scratch(spark, "t")).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(2, 1e150), (1, 1e-200), (3, -5.0)]


def test_ann_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], ""), (20, [1.0, 0.0], ""), (5, [0.0, 1.0], ""), (7, [3.0, 1.0], ""), (7, [3.0, 1.0], "")], SCHEMA)
    got = ann.neighbours(df, F.col("vec_id") % 20 == 0, 20, Scratch(spark, "t")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in got][:4] == [(0, 7, 3.0), (0, 7, 3.0), (0, 20, 1.0), (0, 5, 0.0)]
    assert ann.neighbours(df.limit(0), F.col("vec_id") % 20 == 0, 20, Scratch(spark, "t")).count() == 0


def test_op10_recall_of_the_given_embeddings(spark):
    """The registered parameters on the given vectors, which have unit length; the README has figures of others."""
    from marlstone.llm.registry import op10_ann

    data = "/root/testdata/sf0.1"
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()}
    ids = np.array(sorted(rows))
    x = np.array([rows[i] for i in ids], float)
    asked = np.flatnonzero(ids % 20 == 0)
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-scores, axis=1, kind="stable")[:, :20]
    want = {(int(ids[q]), int(ids[i])) for q, near in zip(asked, best, strict=True) for i in near}
    got = {(r.query_id, r.vec_id) for r in op10_ann(spark, data).collect()}
    assert len(got & want) >= 0.9 * len(want)
