"""Targets by hand, rounding that keeps sums, and edge cases of the mix."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import mixing
from marlstone.llm.storage import Scratch


def water_fill(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets by sharing the excess again and again."""
    names = sorted((k for k in sizes if k is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[n] for n in capped)
        loose = sum(w[n] for n in names if n not in capped)
        target = {n: most * sizes[n] if n in capped else rest * w[n] / loose for n in names}
        over = {n for n in names if n not in capped and target[n] > most * sizes[n]}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    draw = np.random.default_rng(seed)
    sizes = {f"s{i}": int(draw.integers(1, 1000) ** (1 + seed / 3)) for i in range(9)} | {None: 77, "ä": 5, "Z": 400}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df, (3, 1, 2), 1.5, 2.0).collect()}
    want = water_fill(sizes)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 * want[k] for k in want)


def test_pivot_keeps_words_and_expectations():
    draw = np.random.default_rng(3)
    sizes = draw.integers(1, 500, 200).astype(float)
    p = np.full(200, 0.3)
    mean = np.zeros(200)
    for seed in range(300):
        out, left = mixing.pivot(list(range(200)), sizes, p, seed)
        assert abs((out * sizes).sum() - (p * sizes).sum()) < 1e-6
        whole = np.delete(out, left) if left >= 0 else out
        assert np.isin(whole, (0, 1)).all()
        mean += out / 300
    assert abs(mean.mean() - 0.3) < 0.02 and np.abs(mean - 0.3).max() < 0.15


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_ROWS", 16)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    draw = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(draw.integers(1, 60))), ["a", "b", "c", "a", "a", None][i % 6], "x", 5) for i in range(900)]
    rows += [(900, None, "a", "x", 5), (901, "", "b", "x", 5), (902, "one\x0btwo\x1fthree", "c", "x", 5), (None, "no id", "a", "x", 5), (3, rows[3][1], rows[3][2], "x", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, key string, fraction int").repartition(5)
    mix = lambda: mixing.mix(df, scratch=Scratch(spark, "t")).collect()
    got, again = mix(), mix()
    order = lambda rs: sorted((r.doc_id or -1, r.size, r.taken) for r in rs)
    assert order(got) == order(again) and len(got) == len(rows)
    assert {r.size for r in got if r.doc_id in (900, 901)} == {0} and {r.size for r in got if r.doc_id == 902} == {2}
    sizes: dict = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = water_fill(sizes)
    for source, target in want.items():
        mine = [r for r in got if r.source == source]
        assert all(abs(r.target - target) < 1e-6 * target and r.source_size == sizes[source] and r.taken <= 2 * r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - target) <= max(r.size for r in mine)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(df, scratch=Scratch(spark, "t")).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {(r.doc_id, r.taken) for r in mixing.mix(blank, scratch=Scratch(spark, "t")).collect()} == {(1, 0), (2, 0)}


def test_targets_of_many_sources(spark):
    """As many sources as a crawl has hosts: ranges of the order meet only by their sums, ties of size included."""
    draw = np.random.default_rng(5)
    sizes = {f"host{i:04d}": int(draw.zipf(1.5)) % 100_000 for i in range(3_000)} | {None: 12, "": 0, "z": 900_000}
    rows = [(k, v, 1) for k, v in sizes.items()]
    df = spark.createDataFrame(rows, "source string, source_size long, docs long").repartition(6)
    scratch = Scratch(spark, "t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # ranges of so small a table would be one
    try:
        found = mixing.source_targets(df, (3, 1, 2), 1.5, 2.0, scratch)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = {r.source: (r.target, r.docs) for r in found.collect()}
    want = water_fill(sizes)
    assert got.keys() == want.keys() and all(abs(got[k][0] - want[k]) <= 1e-6 * want[k] and got[k][1] == 1 for k in want)
    for name in ("by_name", "by_level"):  # no range holds most of the sources
        held = spark.read.parquet(f"{scratch.root}/{name}").groupBy("range").count().collect()
        assert len(held) > 1 and max(r["count"] for r in held) < 0.7 * len(sizes)
    assert mixing.source_targets(df.limit(0), (3, 1, 2), 1.5, 2.0, scratch=Scratch(spark, "t")).count() == 0
