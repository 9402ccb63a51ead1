"""Operators on small frames: retrieval beyond the broadcast bound, fusion, ledger, ingest, analytics, sources."""

import datetime as dt
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlstone.operators import analytics, ferment, fusion, graph, ledger, retrieval
from marlstone.plans import ingest, nightly
from marlstone.session import Store
from marlstone.sources import config, embed, extractors, files, tables
from marlstone.streaming.ingest import append_chunks, stream_texts
from marlstone.streaming.windows import daily_counts


@pytest.mark.parametrize("bound", [4096, 2])
def test_dense_topk(spark, monkeypatch, bound):
    monkeypatch.setattr(retrieval, "BROADCAST_QUERIES", bound)
    x = np.random.default_rng(1).normal(size=(80, 5))
    x[7] = 0
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(99, None)]
    corpus = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    got = retrieval.dense_topk(corpus.where("id < 5 or id = 99").withColumnRenamed("id", "query_id"), corpus, 4).orderBy("query_id", "rank").collect()
    unit = x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
    for q in range(5):
        d = np.round(1 - unit @ unit[q], 6) + 0.0
        want = np.lexsort((np.arange(80), d))[:4]
        assert [r.id for r in got if r.query_id == q] == want.tolist()
    assert len(got) == 20


@pytest.mark.parametrize("copies", [False, True])
def test_nearest_in_strips(monkeypatch, copies):
    """Matrices of bounded size, and the results of one matrix: with copies, zeros and what isn't finite."""
    monkeypatch.setattr(retrieval, "CELLS", 1)
    monkeypatch.setattr(retrieval, "_WAITING", 100)
    draw = np.random.default_rng(2)
    x = draw.integers(-1, 2, (700, 3)).astype(float) if copies else draw.normal(size=(700, 8))
    x[5], x[6, 1], x[7, 0], x[8], x[9] = 0, np.nan, np.inf, x[3] * 1e-160, x[4] * 1e160
    ids, cells, widest = draw.permutation(700), [], retrieval.Best.offer
    monkeypatch.setattr(retrieval.Best, "offer", lambda self, likeness, *a: (cells.append(likeness.size), widest(self, likeness, *a)))
    best = retrieval.Nearest(np.arange(60), x[:60], 9)
    for a in range(0, 700, 130):  # batches
        best.add(ids[a : a + 130], x[a : a + 130])
    got = best.frame()
    assert max(cells) <= 60 * 64
    with np.errstate(all="ignore"):
        lengths = np.linalg.norm(x, axis=1)
        both = lengths[:60, None] * lengths[None, :]
        d = np.round(np.where(both > 0, 1 - np.einsum("ij,kj->ik", x[:60], x) / both, 1.0), 6) + 0.0
    for q in range(60):
        want = np.lexsort((ids, d[q]))[:9]
        mine = got[got["query_id"] == q].sort_values(["distance", "id"])
        assert mine["id"].tolist() == ids[want].tolist() and np.array_equal(mine["distance"], d[q][want], equal_nan=True)


@pytest.mark.parametrize("cells, normalize", [(1 << 20, True), (64, True), (64, False)])
def test_best_by_weights_in_strips(monkeypatch, cells, normalize):
    """Tokens that many or few queries have, copies and ties, against one document at a time."""
    monkeypatch.setattr(retrieval, "CELLS", cells)
    monkeypatch.setattr(retrieval, "_WAITING", 50)
    draw = random.Random(3)
    words, odds = [f"w{i}" for i in range(400)], [1 / (i + 1) for i in range(400)]
    queries = {q: sorted(set(draw.choices(words, odds, k=draw.randint(1, 40)))) for q in range(50)}
    rows = pd.DataFrame([(q, t, len(ts)) for q, ts in queries.items() for t in ts], columns=["query_id", "token", "n_tokens"]).sample(frac=1, random_state=1)
    docs = [draw.choices(words, odds, k=draw.randint(0, 60)) for _ in range(900)]
    docs[5:40] = [docs[3]] * 35
    ids = draw.sample(range(900), 900)
    best = retrieval._Asked(rows, 7, normalize)
    for i, d in zip(ids, docs, strict=True):
        best.add(i, d)
    got = best.frame()
    for q, ts in queries.items():
        sums = [(i, sum(retrieval._weight(n, len(d)) for t, n in Counter(d).items() if t in ts)) for i, d in zip(ids, docs, strict=True)]
        score = lambda m, n=len(ts) if normalize else 1: int(np.floor(m / n + 0.5))
        want = sorted((-score(m), i, m) for i, m in sums if score(m))[:7]
        mine = got[got["query_id"] == q]
        assert sorted(zip(mine["id"], mine["micros"], strict=True)) == sorted((i, m) for _, i, m in want)


def test_calibrate_and_rrf(spark):
    rows = spark.createDataFrame([(1, 0.1), (1, 0.5), (1, 0.9), (2, 0.5), (2, 0.5), (3, 0.0)], "query_id long, s double")
    got = sorted((r.query_id, r.c) for r in rows.select("query_id", fusion.calibrated(F.col("s")).alias("c")).collect())
    assert got[0] == (1, 0.0) and got[2] == (1, 1.0) and got[3:] == [(2, 1.0), (2, 1.0), (3, 0.0)]
    scores = [r.v for r in spark.range(1, 5).select(fusion.reciprocal_rank(F.col("id")).alias("v")).orderBy("id").collect()]
    assert scores == sorted(scores, reverse=True) and scores[-1] > 0


def test_diversity_matches_a_plain_greedy_choice():
    draw = random.Random(2)
    for _ in range(100):
        n = draw.randint(1, 12)
        scores, distances, k = sorted((draw.random() for _ in range(n)), reverse=True), [draw.choice([-1, draw.random()]) for _ in range(n)], 5
        got = fusion._diverse(scores, distances, k, 0.7)
        if n > k:
            chosen = [0]
            while len(chosen) < k:
                gain = {i: 0.7 * scores[i] - 0.3 * max(0, *(1 - abs(distances[i] - distances[j]) / 2 for j in chosen)) for i in range(n) if i not in chosen}
                chosen.append(max(gain, key=lambda i: (gain[i], -i)))
            assert got == chosen
        else:
            assert got == list(range(n))


def test_ledger_lifecycle(spark):
    notes = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "rel_path string, sha256 string")
    empty = notes.limit(0)
    status = lambda now, then: {r.rel_path: r.status for r in ledger.diff(now, then).collect()}
    assert status(notes, empty) == dict.fromkeys("abc", "new")
    stored = ledger.upsert(empty, notes, "rel_path")
    assert status(notes, stored) == dict.fromkeys("abc", "unchanged")
    changed = ledger.upsert(notes, spark.createDataFrame([("b", "9")], notes.schema), "rel_path")
    assert status(changed.where("rel_path <> 'c'"), stored) == {"a": "unchanged", "b": "changed", "c": "deleted"}
    assert sorted(map(tuple, ledger.upsert(stored, notes, "rel_path").collect())) == sorted(map(tuple, stored.collect()))


def test_vault_ingest(spark, tmp_path):
    vault = tmp_path / "vault"
    for path, text in {"规范/消防.md": "---\naliases: [x]\ntags: [消防]\n---\n# 设计要点\n见 [[方案]] 与 [[GB50016|防火规范]]\n## 一\n" + "耐火极限。" * 200, "短.md": "短笔记", "_system/s.md": "no", ".obsidian/o.md": "no", "空.md": "---\na: b\n---\n", "a 冲突.md": "no", "x+y z.md": "plus"}.items():
        (vault / path).parent.mkdir(parents=True, exist_ok=True)
        (vault / path).write_text(text)
    (vault / "bad.md").write_bytes(b"ok \xff bytes")
    notes = files.scan_notes(spark, str(vault)).collect()
    assert {n.rel_path for n in notes} == {"规范/消防.md", "短.md", "空.md", "bad.md", "x+y z.md"} and {n.top_folder for n in notes} == {"规范", "(root)"}
    assert all(len(n.sha256) == 64 for n in notes) and next(n.text for n in notes if n.rel_path == "bad.md") == "ok � bytes"
    store = Store(str(tmp_path / "store"))
    routes = spark.createDataFrame([("规范", "codes")], "top_folder string, collection string")
    rules = spark.createDataFrame([("短.md", "short", 0, 0)], "match string, collection string, chunk_size int, overlap int")
    run = lambda dry=False: {r.rel_path: r.status for r in ingest.ingest(spark, str(vault), store, routes, rules, "notes", F.lit("2024-05-01").cast("timestamp"), dry_run=dry).collect()}
    assert set(run(True).values()) == {"new"} and not (tmp_path / "store").exists()
    assert set(run().values()) == {"new"} and set(run().values()) == {"unchanged"}
    chunks = ingest.live_chunks(spark, store)
    by = {r.source: r for r in chunks.where("chunk_index = 1").collect()}
    assert by["规范/消防.md"].collection == "codes" and by["短.md"].collection == "short" and by["bad.md"].collection == "notes"
    assert by["规范/消防.md"].title == "设计要点" and by["规范/消防.md"].links == ["方案", "GB50016"] and by["规范/消防.md"].tags == ["消防"] and by["规范/消防.md"].chunk_id == "规范/消防.md#001"
    assert chunks.where("length(document) > 450").count() == 0
    (vault / "短.md").write_text("新的内容")
    (vault / "bad.md").unlink()
    assert {k: v for k, v in run().items() if v != "unchanged"} == {"短.md": "changed", "bad.md": "deleted"}
    left = ingest.live_chunks(spark, store)
    assert left.where("source = 'bad.md'").count() == 0 and left.where("source = '短.md'").first().document == "新的内容"
    assert {r.rel_path for r in ingest.known_files(spark, store).collect()} == {"规范/消防.md", "短.md", "x+y z.md"}


def test_inbox_and_extractors(spark, tmp_path):
    (tmp_path / "a.MD").write_text("﻿---\ntitle: T\ntags: a，b\n---\n" + "body text " * 5)
    (tmp_path / "b.txt").write_text("short")
    (tmp_path / "c.pdf").write_bytes(b"not a pdf")
    rows = files.scan_inbox(spark, str(tmp_path)).collect()
    assert [(r.rel_path, r.meta, r.tags) for r in rows] == [("a.MD", {"title": "T", "tags": "a，b"}, ["a", "b"])]
    found = {(r.rel_path, r.error is None) for r in extractors.extract(files.scan_folder(spark, str(tmp_path), ("pdf", "txt", "md"))).collect()}
    assert found == {("a.MD", True), ("b.txt", True), ("c.pdf", False)}
    assert [r.rel_path for r in files.scan_folder(spark, str(tmp_path), ("txt", "md"), least_size=50).collect()] == ["a.MD"]


def test_embed(spark):
    def client(texts):
        if "bad" in texts:
            raise ValueError
        return [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([("abc",), (None,), ("bad",)], "t string").coalesce(1)
    assert [r.v for r in df.select(embed.embed(F.col("t"), client, batch=1, longest=2).alias("v")).collect()] == [[2.0, 1.0], [0.0, 1.0], [2.0, 1.0]]
    assert [r.v for r in df.select(embed.embed(F.col("t"), client, batch=1).alias("v")).collect()][2] is None


def test_graph_and_ferment(spark):
    rows = spark.createDataFrame([("s1", [("a", "A"), ("b", "B"), ("a", "A")]), ("s2", [("a", "AA"), ("", "")]), (None, [("c", None)])], "source string, links array<struct<concept_id: string, display: string>>")
    edges = graph.mentions(rows)
    g = {r.concept_id: r for r in graph.concepts(edges).collect()}
    assert g["a"].total_mentions == 3 and g["a"].backlinks == ["s1", "s2"] and g["a"].concept_name == "A" and g["c"].concept_name == "c" and g["c"].backlinks == ["unknown"]
    assert [tuple(r) for r in graph.related(edges).orderBy("concept_id").collect()] == [("a", 1, "b", 1), ("b", 1, "a", 1)]
    assert graph.stats(edges.limit(0)).first().concepts == 0
    store = spark.createDataFrame([("a", "A", 1, 0, dt.datetime(2024, 1, 1), False), ("z", "Z", 2, 0, dt.datetime(2024, 1, 1), False)], "concept_id string, concept_name string, mention_count long, enrichment_level int, last_seen timestamp, needs_review boolean")
    pages = {r.concept_id: r for r in ferment.reconcile(store, graph.concepts(edges), F.lit("2024-02-01").cast("timestamp")).collect()}
    assert (pages["a"].enrichment_level, pages["a"].needs_review, pages["a"].event) == (1, True, "mentions: 1 -> 3")
    assert (pages["b"].enrichment_level, pages["b"].action) == (0, "created") and pages["z"].action == "kept"
    assert {r.concept_id for r in ferment.stale_stubs(store, F.lit("2024-02-01").cast("timestamp"), 30).collect()} == {"a", "z"}
    assert ferment.stale_stubs(store, F.lit("2024-01-31 23:59:59").cast("timestamp"), 30).count() == 0


def test_gaps_and_roll_up(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 4), ("a", 4), ("b", 2), ("c", 0), ("c", 1)], "source string, chunk_index int")
    assert [tuple(r) for r in analytics.chunk_gaps(rows).collect()] == [("a", 1, 4, 2)]
    assert [tuple(r) for r in analytics.gap_summary(rows).collect()] == [("a", 1, 4, 2, 2)]
    probes = spark.createDataFrame([("x", "ok"), ("x", "warn"), ("y", "fail"), ("z", "ok")], "g string, status string")
    assert {r.g: r.health for r in analytics.roll_up(probes, "g").collect()} == {"x": "warning", "y": "critical", "z": "healthy"}


def test_streams(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.txt").write_text("a" * 1000)
    run = lambda: append_chunks(stream_texts(spark, str(inbox)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    (inbox / "b.txt").write_text("b" * 100)
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "events"))
    stream = daily_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")))
    q = stream.writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("daily").collect())) == sorted(map(tuple, daily_counts(events).collect()))


def test_nightly_run(spark, tmp_path):
    store = Store(str(tmp_path / "s"))
    link = lambda *names: [(n.lower(), n) for n in names]
    notes = spark.createDataFrame([("n1", link(*["A"] * 9, *["B"] * 3, "C")), ("n2", link("A", "B"))], "source string, links array<struct<concept_id: string, display: string>>")
    corpus = spark.createDataFrame([(f"c{i}", f"s{i % 3}", f" fact {i} ", [1.0, i / 10]) for i in range(12)], "chunk_id string, source string, document string, embedding array<float>")
    encode = lambda c: F.array(F.lit(1.0), F.lit(0.0))
    night = lambda n, rows=notes: nightly.run(spark, rows, corpus, store, F.lit(f"2024-05-{n:02d}").cast("timestamp"), f"night{n}", encode).first().asDict()
    first = night(1)
    assert (first["stubs_created"], first["enriched"], first["pages"]) == (3, 0, 3)
    second = night(2)
    assert (second["upgrades_basic"], second["upgrades_full"], second["enriched"], second["timeline_entries"]) == (2, 1, 2, 0)
    pages = {r.concept_id: r for r in nightly.concepts(spark, store).collect()}
    assert pages["a"].enrichment_level == 2 and pages["a"].related == ["b", "c"] and len(pages["a"].key_facts) == 8 and pages["a"].confidence == 0.55 and not pages["a"].needs_review
    assert pages["a"].key_facts[0] == "fact 0" and pages["b"].confidence == 0.5 and len(pages["b"].key_facts) == 5 and pages["c"].summary is None and pages["a"].open_questions
    entries = {(r.concept_id, r.seq): r.event for r in nightly.timeline(spark, store).collect()}
    assert set(entries) == {("a", 1), ("b", 1), ("c", 1), ("a", 2), ("b", 2)}
    night(2)  # again: nothing more
    assert nightly.timeline(spark, store).count() == 5
    night(9, notes.where("source = 'n2'"))
    pages = {r.concept_id: r for r in nightly.concepts(spark, store).collect()}
    assert pages["a"].mention_count == 1 and pages["a"].enrichment_level == 0 and pages["c"].last_seen.day == 2 and pages["a"].first_seen.day == 1
    gone = nightly.clean_up(spark, store, F.lit("2024-06-05").cast("timestamp"))
    assert {r.concept_id for r in gone.collect()} == {"c"} and nightly.concepts(spark, store).count() == 2


def test_scans_of_vault_and_hub(spark, tmp_path):
    for path in ("a.md", "backups/b.md", "_system/c.md", "x/Conflict y.md", "d.txt"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x" * 60)
    (tmp_path / "small.md").write_text("x")
    names = lambda df: {r.rel_path for r in df.collect()}
    assert names(files.scan_hub(spark, str(tmp_path))) == {"a.md", "x/Conflict y.md"}  # Spark lists nothing below _system
    assert names(files.scan_vault(spark, str(tmp_path))) == {"a.md", "backups/b.md"}
    assert files.merged(files.scan_hub(spark, str(tmp_path)), files.scan_vault(spark, str(tmp_path))).count() == 3


def test_related_concepts_of_a_hub(spark, monkeypatch):
    rows = [("hub", f"c{i}") for i in range(40)] + [("s1", "c1"), ("s1", "c2"), ("s2", "c1"), ("s2", "c3"), ("s3", "c2")]
    edges = spark.createDataFrame(rows, "source string, concept_id string")
    whole = sorted(map(tuple, graph.related(edges).collect()))
    monkeypatch.setattr(graph, "HUB", 7)
    assert sorted(map(tuple, graph.related(edges).collect())) == whole and ("c1", 1, "c2", 2) in whole and ("c1", 3, "c0", 1) in whole


def test_routing_and_concept_files(spark, tmp_path):
    routes, rules, default = config.read_routing(spark, str(tmp_path / "none.yaml"), "all")
    assert (routes.count(), rules.count(), default) == (0, 0, "all")
    rule = {"match": "a.md", "collection": "codes", "chunk_size": 1200, "overlap": 200}
    routes, rules, default = config.routing(spark, {"default": "d", "routes": {"Inbox": "in"}, "file_rules": [rule, {"match": "a.md"}]}, "all")
    assert [tuple(r) for r in routes.collect()] == [("Inbox", "in")] and [tuple(r) for r in rules.collect()] == [("a.md", "codes", 1200, 200)] and default == "d"
    (tmp_path / "c.json").write_text('{"a": {"concept_name": "A", "mention_count": 3, "last_seen": "2024-01-02T03:04:05", "compiled_truth": {"summary": "s", "key_facts": ["f"]}}, "b": {}}')
    (tmp_path / "broken.json").write_text('{"a": {')
    found = {r.concept_id: r for r in config.read_concepts(spark, str(tmp_path / "c.json")).collect()}
    assert (found["a"].mention_count, found["a"].key_facts, found["a"].last_seen) == (3, ["f"], dt.datetime(2024, 1, 2, 3, 4, 5)) and found["b"].concept_name == "b"
    assert config.read_concepts(spark, str(tmp_path / "broken.json")).count() == config.read_concepts(spark, str(tmp_path / "missing.json")).count() == 0
