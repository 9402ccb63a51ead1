"""Rollups, the hashing embedder, backfill, scans by type, and reports, each against the plain way."""

import datetime as dt
import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import chunk, hashing
from marlstone.functions import text as tx
from marlstone.operators import analytics, ferment, retrieval, rollups, sparse_index, vector_index
from marlstone.plans import catalogue, search
from marlstone.sources import files

DATA = "/root/testdata/sf0.01"


def test_rollups_give_the_reports_of_all_chunks(spark, tmp_path):
    draw, at = random.Random(2), dt.datetime(2024, 5, 1, 13, 30)
    rows = [(draw.choice(["a", "b", "c", None]), draw.choice(["x", "y", None]), at - dt.timedelta(minutes=draw.randint(0, 300 * 1440))) for _ in range(800)]
    rows += [("edge", "x", at - dt.timedelta(days=181)), ("edge", "x", at - dt.timedelta(days=181, seconds=-1)), ("week", "y", at - dt.timedelta(days=7)), ("week", "y", at - dt.timedelta(days=7, seconds=1)), ("d30", "x", at - dt.timedelta(days=30))]
    chunks = spark.createDataFrame(rows, "source string, type string, ts timestamp")
    path = str(tmp_path / "r")
    rollups.write(chunks.where("type = 'x'"), path, "one")
    for _ in range(2):  # a repeated run replaces itself
        rollups.write(chunks.where("type <> 'x' or type is null"), path, "two")
    rolled, now = rollups.read(spark, path), F.lit(at).cast("timestamp")
    same = lambda a, b: sorted(map(str, (tuple(r) for r in a.collect()))) == sorted(map(str, (tuple(r) for r in b.collect())))
    assert same(rollups.stats(rolled), analytics.stats(chunks)) and same(rollups.breakdown(rolled, "type"), analytics.breakdown(chunks, "type"))
    assert same(rollups.expired(rolled, chunks, now), analytics.expired(chunks, now)) and same(rollups.expiring(rolled, chunks, now), analytics.expiring(chunks, now))
    assert same(rollups.recent(rolled, chunks, now), analytics.recent(chunks, now)) and same(rollups.today_and_week(rolled, chunks, now), analytics.today_and_week(chunks, now))
    assert rollups.stats(rollups.read(spark, str(tmp_path / "none"))).first().total == 0
    many = spark.range(20_000).select(F.concat(F.lit("s"), F.col("id") % 9_000).alias("source"), F.lit("x").alias("type"), now.alias("ts"))
    rollups.write(many, str(tmp_path / "many"), "r")
    about = rollups.approximate_sources(spark, str(tmp_path / "many")).first()
    assert about.total == 20_000 and abs(about.sources - 9_000) < 0.03 * 9_000


def test_hashed_vectors_put_near_copies_first(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) > 200 and doc_id < 300").select(F.col("doc_id").alias("id"), "text")
    encode = hashing.embedder(docs, idf := hashing.learn(docs))
    texts = {r.id: r.text for r in docs.collect()}
    features = hashing.Features()
    for r in docs.select("id", encode(F.col("text")).alias("v")).limit(5).collect():
        assert np.allclose(r.v, hashing.vector(hashing.Features(), texts[r.id], idf)) and np.linalg.norm(r.v) == pytest.approx(1)
    asked = [(i, " ".join(w for j, w in enumerate(texts[i].split()) if j % 11)) for i in sorted(texts)[::20]]  # a copy without every eleventh word
    found = retrieval.text_topk(spark.createDataFrame(asked, "query_id long, text string"), docs.select("id", encode(F.col("text")).alias("vector")), encode, 1).collect()
    first = {r.query_id: texts[r.id] for r in found}
    copies = [hashing.vector(features, first[i], idf) @ hashing.vector(features, texts[i], idf) for i, _ in asked]
    assert min(copies) > 0.8 and sum(first[i] == texts[i] for i, _ in asked) >= 0.9 * len(asked)
    assert not hashing.vector(features, None, idf).any() and not hashing.vector(features, "a 。", idf).any()
    assert hashing.learn(docs.limit(0)).shape == (hashing.SLOTS,)


def test_backfill_keeps_and_fills(spark):
    rows = [(1, "alpha beta alpha", None, None), (2, "gamma delta", '{"mine":1.0}', None), (3, "not looked at", '{"mine":1.0}', "[]"), (4, None, None, None)]
    got = {r.id: r for r in retrieval.backfill(spark.createDataFrame(rows, "id long, text string, sparse_lexicon string, colbert_tokens string")).collect()}
    assert json.loads(got[1].sparse_lexicon) == {"alpha": 0.666667, "beta": 0.333333} and len(json.loads(got[1].colbert_tokens)) == 3
    assert got[2].sparse_lexicon == '{"mine":1.0}' and [t["token"] for t in json.loads(got[2].colbert_tokens)] == ["gamma", "delta"]
    assert tuple(got[3]) == rows[2] and got[4].sparse_lexicon == "{}"


def test_scans_by_type_and_for_migration(spark, tmp_path):
    for name, text in {"pdf/a.PDF": "x", "pdf/b.txt": "x", "img/c.png": "x", "img/sub/d.png": "x", "vault/long.md": "---\nk: v\nk: w\n---\n see [[A|b]] and [[A|b]] and ![[C#d]] here ", "vault/short.md": "---\nk: v\n---\n  tiny body   ", "vault/_system/x.md": "y" * 50}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    kinds = {"PDF": (str(tmp_path / "pdf"), ("pdf",)), "image": (str(tmp_path / "img"), ("png", "jpg")), "none": (str(tmp_path / "no"), ("doc",))}
    assert sorted((r.type, r.rel_path) for r in files.scan_typed(spark, kinds).collect()) == [("PDF", "a.PDF"), ("image", "c.png")]
    assert files.scan_typed(spark, {}).count() == 0
    (note,) = files.scan_migration(spark, str(tmp_path / "vault")).collect()
    assert note.rel_path == "long.md" and note.wikilinks == ["A|b", "A|b", "C#d"] and note.meta == {"k": "w"} and note.body.startswith("see")


def test_an_images_text_stays_whole(spark):
    rows = [("png", " " * 5 + "y" * 100), ("PNG", "z" * 449 + " "), ("png", "short"), ("pdf", "w" * 460), ("jpg", "v" * 900), (None, "u" * 60)]
    got = [r.c for r in spark.createDataFrame(rows, "e string, t string").select(chunk.extracted(F.col("t"), F.col("e")).alias("c")).collect()]
    assert got[0] == [rows[0][1]] and got[1] == [rows[1][1]] and got[2] == [] and len(got[3]) == 2 and len(got[4]) == 3 and got[5] == ["u" * 60]


def test_dependencies_and_lines(spark):
    probes = [(True, 200, None), (True, 503, None), (True, None, "refused"), (False, None, "ignored")]
    health = lambda some: tuple(analytics.dependency_health(spark.createDataFrame(some, "required boolean, code int, error string")).first())
    assert health(probes) == ("warn", 3, 1, 1) and health(probes[:1]) == ("pass", 1, 0, 0) and health(probes[3:]) == ("pass", 0, 0, 0)
    line = lambda *n: analytics.health_summary(spark.createDataFrame([n], "total long, expired long, dead long, gaps long")).first().summary
    assert line(7, 0, 0, 0) == "知识库共 7 条记录 | 一切正常!" and line(7, 1, 0, 2) == "知识库共 7 条记录 | 1 个来源已过期 | 2 个文档存在碎片缺失"
    kind = "pages long, concepts long, edges long, avg_mentions double, stubs_created long, upgrades_basic long, upgrades_full long, enriched_basic long, enriched_full long, removed long"
    told = lambda *n: ferment.diff_summary(spark.createDataFrame([n], kind)).first().summary
    assert told(5, 4, 9, 2.25, 0, 0, 0, 0, 0, 0) == "总计 5 个概念页面 | 图谱: 4 概念, 9 边, 平均 2.3 次引用"
    assert told(5, 4, 9, 2.0, 1, 2, 3, 4, 0, 6).endswith("新建 1 个 stub 页面 | 升级: basic=2, full=3 | 富化: 基础富化 4 | 清理 6 个孤立概念")


def test_modes_compared_and_hybrid_search_on_indexes(spark, tmp_path):
    queries, corpus = catalogue._hybrid(spark, DATA)
    rows = search.compare_modes(queries, corpus, 5, str(tmp_path / "report")).collect()
    want = {r.query_id: (r.top1_changed, r.overlap) for r in catalogue.compare_dense_hybrid(spark, DATA).collect()}
    assert {r.query_id: (r.top1_changed, r.overlap) for r in rows} == want and all(r.dense_ms > 0 and r.sparse_ms > 0 and r.hybrid_ms > 0 for r in rows)
    assert spark.read.json(str(tmp_path / "report")).count() == len(rows)
    sparse_index.build(corpus, str(tmp_path / "w"))
    plain = sorted(map(tuple, search.hybrid_pool(queries, corpus, 5).collect()))  # id, query_id, ...
    assert sorted(map(tuple, search.hybrid_pool(queries, corpus, 5, words=str(tmp_path / "w")).collect())) == plain
    vector_index.build(corpus.select("id", "vector"), str(tmp_path / "v"))
    found = {(r.query_id, r.id) for r in search.hybrid_pool(queries, corpus, 5, vectors=str(tmp_path / "v"), words=str(tmp_path / "w")).collect()}
    assert len(found & {(r[1], r[0]) for r in plain}) >= 0.9 * len(plain)


def test_odd_texts_take_no_time(spark):
    spark.range(1).select(tx.strip_html(F.lit("<b>x</b>")), tx.front_matter(F.lit("---\na: b\n---\n"))).collect()
    odd = [("strip_html", "<script>" * 20_000), ("strip_html", "<" * 200_000), ("convert_wikilinks", "[[" * 50_000), ("front_matter", "---\n" + "".join(f"k{i}: v\n" for i in range(5_000)) + "---\n")]
    for name, text in odd:
        began = time.perf_counter()
        spark.createDataFrame([(text,)], "t string").select(getattr(tx, name)(F.col("t")).alias("x")).collect()
        assert time.perf_counter() - began < 10, name
    html = "a<script>b</script>c<style x>d</script>e<script>f < g"
    got = spark.createDataFrame([(html,)], "t string").select(tx.strip_html(F.col("t")).alias("x")).first().x
    assert got == "a c e f < g"
    meta = "---\na: 1\nb: 2\na: 3\n---\n"
    assert spark.createDataFrame([(meta,)], "t string").select(tx.front_matter(F.col("t")).alias("x")).first().x == {"a": "3", "b": "2"}


def test_features_of_all_tokens_at_once():
    """The hashes of a text are those of its tokens one by one: each run of three to five characters once, and the token."""
    tokens = ["banana", "ab", "日本語", "a.b-c_d", "x" * 300, "anana"]
    together, owner = hashing.hashes(tokens)
    for i, t in enumerate(tokens):
        alone, _ = hashing.hashes([t])
        assert sorted(set(together[owner == i])) == sorted(set(alone))
        marked = f"<{t}>"
        assert len(set(alone)) == 1 + len({marked[a : a + n] for n in (3, 4, 5) for a in range(len(marked) - n + 1)})
    found, times = hashing.Features().counts("banana banana anana")
    assert len(found) == len(set(found)) and sorted(set(times)) == [1, 2, 3]
