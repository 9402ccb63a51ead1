"""Queries over whole tables and whole texts against their SQL."""

import glob
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from marlstone.functions import chunk
from marlstone.functions import text as tx
from marlstone.operators import retrieval
from marlstone.plans import catalogue

DATA = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(repr([round(v, 6) if isinstance(v, float) else str(v) for v in r]) for r in frame.itertuples(index=False))


def like_sql(spark, name, data=DATA):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    got = entry.queries()[name](spark, data).toPandas()
    assert rows(got) == rows(con.execute(entry.oracle_sql()[name]).fetchdf())
    return got


DENSE = ["dense_topk", "dense_topk_similarity", "maxsim", "metric_similarity", "rrf_single", "calibrate_minmax"]
HYBRID = ["hybrid_fuse", "hybrid_topk", "confidence_gate", "compare_dense_hybrid"]


@pytest.mark.parametrize("name", DENSE + HYBRID)
def test_every_twentieth_row_asks(spark, name):
    ids = {r.vec_id for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id").collect()}
    if name in HYBRID:
        ids &= {r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect()}
    got = like_sql(spark, f"{name}")
    assert set(got["query_id"]) == {i for i in ids if i % 20 == 0} and max(ids) > 40


@pytest.mark.parametrize("name", ["mmr_rerank", "hybrid_search"])
def test_every_twentieth_row_gets_results(spark, name):
    got = entry.queries()[f"{name}"](spark, DATA).select("query_id").distinct().collect()
    assert {r.query_id for r in got} == set(like_sql(spark, "hybrid_topk")["query_id"])


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BROADCAST_QUERIES", 2)
    monkeypatch.setattr(retrieval, "CORPUS_SLICE_ROWS", 100)
    monkeypatch.setattr(retrieval, "STRIP_ROWS", 7)
    like_sql(spark, "dense_topk")
    like_sql(spark, "dense_distance_summary")


def test_backfill_has_long_documents(spark):
    got = like_sql(spark, "backfill")
    assert len(got) == spark.read.parquet(f"{DATA}/documents.parquet").count()


def test_lexicon_of_a_long_text(spark):
    """One sort: 60 000 different tokens would take 60 000 passes over all of them."""
    words = [f"w{i}" for i in range(60_000)] + ["w7", "w3", "w7"]
    df = spark.createDataFrame([(" ".join(words),), ("bb aa bb",), (None,)], "text string").select(tx.lexicon(tx.tokenize("text")).alias("m"))
    big, small, none = (r.m for r in df.collect())
    assert len(big) == 60_000 and big["w7"] == round(3 / len(words), 6)
    assert list(small.items()) == [("bb", 0.666667), ("aa", 0.333333)] and none == {}


@pytest.mark.parametrize(("name", "length"), [("clean_markdown", "cleaned"), ("convert_wikilinks", "converted")])
def test_whole_texts_are_rewritten(spark, name, length):
    got = like_sql(spark, f"{name}")
    assert got[length].str.len().max() > 1000


def test_whole_texts_are_measured(spark):
    assert like_sql(spark, "note_front_matter")["body_length"].max() > 1000
    like_sql(spark, "adaptive_weights")


def test_links_of_the_pages_own_anchors(spark, tmp_path):
    assert len(like_sql(spark, "link_extraction")) > 0
    page = '<a class="n" href="/The">The <b>One</b></a> <a href="http://x.org/y">Out</a> <a href="p#h">\nq  r</a> <a href="">none</a>'
    spark.createDataFrame([(1, "http://h/", page), (2, "http://h/", "no links")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = like_sql(spark, "link_extraction", str(tmp_path))
    assert sorted(got["concept_id"]) == ["http://x.org/y", "p", "q r", "the", "the one"]


@pytest.mark.parametrize("name", ["token_frequencies", "sparse_features", "insert_if_absent", "orphan_cleanup", "level_distribution", "point_lookup"])
def test_no_rows_go(spark, name):
    got = like_sql(spark, f"{name}")
    if name in ("token_frequencies", "sparse_features"):
        assert got["docs"].min() == 1
    if name == "insert_if_absent":
        assert set(got["doc_id"] % 4) == {0, 1, 2, 3}
    if name == "point_lookup":
        assert len(got) > 1


@pytest.mark.parametrize("name", ["anti_seen_source", "anti_seen_hash", "orphan_cleanup", "ledger_diff", "tombstone"])
def test_some_rows_are_compared(spark, name):
    assert len(like_sql(spark, name)) > 0


@pytest.mark.parametrize("name", ["sparse_recall", "sparse_recall_excluding", "sparse_min_overlap", "hybrid_topk", "mmr_rerank", "hybrid_search"])
def test_joins_beyond_the_broadcast_bounds(spark, monkeypatch, name):
    monkeypatch.setattr(retrieval, "BROADCAST_TOKENS", 16)
    like_sql(spark, name)


@pytest.mark.parametrize("name", ["sparse_recall", "hybrid_fuse"])
def test_sparse_search_by_blocks_writes_no_pairs(spark, monkeypatch, name):
    """Each block of queries has a scan of its own, whose tasks keep their best; postings of all documents are never joined."""
    monkeypatch.setattr(retrieval, "BROADCAST_TOKENS", 16)
    monkeypatch.setattr(retrieval, "BLOCK_QUERIES", 20)
    monkeypatch.setattr(retrieval, "CELLS", 1 << 10)
    monkeypatch.setattr(retrieval, "sparse_scores", None)
    like_sql(spark, name)


def test_overlap_scores_compute_their_pairs_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    docs = spark.createDataFrame([(i, f"every one has word{i}") for i in range(6)], "id long, text string")
    pairs = spark.createDataFrame([(q, i) for q in (0, 1) for i in range(6)], "query_id long, id long").mapInPandas(counted, "query_id long, id long")
    found = {(r.query_id, r.id): r.score for r in retrieval.overlap_scores(pairs, docs.where("id < 2"), docs).collect()}
    assert found == {(q, i): 1.0 if q == i else 0.75 for q in (0, 1) for i in range(6)}
    assert seen.value == 12  # a search that finds the pairs runs once


def _plain_recursive(text, size=450, overlap=100, least=50):
    """The recursive chunker as a recursion over one piece and one separator at a time."""

    def cut(piece, level):
        if len(piece) <= size:
            return [piece]
        if level == len(chunk.SEPARATORS):
            return [piece[i : i + size] for i in range(0, max(1, len(piece) - overlap), size - overlap)]
        glue = chunk.SEPARATORS[level]
        if glue not in piece:
            return cut(piece, level + 1)
        out, held = [], ""
        for part in [p.strip() for p in piece.split(glue) if p.strip()]:
            longer = held + glue + part if held else part
            if held and len(longer) > size:
                out, held = [*out, held], part
            else:
                held = longer
        return [c for p in ([*out, held] if held else out) for c in cut(p, level + 1)]

    if not text or len(text) < least:
        return []
    if len(text) <= size:
        return [text]
    merged = []
    for piece in cut(text, 0):
        if merged and len(merged[-1]) < 0.8 * size:
            merged[-1] += "\n\n" + piece
        else:
            merged.append(piece)
    return merged


def _plain_headings(text, size=450, overlap=100):
    """The heading chunker line by line, with the headings that hold kept as it goes."""
    body = (text or "").strip()
    if not body:
        return []
    if len(body) < chunk.WHOLE_NOTE:
        return [(chunk.WHOLE, body)]
    first = second = ""
    parts, path, lines = [], chunk.PREFACE, []
    for line in body.splitlines():
        found = re.fullmatch(r"(#{1,6})\s+(.*?)\s*", line)
        if found and len(found[1]) == 1:
            first, second = found[2].strip(), ""
        elif found and len(found[1]) == 2:
            second = found[2].strip()
        if found and len(found[1]) in (2, 3):
            parts.append((path, "\n".join(lines).strip()))
            path, lines = "/".join(p for p in (first, second) if p) or chunk.UNNAMED, []
        lines.append(line)
    parts.append((path, "\n".join(lines).strip()))
    out = []
    for path, part in parts:
        pieces = [part] if len(part) <= size else [part[i : i + size].strip() for i in range(0, max(1, len(part) - overlap), size - overlap)]
        out += [(path, p) for p in pieces if p]
    return out


def test_chunkers_over_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = {}
    for r in catalogue.QUERIES["chunk_recursive"](spark, "/root/testdata/sf0.01").orderBy("chunk_index").collect():
        got.setdefault(r.doc_id, []).append(r.chunk)
    assert got == {d: c for d, t in docs if (c := _plain_recursive(t))}
    got = {}
    for r in catalogue.QUERIES["chunk_headings"](spark, "/root/testdata/sf0.01").orderBy("seq").collect():
        got.setdefault(r.doc_id, []).append((r.heading_path, r.text))
    marked = {d: f"# T{d}\n{t[:300]}\n## S\n{t}\n### D\n{t[-400:]}" for d, t in docs if t is not None}
    assert got == {d: c for d, t in marked.items() if (c := _plain_headings(t))}
    for _, text in docs:
        marked = re.sub(r"\n", lambda m, n=iter(range(10**6)): ("\n# A", "\n## B", "\n### C", "\n")[next(n) % 4] + "x\n", text or "")
        assert chunk.note_chunks(marked) == _plain_headings(marked)
