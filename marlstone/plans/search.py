"""Hybrid search over a batch of queries."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.functions import vector as vec
from marlstone.operators import fusion, retrieval, sparse_index, vector_index
from marlstone.sources import tables


def hybrid_pool(queries: DataFrame, corpus: DataFrame, k: int, parts: int = 4, vectors: str | None = None, words: str | None = None) -> DataFrame:
    """Fused candidates of every query.

    ``queries(query_id, vector, text)`` meet ``corpus(id, vector, text)``: dense hits first,
    then the best sparse ones outside them; both get a lexical and a multi-vector score and
    the three are fused with weights that fit the query.  ``vectors`` and ``words`` name stored indexes
    of the corpus (``vector_index``, ``sparse_index``) to search in place of the corpus itself.
    """
    depth = fusion.pool_size(k)
    asked, tokens = queries.select("query_id", "vector"), retrieval.distinct_tokens(queries, "query_id", "text")
    dense = vector_index.search(asked, vectors, depth) if vectors else retrieval.dense_topk(asked, corpus.select("id", "vector"), depth)
    # so many sparse rows that 2 k are left whatever the dense hits take
    sparse = sparse_index.recall(tokens, words, 2 * k + depth) if words else retrieval.sparse_recall(tokens, corpus, "id", "text", 2 * k + depth)
    pool = tables.settle(fusion.candidate_pool(dense, sparse, 2 * k))
    lexical = retrieval.overlap_scores(pool.select("query_id", "id"), queries.select(F.col("query_id").alias("id"), "text"), corpus.select("id", "text"))
    both = pool.join(lexical.withColumnRenamed("score", "sparse_score"), ["query_id", "id"])
    asked = queries.select("query_id", vec.token_vectors(F.col("vector"), parts).alias("_q"), tx.adaptive_weights(F.col("text")).alias("weights"))
    held = corpus.select("id", vec.token_vectors(F.col("vector"), parts).alias("_d"))
    scored = both.join(asked, "query_id").join(held, "id").withColumn("colbert_score", vec.max_sim(F.col("_q"), F.col("_d"))).drop("_q", "_d")
    return fusion.fuse(scored, F.col("weights"), depth)


def search(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """The k results of every query: fused, diversified, with similarity, gate and snippet."""
    fused = hybrid_pool(queries, corpus, k)
    first = Window.partitionBy("query_id").orderBy("rank")
    top = fusion.diversify(fused, k)
    top = top.withColumn("confidence_ok", F.first(fusion.confident(F.col("score"), F.col("distance"))).over(first))
    near = F.when(F.col("distance") >= 0, vec.similarity(F.col("distance")))
    rows = top.join(corpus.select("id", F.col("text").alias("document")), "id").join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    return rows.select("query_id", "rank", "id", "score", near.alias("similarity"), "confidence_ok", tx.snippet(F.col("document"), F.col("query")).alias("snippet"))


MODES = ("dense", "sparse", "hybrid")


def compare_modes(queries: DataFrame, corpus: DataFrame, k: int, path: str | None = None) -> DataFrame:
    """``query_id, top1_changed, overlap, dense_sparse_overlap`` of dense, sparse and hybrid search, with the mean time of each mode.

    Every mode runs as one batch; ``dense_ms``, ``sparse_ms`` and ``hybrid_ms`` are its time over the number
    of queries.  ``path``: also write the rows there as JSON.
    """
    runs = {
        "dense": lambda: retrieval.dense_topk(queries.select("query_id", "vector"), corpus.select("id", "vector"), k),
        "sparse": lambda: retrieval.sparse_recall(retrieval.distinct_tokens(queries, "query_id", "text"), corpus, "id", "text", k),
        "hybrid": lambda: fusion.ranked(hybrid_pool(queries, corpus, k), k),
    }
    n, found, spent = max(1, queries.count()), {}, {}
    for mode in MODES:
        began = time.perf_counter()
        found[mode] = tables.settle(runs[mode]())
        spent[mode] = round(1000 * (time.perf_counter() - began) / n, 1)
    rows = queries.select("query_id").join(fusion.compare_rankings(found["dense"], found["hybrid"], k), "query_id", "left")
    words = fusion.compare_rankings(found["dense"], found["sparse"], k).select("query_id", F.col("overlap").alias("dense_sparse_overlap"))
    rows = rows.join(words, "query_id", "left").select("query_id", "top1_changed", F.coalesce("overlap", F.lit(0)).alias("overlap"), F.coalesce("dense_sparse_overlap", F.lit(0)).alias("dense_sparse_overlap"))
    rows = rows.select("*", *[F.lit(spent[m]).alias(f"{m}_ms") for m in MODES])
    if path is not None:
        rows.write.mode("overwrite").json(path)
    return rows
