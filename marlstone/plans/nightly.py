"""The nightly run of the concept store: scan, reconcile, enrich, write, report; and its cleanup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone import schemas
from marlstone.functions import text as tx
from marlstone.operators import ferment, graph, retrieval
from marlstone.plans import graph_store
from marlstone.session import Store
from marlstone.sources import tables

_TRUTH = ("summary", "confidence", "key_facts", "contradictions", "open_questions")


def concepts(spark: SparkSession, store: Store) -> DataFrame:
    """The stored concept pages."""
    return tables.read(spark, store.concepts, schemas.CONCEPTS)


def timeline(spark: SparkSession, store: Store) -> DataFrame:
    """All entries of all concepts' timelines."""
    return tables.read_or_empty(spark, store.timeline, schemas.TIMELINE)


def _enriched(due: DataFrame, corpus: DataFrame, encode) -> DataFrame:
    """Compiled knowledge of the pages of level 1 and 2 from their nearest chunks, with what is said about it."""
    # numbers of their own for the search: pages and chunks are known by their ids
    pages = tables.settle(due.select("concept_id", F.col("concept_name").alias("name"), "enrichment_level").withColumn("concept", F.monotonically_increasing_id()))
    chunks = tables.settle(corpus.select("chunk_id", "source", F.col("document").alias("text"), F.col("embedding").alias("vector")).withColumn("id", F.monotonically_increasing_id()))
    top = retrieval.dense_topk(pages.select(F.col("concept").alias("query_id"), encode(F.col("name")).alias("vector")), chunks.select("id", "vector"), 10).withColumnRenamed("query_id", "concept")
    rows = tables.settle(top.join(pages, "concept").join(chunks.drop("vector"), "id"))
    basic = ferment.evidence(rows.where("enrichment_level = 1 and rank <= 5"), False)
    full = ferment.evidence(rows.where("enrichment_level = 2"), True)
    said = lambda told, sentence: told.withColumn("event", F.format_string(sentence, F.size("key_facts"), F.size("contradictions")))
    both = said(ferment.truth(basic, False), "enriched to level 1: %d facts").unionByName(said(ferment.truth(full, True), "enriched to level 2: %d facts, %d contradictions"))
    counts = basic.unionByName(full).groupBy("concept").agg(F.count(F.lit(1)).alias("evidence_count"))
    return both.join(pages.select("concept", "concept_id"), "concept").join(counts, "concept").drop("concept")


def run(spark: SparkSession, notes: DataFrame, corpus: DataFrame, store: Store, as_of: Column, name: str, encode=None, chunk: str | None = None) -> DataFrame:
    """One night: the store brought up to all that ``notes`` mention, and a report of one row.

    ``notes`` has ``source, links``; ``corpus`` is ``live_chunks``; ``encode`` makes vectors of
    names, as the corpus has them (none: nothing is enriched).  ``name`` is the run's: a run that
    has ended changes nothing when repeated, one that failed is done again in its place, as its
    timeline entries are a partition of their own and the concepts are committed last.
    """
    before = concepts(spark, store)
    if tables.version(spark, store.concepts)["notes"].get("night") == name:
        return ferment.level_distribution(before)
    edges = tables.settle(graph.mentions(notes, chunk=chunk))
    return _night(spark, store, before, graph.concepts(edges), edges, corpus, as_of, name, encode)


def run_changes(
    spark: SparkSession, notes: DataFrame, gone: DataFrame | None, corpus: DataFrame, store: Store, as_of: Column, name: str, encode=None, chunk: str | None = None
) -> DataFrame:
    """One night of what has changed: ``notes`` are the new and changed ones, ``gone`` (``source``) those that are no more.

    The stored graph moves by their difference, and only the pages of concepts that they touch, and
    those created the night before, are reconciled, enriched and written; a page that nothing
    touched keeps its time and its state of review.  Mentions and levels are those of a whole night.
    """
    if tables.version(spark, store.concepts)["notes"].get("night") == name:
        return ferment.level_distribution(concepts(spark, store))
    touched = graph_store.update(spark, store, notes, gone, name, chunk)
    fresh = tables.read(spark, store.fresh, "concept_id string, night string").where(F.col("night") != name).select("concept_id")
    touched = tables.settle(touched.unionByName(fresh).distinct())
    now = graph_store.concepts(spark, store, touched)
    before = tables.read_keys(spark, store.concepts, schemas.CONCEPTS, touched, "concept_id")
    return _night(spark, store, before, now, graph_store.edges(spark, store), corpus, as_of, name, encode)


def _night(spark: SparkSession, store: Store, before: DataFrame, mentioned: DataFrame, edges: DataFrame, corpus: DataFrame, as_of: Column, name: str, encode) -> DataFrame:
    """Reconcile pages with what is mentioned, enrich, and commit the pages that are no longer as they were."""
    log = timeline(spark, store).where(F.col("run") != name)
    pages = tables.settle(ferment.reconcile(before, mentioned, as_of))
    due = pages.where("needs_review and enrichment_level > 0")
    nothing = spark.createDataFrame([], "concept_id string, summary string, confidence double, key_facts array<string>, contradictions array<string>, open_questions array<string>, event string, evidence_count long")
    told = tables.settle(_enriched(due, corpus, encode)) if encode is not None else nothing
    related = graph.related(edges, of=due.where("enrichment_level = 2").select("concept_id"))
    related = related.groupBy("concept_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "related_id"))), lambda x: x["related_id"]).alias("new_related"))  # five at most
    held = before.select("concept_id", "first_seen", "related", *[F.col(c).alias(f"old_{c}") for c in _TRUTH])
    rows = pages.join(held, "concept_id", "left").join(told.select("concept_id", *_TRUTH, F.lit(True).alias("told")), "concept_id", "left").join(related, "concept_id", "left")
    done = F.col("told").isNotNull()
    now = rows.where("action <> 'kept'").select(
        "concept_id", "concept_name", F.col("mention_count").cast("long").alias("mention_count"), F.col("enrichment_level").cast("int").alias("enrichment_level"),
        F.coalesce("first_seen", as_of).alias("first_seen"), "last_seen", (F.col("needs_review") & ~done).alias("needs_review"),
        *[F.when(done, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in _TRUTH], F.coalesce("new_related", "related").alias("related"), F.lit(name).alias("run"),
    )
    events = pages.where("event is not null").select("concept_id", F.lit(0).alias("pos"), "event", F.lit(0).cast("long").alias("evidence_count"))
    events = events.unionByName(told.select("concept_id", F.lit(1).alias("pos"), "event", "evidence_count"))
    entries = ferment.appended(log, events).withColumn("ts", as_of).withColumn("source_hash", tx.short_hash(F.concat_ws(":", "concept_id", "event"), 8))
    entries.select("concept_id", "seq", "ts", "event", "source_hash", "evidence_count").write.mode("overwrite").parquet(f"{store.timeline}/run={name}")
    tables.replace(pages.where("action = 'created'").select("concept_id", F.lit(name).alias("night")), store.fresh)
    tables.change(spark, store.concepts, schemas.CONCEPTS, "concept_id", now, notes={"night": name})
    enriched = told.agg(F.count(F.lit(1)).alias("enriched"))
    return ferment.report(pages).crossJoin(enriched)  # one row each


def put_pages(spark: SparkSession, store: Store, pages: DataFrame) -> None:
    """Put pages in the store, in place of those of the same id."""
    tables.change(spark, store.concepts, schemas.CONCEPTS, "concept_id", pages)


def drop_pages(spark: SparkSession, store: Store, ids: DataFrame) -> None:
    """Remove the pages of some ids (``concept_id``)."""
    tables.change(spark, store.concepts, schemas.CONCEPTS, "concept_id", gone=ids)


def report_text(report: DataFrame, as_of: Column) -> DataFrame:
    """``report``: what a night did, in words, from its row of counters."""
    lines = [("pages", "concept pages"), ("stubs_created", "new stubs"), ("upgrades_basic", "upgrades to basic"), ("upgrades_full", "upgrades to full"), ("enriched", "pages enriched"), ("timeline_entries", "timeline entries")]
    told = [F.concat(F.lit(f"- {words}: "), F.col(c).cast("string")) for c, words in lines]
    return report.select(F.concat_ws("\n", F.concat(F.lit("# Nightly report "), F.date_format(as_of, "yyyy-MM-dd")), *told).alias("report"))


def clean_up(spark: SparkSession, store: Store, as_of: Column, days: int = 30) -> DataFrame:
    """Remove stubs that were last seen more than so many days ago; returns them.  Their timelines stay."""
    pages = concepts(spark, store)
    gone = tables.settle(ferment.stale_stubs(pages, as_of, days).select("concept_id", "age_days"))
    drop_pages(spark, store, gone)
    return gone
