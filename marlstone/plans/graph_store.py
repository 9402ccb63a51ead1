"""The concept graph as a stored view of the notes, kept up by what changes.

``edges`` holds how often each source mentions a concept, by source; ``totals`` what concepts
have in all, by concept.  A run retracts the edges of the sources that have changed, adds
their new ones, and moves the totals of the concepts touched by the difference.  Sources that
haven't changed are neither read nor written, but where the source that named a concept no
longer mentions it: then that concept's edges are looked up for the next name.

The edges are committed first, with the run's differences beside them; the totals note the
runs that they contain.  A run that ends in between is made up for by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import graph
from marlstone.session import Store
from marlstone.sources import tables

EDGES = "source string, concept_id string, n long, display string"
TOTALS = "concept_id string, total_mentions long, n_sources long, first_source string, first_display string"
_DELTA = "concept_id string, n long, sources long, new_source string, new_display string, old_source string"
REMEMBERED = 100  # runs that a version notes; totals are never further behind


def edges(spark: SparkSession, store: Store) -> DataFrame:
    """All mentions by source."""
    return tables.read(spark, store.edges, EDGES)


def concepts(spark: SparkSession, store: Store, keys: DataFrame | None = None) -> DataFrame:
    """``concept_id, concept_name, total_mentions, n_sources`` of all concepts that are mentioned, or of those of ``keys``."""
    rows = tables.read(spark, store.totals, TOTALS) if keys is None else tables.read_keys(spark, store.totals, TOTALS, keys, "concept_id")
    return rows.select("concept_id", F.coalesce("first_display", "concept_id").alias("concept_name"), "total_mentions", "n_sources")


def update(spark: SparkSession, store: Store, notes: DataFrame, gone: DataFrame | None, run: str, chunk: str | None = None) -> DataFrame:
    """Bring the graph up to notes that are new or have changed (``source, links``) and sources that are gone; returns the concepts touched.

    A run that was applied isn't applied again.
    """
    folder = f"{store.deltas}/run={run}"
    done = tables.version(spark, store.edges)["notes"].get("runs", [])
    if run not in done:
        new = tables.settle(graph.mentions(notes, chunk=chunk).select("source", "concept_id", "n", "display"))
        changed = notes.select(F.coalesce("source", F.lit("unknown")).alias("source"))
        changed = tables.settle((changed if gone is None else changed.unionByName(gone.select("source"))).distinct())
        old = tables.read_keys(spark, store.edges, EDGES, changed, "source")
        both = new.withColumn("sign", F.lit(1)).unionByName(old.withColumn("sign", F.lit(-1)))
        first = lambda sign: F.min(F.when(F.col("sign") == sign, F.struct("source", "display")))
        delta = both.groupBy("concept_id").agg(F.sum(F.col("n") * F.col("sign")).alias("n"), F.sum("sign").alias("sources"), first(1).alias("a"), first(-1).alias("b"))
        delta = delta.select("concept_id", "n", "sources", F.col("a.source").alias("new_source"), F.col("a.display").alias("new_display"), F.col("b.source").alias("old_source"))
        delta.write.mode("overwrite").parquet(folder)
        tables.change(spark, store.edges, EDGES, "source", new, changed, notes={"runs": [*done, run][-REMEMBERED:]})
    _catch_up(spark, store)
    return spark.read.schema(_DELTA).parquet(folder).select("concept_id")


def _catch_up(spark: SparkSession, store: Store) -> None:
    """Apply to the totals the runs that the edges have and they lack."""
    had = tables.version(spark, store.totals)["notes"].get("runs", [])
    order = tables.version(spark, store.edges)["notes"].get("runs", [])
    for run in [r for r in order if r not in had]:
        delta = spark.read.schema(_DELTA).parquet(f"{store.deltas}/run={run}")
        held = tables.read_keys(spark, store.totals, TOTALS, delta, "concept_id")
        rows = delta.join(held, "concept_id", "left")
        total, sources = (F.coalesce(a, F.lit(0)) + F.col(b) for a, b in (("total_mentions", "n"), ("n_sources", "sources")))
        # the least source names a concept; old_source is the least that was retracted, new_source the least that was added
        lost = F.coalesce(F.col("old_source") <= F.col("first_source"), F.lit(False)) & ~F.coalesce(F.col("new_source") <= F.col("first_source"), F.lit(False))
        newer = F.col("first_source").isNull() | F.coalesce(F.col("new_source") <= F.col("first_source"), F.lit(False))
        rows = rows.withColumn("total", total).withColumn("count", sources).withColumn("lost", lost & (F.col("count") > 0))
        rows = rows.withColumn("first_source", F.when(newer, F.col("new_source")).otherwise(F.col("first_source"))).withColumn("first_display", F.when(newer, F.col("new_display")).otherwise(F.col("first_display")))
        rows = tables.settle(rows.select("concept_id", F.col("total").alias("total_mentions"), F.col("count").alias("n_sources"), "first_source", "first_display", "lost"))
        unnamed = rows.where("lost").select("concept_id")
        if unnamed.limit(1).count():
            named = edges(spark, store).join(unnamed, "concept_id", "left_semi").groupBy("concept_id").agg(F.min(F.struct("source", "display")).alias("first"))
            rows = rows.join(named, "concept_id", "left").withColumn("first_source", F.coalesce("first.source", "first_source")).withColumn("first_display", F.when(F.col("first").isNotNull(), F.col("first.display")).otherwise(F.col("first_display")))
        tables.change(spark, store.totals, TOTALS, "concept_id", rows.where("n_sources > 0").drop("lost", "first"), rows.where("n_sources <= 0").select("concept_id"), notes={"runs": [*had, run][-REMEMBERED:]})
        had = [*had, run]
