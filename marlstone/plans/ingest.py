"""Incremental ingest of a vault: list, compare, read, route, chunk, embed, write, commit; and its copies elsewhere."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone import schemas
from marlstone.functions import chunk
from marlstone.functions import text as tx
from marlstone.operators import ledger
from marlstone.session import Store
from marlstone.sources import files, tables


def chunks_of(notes: DataFrame, as_of: Column, size: int = chunk.SIZE, overlap: int = chunk.OVERLAP) -> DataFrame:
    """Chunk rows of routed notes (``rel_path, text, collection, chunk_size, overlap``); sizes of 0 or null mean the default."""
    use = lambda c, default: F.when(F.coalesce(F.col(c), F.lit(0)) > 0, F.col(c)).otherwise(F.lit(default)).cast("int")
    body = tx.body(F.col("text"))
    rows = notes.withColumn("links", tx.note_links(body)).withColumn("clean", tx.note_text(body)).withColumn("tags", tx.tags(F.col("text")))
    rows = rows.withColumn("title", tx.title(F.col("clean"), F.regexp_extract("rel_path", r"([^/]+?)(?:\.[^./]*)?$", 1)))
    parts = rows.select("*", F.posexplode(chunk.by_headings(F.col("clean"), use("chunk_size", size), use("overlap", overlap))).alias("pos", "part"))
    index = F.col("pos") + 1
    return parts.select(
        F.format_string("%s#%03d", "rel_path", index).alias("chunk_id"), "collection", F.col("part.text").alias("document"), F.col("rel_path").alias("source"), F.lit("note").alias("type"),
        index.alias("chunk_index"), as_of.alias("ts"), "sha256", "title", F.col("part.heading_path").alias("heading_path"), "tags", "links", "top_folder",
    )


def known_files(spark: SparkSession, store: Store) -> DataFrame:
    """The ledger: every file that the store holds, with the run that wrote its chunks."""
    return tables.read(spark, store.ledger, schemas.LEDGER)


def _chunks(spark: SparkSession, store: Store, runs: Sequence[str] | None = None) -> DataFrame:
    """The chunks of all runs, or of some."""
    if runs is None:
        return tables.read_or_empty(spark, store.chunks, schemas.CHUNKS)
    folders = [f"{store.chunks}/run={r}" for r in runs if tables.exists(spark, f"{store.chunks}/run={r}")]
    return spark.read.schema(schemas.CHUNKS).option("basePath", store.chunks).parquet(*folders) if folders else spark.createDataFrame([], schemas.CHUNKS)


def live_chunks(spark: SparkSession, store: Store) -> DataFrame:
    """The chunks that hold: those of the run that the ledger names for their file."""
    known = known_files(spark, store).select(F.col("rel_path").alias("source"), "run")
    return _chunks(spark, store).join(known, ["source", "run"], "left_semi")


def compare(spark: SparkSession, vault: str, store: Store, full: bool = False, by_hash: bool = False) -> DataFrame:
    """``rel_path, status, old_sha, new_sha, text, top_folder, mtime, size``: the vault against the ledger.

    The vault is listed without opening a file.  A file that the ledger knows with the same time
    and size counts as unchanged; the others are read and told by their hash.  ``by_hash`` reads
    and compares all of them, ``full`` forgets the ledger.  A note without text counts as deleted.
    """
    known = known_files(spark, store)
    known = known.limit(0) if full else known
    listed = files.listing(spark, vault)
    same = known.select("rel_path", F.col("mtime").alias("_mtime"), F.col("size").alias("_size"), F.col("sha256"))
    met = listed.join(same, "rel_path", "left")
    trusted = F.lit(False) if full or by_hash else F.coalesce((F.col("mtime") == F.col("_mtime")) & (F.col("size") == F.col("_size")), F.lit(False))
    met = tables.settle(met.withColumn("trusted", trusted))
    read = files.read_listed(spark, vault, met.where("not trusted")).where(tx.stripped(tx.body(F.col("text"))) != "")
    kept = met.where("trusted").select("rel_path", "top_folder", "sha256", "mtime", "size", F.lit(None).cast("string").alias("text"))
    return ledger.diff(kept.unionByName(read), known, carry=("text", "top_folder", "mtime", "size"))


def ingest(
    spark: SparkSession, vault: str, store: Store, routes: DataFrame, rules: DataFrame, default: str, as_of: Column, embedding=None, dry_run: bool = False, full: bool = False,
    by_hash: bool = False, copies: Sequence[Store] = (),
) -> DataFrame:
    """Bring the store up to the vault; returns the ledger diff, with ``incomplete`` for notes of which a chunk has no embedding.

    Only files whose time or size has changed are read (see ``compare``).  The chunks of new and
    changed notes are appended as a partition of this run, and the run counts from the moment
    at which the ledger has a new version; that touches the buckets of what has changed.  Until
    then the old chunks hold, and a run that fails leaves rows that nothing names.

    A note enters the ledger when all its chunks are embedded.  One that isn't complete keeps its
    old state there; what has been embedded of it is remembered, and the next run embeds only the
    rest.  A note without chunks is known with none of them.  Running it again changes nothing.
    ``copies`` are brought up afterwards (see ``bring_up``); one that fails is left for later.
    """
    differences = compare(spark, vault, store, full, by_hash)
    if dry_run:
        return differences.select("rel_path", "status", "old_sha", "new_sha", F.lit(False).alias("incomplete"))
    found = tables.settle(differences)  # what this run does, whatever it changes on the way
    report = found.select("rel_path", "status", "old_sha", "new_sha")
    if not full and found.where("status <> 'unchanged' or text is not null").limit(1).count() == 0:
        _bring_up_all(spark, store, copies)
        return report.withColumn("incomplete", F.lit(False))
    work = found.where(F.col("status").isin("new", "changed"))
    routed = ledger.route(work.withColumnRenamed("new_sha", "sha256"), routes, rules, default)
    run = uuid.uuid4().hex
    fresh = chunks_of(routed, as_of)
    before = tables.read(spark, store.progress, schemas.PROGRESS)
    if embedding is not None:
        fresh = _embedded(spark, store, fresh, before, embedding)
    folder = f"{store.chunks}/run={run}"
    fresh.write.parquet(folder)
    written = spark.read.schema(fresh.schema).parquet(folder)
    lacking = F.count_if(F.col("embedding").isNull()) if embedding is not None else F.lit(0)
    counts = written.groupBy(F.col("source").alias("rel_path")).agg(F.count(F.lit(1)).cast("int").alias("chunk_count"), lacking.alias("lacking"))
    told = routed.select("rel_path", "sha256", "mtime", "size", "collection").join(counts, "rel_path", "left").fillna(0, ["chunk_count", "lacking"])
    told = tables.settle(told.withColumn("ingested_at", as_of).withColumn("run", F.lit(run)))
    # files that were only touched keep their chunks and get their new time
    touched = found.where("status = 'unchanged' and text is not null").select("rel_path", F.col("mtime").alias("_mtime"), F.col("size").alias("_size"))
    touched = known_files(spark, store).join(touched, "rel_path").withColumn("mtime", F.col("_mtime")).withColumn("size", F.col("_size")).drop("_mtime", "_size")
    gone = found.where("status = 'deleted'").select("rel_path")
    if full:  # what the vault has no more; the diff against nothing can't tell
        gone = known_files(spark, store).join(found.select("rel_path"), "rel_path", "left_anti").select("rel_path")
    _record(spark, store, run, told.where("lacking = 0").drop("lacking").unionByName(touched), gone)
    incomplete = told.where("lacking > 0").select("rel_path", "sha256", "run")
    if embedding is not None:
        tables.change(spark, store.progress, schemas.PROGRESS, "rel_path", incomplete, told.select("rel_path").unionByName(gone))
    _bring_up_all(spark, store, copies)
    return report.join(incomplete.select("rel_path", F.lit(True).alias("incomplete")), "rel_path", "left").withColumn("incomplete", F.coalesce("incomplete", F.lit(False)))


def _bring_up_all(spark: SparkSession, store: Store, copies: Sequence[Store]) -> None:
    for copy in copies:
        try:
            bring_up(spark, store, copy)
        except Exception as e:  # the store holds; the next run repairs the copy
            warnings.warn(f"the copy {copy.root} is behind: {e}", stacklevel=3)


def _embedded(spark: SparkSession, store: Store, fresh: DataFrame, before: DataFrame, embedding) -> DataFrame:
    """Chunks with their vectors; those that an earlier run has embedded of the same text aren't embedded again."""
    runs = [r["run"] for r in before.select("run").distinct().collect()]  # of notes that aren't complete yet
    if not runs:
        return fresh.withColumn("embedding", embedding(F.col("document")))
    same = before.select(F.col("rel_path").alias("source"), "sha256", "run").distinct()
    had = _chunks(spark, store, runs).where("embedding is not null").join(same, ["source", "sha256", "run"], "left_semi")
    had = had.groupBy("chunk_id", "sha256", "document").agg(F.first("embedding").alias("embedding"))
    met = tables.settle(fresh.join(had, ["chunk_id", "sha256", "document"], "left").select(*fresh.columns, "embedding"))
    return met.where("embedding is not null").unionByName(met.where("embedding is null").withColumn("embedding", embedding(F.col("document"))))


def _record(spark: SparkSession, store: Store, run: str, rows: DataFrame, gone: DataFrame) -> None:
    """The commit of a run: its changes of the ledger are kept, and the ledger's new version notes the run."""
    changes = rows.withColumn("gone", F.lit(False)).unionByName(gone.withColumn("gone", F.lit(True)), allowMissingColumns=True)
    path = f"{store.changes}/run={run}"
    changes.write.parquet(path)
    kept = spark.read.schema(changes.schema).parquet(path)
    order = [*tables.version(spark, store.ledger)["notes"].get("runs", []), run]
    tables.change(spark, store.ledger, schemas.LEDGER, "rel_path", kept.where("not gone").drop("gone"), kept.where("gone"), notes={"runs": order})


def bring_up(spark: SparkSession, store: Store, copy: Store) -> int:
    """Give a copy the runs that it lacks, in their order; returns how many.

    A run's chunks are copied as they are and its changes applied to the copy's ledger, whose new
    version notes the run.  So a copy that failed in the middle goes on where it stopped, and a
    run that it has isn't applied again.  The first run after a compaction holds the whole store.
    """
    done = tables.version(spark, copy.ledger)["notes"].get("runs", [])
    order = tables.version(spark, store.ledger)["notes"].get("runs", [])
    missing = [r for r in order if r not in done]
    for run in missing:
        _chunks(spark, store, [run]).drop("run").write.mode("overwrite").parquet(f"{copy.chunks}/run={run}")
        changes = spark.read.schema(schemas.LEDGER + ", gone boolean").parquet(f"{store.changes}/run={run}")
        changes.write.mode("overwrite").parquet(f"{copy.changes}/run={run}")
        rows, whole = changes.where("not gone").drop("gone"), run == order[0]
        notes = {"runs": order[: order.index(run) + 1]}
        if whole:
            tables.replace(rows, copy.ledger, notes)
        else:
            tables.change(spark, copy.ledger, schemas.LEDGER, "rel_path", rows, changes.where("gone"), notes=notes)
    return len(missing)


def compact(spark: SparkSession, store: Store) -> None:
    """Write the chunks that hold as one run, name it in the ledger, then remove the runs before that nothing needs."""
    known = known_files(spark, store)
    before = [n.removeprefix("run=") for n in tables.children(spark, store.chunks) if n.startswith("run=")]
    if not before:
        return
    started = {r["run"] for r in tables.read(spark, store.progress, schemas.PROGRESS).select("run").distinct().collect()}
    run = uuid.uuid4().hex
    live_chunks(spark, store).drop("run").write.parquet(f"{store.chunks}/run={run}")
    known = known.withColumn("run", F.lit(run))
    known.withColumn("gone", F.lit(False)).write.parquet(f"{store.changes}/run={run}")
    tables.replace(known, store.ledger, {"runs": [run]})
    for old in before:
        if old not in started:
            tables.drop(spark, f"{store.chunks}/run={old}")
        tables.drop(spark, f"{store.changes}/run={old}")
