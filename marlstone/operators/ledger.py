"""The ledger of ingested files: diff, routing, upsert and tombstones.

Parquet has no in-place change: every operation returns the new table, which the caller
writes beside the old one and then swaps (see ``sources.tables``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(current: DataFrame, ledger: DataFrame, key: str = "rel_path", sha: str = "sha256", carry: tuple[str, ...] = ()) -> DataFrame:
    """``key, status, old_sha, new_sha``: new, changed, unchanged or deleted, by content hash; ``carry``: more columns of ``current``."""
    now = current.select(F.col(key), F.col(sha).alias("new_sha"), F.lit(True).alias("here"), *carry)
    then = ledger.select(F.col(key), F.col(sha).alias("old_sha"), F.lit(True).alias("known"))
    status = F.when(F.col("known").isNull(), "new").when(F.col("here").isNull(), "deleted").when(F.col("old_sha").eqNullSafe(F.col("new_sha")), "unchanged").otherwise("changed")
    return now.join(then, key, "full_outer").select(key, status.alias("status"), "old_sha", "new_sha", *carry)


def report(differences: DataFrame) -> DataFrame:
    """One row of counters."""
    return differences.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("new", "changed", "unchanged", "deleted")])


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with ``rows`` in place of those of the same key; idempotent."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def remove(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The table without the keys."""
    return table.join(keys.select(key).distinct(), key, "left_anti")


def by_ids(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of the table whose key is among those of ``ids``, each once."""
    return table.join(ids.select(key).distinct(), key, "left_semi")


def tombstones(deleted: DataFrame, ledger: DataFrame, key: str = "rel_path") -> DataFrame:
    """Chunk ids of files that are gone, from the chunk counts of the ledger."""
    gone = ledger.join(deleted.select(key).distinct(), key, "left_semi").where("chunk_count > 0")
    return gone.select(key, F.explode(F.sequence(F.lit(1), F.col("chunk_count").cast("int"))).alias("seq")).select(key, "seq", F.format_string("%s#%03d", F.col(key).cast("string"), "seq").alias("chunk_id"))


def route(files: DataFrame, folder_routes: DataFrame, file_rules: DataFrame, default: str, key: str = "rel_path", folder: str = "top_folder") -> DataFrame:
    """Collection and chunk sizes of every file: its own rule, else its folder's route, else the default.

    Routes and rules come from a configuration file and are few; they are broadcast up to the
    session's threshold.
    """
    rules = file_rules.select(F.col("match").alias(key), F.col("collection").alias("_rule"), "chunk_size", "overlap")
    routes = folder_routes.select(F.col("top_folder").alias(folder), F.col("collection").alias("_route"))
    out = files.join(rules, key, "left").join(routes, folder, "left")
    return out.select(*files.columns, F.coalesce("_rule", "_route", F.lit(default)).alias("collection"), "chunk_size", "overlap")


def unseen(files: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key the store doesn't hold yet."""
    return files.join(known.select(key).distinct(), key, "left_anti")


def insert_if_absent(table: DataFrame, rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows to append, and those refused because their id exists."""
    return rows.join(table.select(key), key, "left_anti"), rows.join(table.select(key), key, "left_semi")


def first_of_content(df: DataFrame, text: str, key: str) -> DataFrame:
    """``content_hash, first_id, copies`` of every distinct text."""
    return df.groupBy(F.substring(F.md5(F.col(text).cast("binary")), 1, 12).alias("content_hash")).agg(F.min(key).alias("first_id"), F.count(F.lit(1)).alias("copies"))


def purge(table: DataFrame, kind: str) -> DataFrame:
    """The table without the rows of one type; rows without a type stay."""
    return table.where(~F.coalesce(F.col("type") == kind, F.lit(False)))
