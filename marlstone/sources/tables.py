"""Tables that change: rows in hash buckets, and versions named by files that are written once.

A table is a folder.  ``data/`` holds folders that nothing touches once they are written, one
for each run and bucket; ``versions/`` holds a file for each version that names the folders
it consists of.  A version file is written aside and takes its number by a rename that fails
where the number is taken.  So a reader sees one whole version whatever a writer does, and
never moves anything; of two writers that started from the same version one has to start
over; a run that ends early leaves folders that no version names.

A change rewrites the buckets of its keys and nothing else.  Bucket maps and listings of
versions are the only things that come to the driver; their size is that of ``buckets``.
"""

from __future__ import annotations

import json
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, KEEP, TRIES = 64, 4, 5
_WHOLE = "whole"  # the only part of a version that was written as a whole


class Conflict(RuntimeError):
    """Another writer has taken the version's number."""


def files(spark: SparkSession, path: str):
    """The file system of a path, and a maker of paths."""
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path_of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path_of


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder."""
    fs, path_of = files(spark, path)
    return fs.exists(path_of(path))


def drop(spark: SparkSession, path: str) -> None:
    """Remove a file, or a folder with all in it."""
    fs, path_of = files(spark, path)
    fs.delete(path_of(path), True)


def children(spark: SparkSession, path: str) -> list[str]:
    """The names of what a folder holds, in order; none if there is no folder."""
    fs, path_of = files(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(path_of(path))) if fs.exists(path_of(path)) else []


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A plain Parquet folder with a declared schema, or no rows where there is none."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


# ----- versions


def _numbers(spark: SparkSession, path: str) -> list[int]:
    return [int(n[:-5]) for n in children(spark, f"{path}/versions") if n.endswith(".json") and n[:-5].isdigit()]


def _load(spark: SparkSession, path: str, number: int) -> dict:
    fs, path_of = files(spark, path)
    stream = fs.open(path_of(f"{path}/versions/{number:010d}.json"))
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def version(spark: SparkSession, path: str) -> dict:
    """The current version: ``number`` (0: none yet), ``parts`` (bucket to run), ``buckets``, and what its writer has noted."""
    numbers = _numbers(spark, path)
    return _load(spark, path, numbers[-1]) if numbers else {"number": 0, "parts": {}, "buckets": 0, "notes": {}}


def _commit(spark: SparkSession, path: str, before: dict, parts: dict[str, str], buckets: int, notes: dict) -> dict:
    """Make a new version after ``before``; raises ``Conflict`` if there is one already."""
    now = {"number": before["number"] + 1, "parts": parts, "buckets": buckets, "notes": before["notes"] | notes}
    fs, path_of = files(spark, path)
    jvm, context = spark.sparkContext._jvm, spark.sparkContext
    aside, name = path_of(f"{path}/versions/.{uuid.uuid4().hex}"), path_of(f"{path}/versions/{now['number']:010d}.json")
    out = fs.create(aside, False)
    out.write(json.dumps(now).encode())
    out.close()
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(name.toUri(), context._jsc.hadoopConfiguration()).rename(aside, name, context._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as e:
        fs.delete(aside, False)
        if fs.exists(name):
            raise Conflict(f"{path}: version {now['number']} is taken") from e
        raise
    return now


def _folders(path: str, current: dict, buckets=None) -> list[str]:
    where = lambda part, run: f"{path}/data/{run}" if part == _WHOLE else f"{path}/data/{run}/bucket={part}"
    return [where(part, run) for part, run in current["parts"].items() if buckets is None or part == _WHOLE or int(part) in buckets]


def _rows(spark: SparkSession, path: str, schema, current: dict, buckets=None) -> DataFrame:
    folders = _folders(path, current, buckets)
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the current version, or none where there is no table yet."""
    return _rows(spark, path, schema, version(spark, path))


def bucket_of(key: str, buckets: int):
    """The bucket of a key; null keys have one as well."""
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def read_keys(spark: SparkSession, path: str, schema: str, keys: DataFrame, key: str) -> DataFrame:
    """The rows of the current version with the keys of ``keys``, read from those keys' buckets alone."""
    current = version(spark, path)
    if not current["buckets"]:
        return _rows(spark, path, schema, current).join(keys.select(key).distinct(), key, "left_semi")
    wanted = {r[0] for r in keys.select(bucket_of(key, current["buckets"])).distinct().collect()}  # no more than there are buckets
    return _rows(spark, path, schema, current, wanted).join(keys.select(key).distinct(), key, "left_semi")


def replace(df: DataFrame, path: str, notes: dict | None = None) -> dict:
    """A new version with the rows of ``df``, which may still read the one before."""
    spark = df.sparkSession
    before, run = version(spark, path), uuid.uuid4().hex
    df.write.parquet(f"{path}/data/{run}")
    now = _commit(spark, path, before, {_WHOLE: run}, 0, notes or {})
    vacuum(spark, path)
    return now


def change(spark: SparkSession, path: str, schema: str, key: str, rows: DataFrame | None = None, gone: DataFrame | None = None, buckets: int = BUCKETS, notes: dict | None = None) -> dict:
    """A new version without the keys of ``rows`` and ``gone``, and with ``rows``; returns it.

    Only the buckets of these keys are read and written again.  The rows are computed once and
    kept until the version is there, however often it has to be tried.  A table that was written
    as a whole is dealt into buckets by its first change.  Null keys are equal to each other.
    Doing the same again changes nothing but the number.
    """
    run = uuid.uuid4().hex
    staged = f"{path}/staged/{run}"
    count = version(spark, path)["buckets"] or buckets
    columns = spark.createDataFrame([], schema).schema
    empty = spark.createDataFrame([], columns)
    rows = empty if rows is None else empty.unionByName(rows.select([c for c in rows.columns if c in columns.names]), allowMissingColumns=True)
    keys = rows.select(key) if gone is None else rows.select(key).unionByName(gone.select(F.col(key).cast(columns[key].dataType).alias(key)))
    rows.withColumn("bucket", bucket_of(key, count)).write.partitionBy("bucket").parquet(f"{staged}/rows")
    keys.distinct().withColumn("bucket", bucket_of(key, count)).write.partitionBy("bucket").parquet(f"{staged}/keys")
    try:
        for attempt in range(TRIES):
            try:
                now = _apply(spark, path, columns, key, staged, f"{run}-{attempt}", count, notes or {})
                break
            except Conflict:
                if attempt == TRIES - 1:
                    raise
    finally:
        drop(spark, staged)
    vacuum(spark, path)
    return now


def _apply(spark: SparkSession, path: str, columns, key: str, staged: str, run: str, buckets: int, notes: dict) -> dict:
    before = version(spark, path)
    if before["buckets"] not in (0, buckets):
        raise Conflict(f"{path}: another writer has chosen {before['buckets']} buckets")
    touched = {int(n.removeprefix("bucket=")) for n in children(spark, f"{staged}/keys") if n.startswith("bucket=")}
    whole = _WHOLE in before["parts"]
    here = lambda name, kind: spark.read.schema(kind).option("basePath", f"{staged}/{name}").parquet(f"{staged}/{name}")
    rows = here("rows", columns).select(columns.names)
    keys = here("keys", columns).select(F.col(key).alias("_key"))
    held = _rows(spark, path, columns, before, None if whole else touched)
    after = held.join(keys, F.col(key).eqNullSafe(F.col("_key")), "left_anti").unionByName(rows).withColumn("bucket", bucket_of(key, buckets))
    after.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{path}/data/{run}")
    written = {n.removeprefix("bucket=") for n in children(spark, f"{path}/data/{run}") if n.startswith("bucket=")}
    parts = {} if whole else {b: r for b, r in before["parts"].items() if int(b) not in touched}
    return _commit(spark, path, before, parts | dict.fromkeys(sorted(written, key=int), run), buckets, notes)


def publish(spark: SparkSession, path: str, before: dict, notes: dict) -> dict:
    """A new version of something that names its own folders in its notes, such as an index."""
    return _commit(spark, path, before, before["parts"], before["buckets"], notes)


def vacuum(spark: SparkSession, path: str, keep: int = KEEP, orphans_after: float | None = None) -> None:
    """Forget all but the last ``keep`` versions and remove the folders that only those forgotten name.

    Readers that are slower than so many changes lose what they read.  ``orphans_after``: also
    remove folders that no version names and that are older than so many seconds.
    """
    numbers = _numbers(spark, path)
    named = lambda some: {f for n in some for f in _folders(path, _load(spark, path, n))}
    if len(numbers) > keep:
        held = named(numbers[-keep:])
        for folder in named(numbers[:-keep]) - held:
            drop(spark, folder)
        for n in numbers[:-keep]:
            drop(spark, f"{path}/versions/{n:010d}.json")
    if orphans_after is not None:
        held = {f.split("/data/")[1].split("/")[0] for f in named(numbers[-keep:])}
        fs, path_of = files(spark, path)
        for status in fs.listStatus(path_of(f"{path}/data")) if fs.exists(path_of(f"{path}/data")) else []:
            if status.getPath().getName() not in held and status.getModificationTime() / 1000 < time.time() - orphans_after:
                fs.delete(status.getPath(), True)


# ----- tables computed once


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; where none is named and the master is local (tests), a temporary one is set."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        known = context._jsc.sc().getCheckpointDir()
        folder = known.get() if known.isDefined() else None
    if not folder:
        if not context.master.startswith("local["):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="marlstone-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def passing_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share and that goes when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    fs, path_of = files(spark, path)
    fs.deleteOnExit(path_of(path))
    return path


def settle(df: DataFrame) -> DataFrame:
    """Compute a table once, in a passing folder, for plans that read it several times."""
    path = passing_folder(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
