"""Notes and documents from folders: scan, exclusion, hash and text, all on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone import schemas
from marlstone.sources import tables

# fixed values: folders that hold no notes, and marks of conflicting copies
HIDDEN = (".obsidian", ".trash", ".git", ".smart-env")
SYSTEM_FOLDER = "_system"
CONFLICT = "(?i)冲突|conflict"
VAULT_FOLDERS = (".obsidian", ".git", ".trash", "_system", ".oak")
HUB_FOLDERS = (".git", ".obsidian", "__pycache__", "backups", ".venv", "site-packages", ".pytest_cache", ".gradio", ".streamlit")
LEAST_BYTES = 50


def excluded(rel_path: Column) -> Column:
    """Paths in hidden folders, below the system folder, or of conflicting copies."""
    parts = F.split(rel_path, "/")
    hidden = F.arrays_overlap(parts, F.array(*map(F.lit, HIDDEN)))
    system = (F.size(parts) > 1) & (parts[0] == SYSTEM_FOLDER)
    return hidden | system | F.element_at(parts, -1).rlike(CONFLICT)


def below(rel_path: Column, folders: tuple[str, ...]) -> Column:
    """Paths with one of the folders above their file."""
    parts = F.split(rel_path, "/")
    return F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*map(F.lit, folders)))


def _located(files: DataFrame, root: str) -> DataFrame:
    """Add ``location`` (the plain path), ``rel_path``, ``top_folder``, ``name``, ``mtime`` and ``size`` to files as Spark lists them."""
    base = root.rstrip("/") + "/"
    plain = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
    rel = F.regexp_replace(F.regexp_replace(plain, "^[a-z]+:/+", "/"), "^" + _quoted(base), "")
    folder = F.when(F.instr("rel_path", "/") > 0, F.split_part("rel_path", F.lit("/"), F.lit(1))).otherwise(F.lit("(root)"))
    rows = files.withColumn("location", plain).withColumn("rel_path", rel).withColumn("top_folder", folder).withColumn("name", F.regexp_extract("rel_path", "([^/]+)$", 1))
    return rows.withColumn("mtime", F.unix_micros("modificationTime") / 1e6).withColumn("size", F.col("length"))


def scan(spark: SparkSession, root: str, glob: str = "*.md", recursive: bool = True) -> DataFrame:
    """``rel_path, top_folder, name, sha256, mtime, size, content`` of files below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(root)
    return _located(files, root).select("rel_path", "top_folder", "name", F.sha2("content", 256).alias("sha256"), "mtime", "size", "content")


def listing(spark: SparkSession, root: str, glob: str = "*.md") -> DataFrame:
    """``location, rel_path, top_folder, mtime, size`` of the notes of a vault; no file is opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    return _located(files, root).select("location", "rel_path", "top_folder", "mtime", "size").where(~excluded(F.col("rel_path")))


NAMED_FILES = 10_000  # so many are opened by name; for more the whole folder is read


def read_listed(spark: SparkSession, root: str, listed: DataFrame) -> DataFrame:
    """The notes of some rows of a ``listing`` with hash and text; their files are opened and, up to ``NAMED_FILES``, no others."""
    few = listed.select("location").limit(NAMED_FILES + 1).collect()
    if len(few) > NAMED_FILES:
        return scan_notes(spark, root).join(listed.select("rel_path"), "rel_path", "left_semi")
    if not few:
        return spark.createDataFrame([], schemas.NOTES)
    files = spark.read.format("binaryFile").option("__globPaths__", "false").load([r["location"] for r in few])
    return _located(files, root).select("rel_path", "top_folder", F.sha2("content", 256).alias("sha256"), "mtime", "size", _text())


def _text() -> Column:
    """What a file says; bytes that aren't UTF-8 become the replacement character."""
    return F.make_valid_utf8(F.col("content").cast("string")).alias("text")


def _quoted(path: str) -> str:
    import re

    return re.escape(re.sub(r"^[a-z]+:/+", "/", path))


def scan_notes(spark: SparkSession, root: str) -> DataFrame:
    """Notes of a vault with their text; bytes that aren't UTF-8 become the replacement character."""
    rows = scan(spark, root).where(~excluded(F.col("rel_path")))
    return rows.select("rel_path", "top_folder", "sha256", "mtime", "size", _text())


def scan_folder(spark: SparkSession, root: str, extensions: tuple[str, ...], least_size: int = 0, recursive: bool = True) -> DataFrame:
    """Files of the given extensions in any case, of at least so many bytes, with ``extension``."""
    rows = scan(spark, root, "*", recursive).withColumn("extension", F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)))
    return rows.where(F.col("extension").isin(*extensions) & (F.col("size") >= least_size))


def scan_hub(spark: SparkSession, root: str) -> DataFrame:
    """Markdown files of a working folder, of at least ``LEAST_BYTES``, outside the folders of tools.

    As in every listing by Spark, names that begin with ``_`` or ``.`` are left out.
    """
    rows = scan_folder(spark, root, ("md",), LEAST_BYTES)
    return rows.where(~below(F.col("rel_path"), HUB_FOLDERS))


def scan_vault(spark: SparkSession, root: str) -> DataFrame:
    """All Markdown files of a vault, of at least ``LEAST_BYTES``, outside its system folders and without conflicting copies."""
    rows = scan_folder(spark, root, ("md",), LEAST_BYTES)
    return rows.where(~below(F.col("rel_path"), VAULT_FOLDERS) & ~F.col("name").rlike(CONFLICT))


def merged(*scans: DataFrame) -> DataFrame:
    """Several scans as one list of files, each path once."""
    out = scans[0]
    for more in scans[1:]:
        out = out.unionByName(more)
    return out.dropDuplicates(["rel_path"])


def scan_typed(spark: SparkSession, folders: dict[str, tuple[str, tuple[str, ...]]]) -> DataFrame:
    """Files of several folders with their ``type``: ``{type: (folder, extensions)}``; a folder that doesn't exist is left out."""
    found = None
    for kind, (folder, extensions) in folders.items():
        if tables.exists(spark, folder):
            rows = scan_folder(spark, folder, extensions, recursive=False).withColumn("type", F.lit(kind))
            found = rows if found is None else found.unionByName(rows)
    return found if found is not None else spark.createDataFrame([], "rel_path string, top_folder string, name string, sha256 string, mtime double, size long, content binary, extension string, type string")


LEAST_BODY = 20


def scan_migration(spark: SparkSession, root: str) -> DataFrame:
    """Notes to migrate: ``rel_path, sha256, meta, body, wikilinks`` of those with more than ``LEAST_BODY`` characters besides front matter and blanks.

    ``wikilinks`` are the raw insides of all double brackets, in order, repeats included.
    """
    from marlstone.functions import text as tx

    rows = scan_notes(spark, root)
    body = F.regexp_replace(tx.body(F.col("text")), r"(?U)^\s+|\s+$", "")
    inside = F.regexp_extract_all("text", F.lit(r"\[\[([^\]]++)\]\]"), F.lit(1))
    return rows.select("rel_path", "sha256", tx.front_matter(F.col("text")).alias("meta"), body.alias("body"), inside.alias("wikilinks")).where(F.length("body") > LEAST_BODY)


def scan_inbox(spark: SparkSession, root: str, least: int = 20) -> DataFrame:
    """Markdown and text files whose body, without front matter, has at least so many characters."""
    from marlstone.functions import text as tx

    rows = scan_folder(spark, root, ("md", "txt"), recursive=False)
    raw = F.make_valid_utf8(F.col("content").cast("string"))
    rows = rows.withColumn("raw", F.regexp_replace(raw, "^﻿", ""))
    rows = rows.withColumn("meta", tx.front_matter(F.col("raw"))).withColumn("body", F.regexp_replace(tx.body(F.col("raw")), r"(?U)^\s+|\s+$", ""))
    return rows.where(F.length("body") >= least).select("rel_path", "sha256", "size", "meta", tx.tags(F.col("raw")).alias("tags"), "body")
