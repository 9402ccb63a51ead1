"""Intermediate tables in the folder that all executors share.

Operators with several phases write each phase as Parquet under ``spark.checkpoint.dir`` and
read it back.  That cuts the lineage, survives the loss of executors, and lets the shuffle
files of a finished phase go.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from marlstone.session import bounded_batches

_CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is named and the master is local (tests), a temporary one is set."""
    folder = spark.conf.get(_CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(_CHECKPOINT_DIR)
    if not folder:
        folder = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = folder.get() if folder.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="marlstone-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def prepare(spark: SparkSession) -> None:
    """Session settings that the operators rely on for bounded memory and disk.

    Arrow batches are kept small, by rows and by bytes, because one row may hold a very long text,
    and shuffle files are removed as soon as the execution that wrote them has ended.
    """
    bounded_batches(spark)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


class Scratch:
    """The intermediate tables of one run of an operator; they go when the application ends."""

    def __init__(self, spark: SparkSession, name: str):
        prepare(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table and return what was written."""
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)
