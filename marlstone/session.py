"""Session settings and the paths of a collection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


def session(name: str = "marlstone", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches be small, by rows and by bytes: one row may hold a very long text, and a batch of them many copies of it in Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


@dataclass(frozen=True)
class Store:
    """Where the tables of a store live; ``chunks``, ``changes`` and ``timeline`` grow by one partition a run."""

    root: str

    @property
    def chunks(self) -> str:
        return f"{self.root}/chunks"

    @property
    def ledger(self) -> str:
        return f"{self.root}/ledger"

    @property
    def concepts(self) -> str:
        return f"{self.root}/concepts"

    @property
    def timeline(self) -> str:
        return f"{self.root}/timeline"

    @property
    def progress(self) -> str:
        return f"{self.root}/progress"

    @property
    def changes(self) -> str:
        return f"{self.root}/changes"

    @property
    def edges(self) -> str:
        return f"{self.root}/edges"

    @property
    def totals(self) -> str:
        return f"{self.root}/totals"

    @property
    def deltas(self) -> str:
        return f"{self.root}/deltas"

    @property
    def fresh(self) -> str:
        return f"{self.root}/fresh"
