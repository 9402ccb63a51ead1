"""A stream of notes into chunks, with the state of every note kept by its path.

Two kinds of events meet at a note's path: the note as it is now, and how far its chunks have
been embedded.  The state is its hash, its number of chunks, and the next one to embed.  A note
comes out as new, changed, resumed (its hash is known, but some chunks still lack a vector) or
unchanged, with the first chunk that is still to be done.  A batch writes its chunks and what it
has reached in folders of its own number, so that a repeated batch replaces itself; the latter
folder is the stream's second source.  So after a failure in the middle of a note, of the
embedder or of the whole job, the note's next event embeds only the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marlstone.functions import chunk

NOTE = "rel_path string, text string"
REACHED = "rel_path string, sha256 string, reached int"
_EVENT = ("rel_path", "sha256", "text", "chunk_count", "reached")
_STATE = "sha256 string, chunk_count int, next int"
_OUT = "rel_path string, status string, sha256 string, text string, chunk_count int, first int"


def _pieces(text):
    return chunk.by_headings(text, F.lit(chunk.SIZE), F.lit(chunk.OVERLAP))


def note_events(notes: DataFrame) -> DataFrame:
    """Notes (``rel_path, text``) as events, with their hash and number of chunks."""
    text = F.coalesce("text", F.lit(""))
    rows = notes.select("rel_path", F.sha2(text, 256).alias("sha256"), text.alias("text"))
    return rows.select("rel_path", "sha256", "text", F.size(_pieces(F.col("text"))).alias("chunk_count"), F.lit(None).cast("int").alias("reached"))


def reached_events(rows: DataFrame) -> DataFrame:
    """Progress (``rel_path, sha256, reached``) as events."""
    return rows.select("rel_path", "sha256", F.lit(None).cast("string").alias("text"), F.lit(None).cast("int").alias("chunk_count"), "reached")


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    sha, count, following = state.get if state.exists else (None, 0, 1)
    notes = []
    for batch in batches:
        for event in batch.itertuples():
            if pd.notna(event.reached):
                if event.sha256 == sha:
                    following = max(following, int(event.reached) + 1)
            else:
                notes.append(event)
    out = []
    for event in sorted(notes, key=lambda e: e.sha256):  # of several in one batch any may be the last; take one order
        if event.sha256 != sha:
            status, sha, count, following = "new" if sha is None else "changed", event.sha256, int(event.chunk_count), 1
        else:
            status = "unchanged" if following > count else "resumed"
        out.append((key[0], status, sha, event.text if following <= count else None, count, following))
    if sha is not None:
        state.update((sha, count, following))
    yield pd.DataFrame(out, columns=["rel_path", "status", "sha256", "text", "chunk_count", "first"])


def track(events: DataFrame) -> DataFrame:
    """``rel_path, status, sha256, text, chunk_count, first`` for every note event."""
    return events.select(*_EVENT).groupBy("rel_path").applyInPandasWithState(_step, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def pending(tracked: DataFrame) -> DataFrame:
    """The chunks that are still to be embedded."""
    rows = tracked.where("text is not null").select("rel_path", "sha256", "first", F.posexplode(_pieces(F.col("text"))).alias("pos", "part"))
    rows = rows.withColumn("seq", F.col("pos") + 1).where("seq >= first")
    return rows.select(F.format_string("%s#%03d", "rel_path", "seq").alias("chunk_id"), "rel_path", "sha256", "seq", "first", F.col("part.text").alias("document"))


def reached(written: DataFrame) -> DataFrame:
    """How far each note of a batch has come: up to the chunk before the first without a vector."""
    lacking = F.min(F.when(F.col("embedding").isNull(), F.col("seq")))
    rows = written.groupBy("rel_path", "sha256").agg(F.coalesce(lacking, F.max("seq") + 1).alias("stop"))
    return rows.select("rel_path", "sha256", (F.col("stop") - 1).cast("int").alias("reached"))


def start(notes: DataFrame, root: str, embedding):
    """Start the stream of ``notes`` (streaming; ``rel_path, text``) into ``root``: ``chunks``, ``progress``, ``statuses``.

    ``embedding`` makes a column of vectors of a text column, null where it fails.
    """
    spark: SparkSession = notes.sparkSession
    for folder in ("progress",):  # a source has to exist before it is read
        spark.createDataFrame([], REACHED).write.mode("append").parquet(f"{root}/{folder}/batch=none")
    progress = spark.readStream.schema(REACHED).parquet(f"{root}/progress/*")
    tracked = track(note_events(notes).unionByName(reached_events(progress)))

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        try:
            rows.drop("text").write.mode("overwrite").parquet(f"{root}/statuses/batch={number}")
            path = f"{root}/chunks/batch={number}"
            pending(rows).withColumn("embedding", embedding(F.col("document"))).write.mode("overwrite").parquet(path)
            reached(batch.sparkSession.read.parquet(path)).write.mode("overwrite").parquet(f"{root}/progress/batch={number}")
        finally:
            rows.unpersist()

    return tracked.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()


def live(spark: SparkSession, root: str) -> DataFrame:
    """The embedded chunks of every note's last text."""
    of = "chunk_id string, rel_path string, sha256 string, seq int, first int, document string, embedding array<float>, batch int"
    rows = spark.read.schema(of).parquet(f"{root}/chunks").where("embedding is not null")
    told = spark.read.schema("rel_path string, status string, sha256 string, chunk_count int, first int, batch int").parquet(f"{root}/statuses")
    last = told.groupBy("rel_path").agg(F.max_by("sha256", F.struct("batch", "sha256")).alias("sha256"))
    return rows.join(last, ["rel_path", "sha256"], "left_semi").dropDuplicates(["chunk_id", "sha256"]).drop("first", "batch")
