"""A file stream into the chunk table (an extension; changes and deletions stay with the ledger)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import chunk


def stream_texts(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """New text files of a folder as they arrive, one row per file."""
    return spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", per_trigger).load(folder).select(F.input_file_name().alias("source"), F.col("value").alias("text"))


def append_chunks(texts: DataFrame, target: str, checkpoint: str):
    """Write the windows of every new text; a batch owns its folder, so a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = chunk.explode_chunks(batch, chunk.fixed(F.col("text")), ["source"])
        rows = rows.withColumn("chunk_id", F.substring(F.sha2(F.concat_ws("#", "source", F.col("chunk_index").cast("string")), 256), 1, 24))
        rows.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
