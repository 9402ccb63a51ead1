"""A corpus pipeline of five stages, each applying one operator to all that the one before kept.

``STAGES`` lists them in order; each function takes (spark, docs, sf_dir) and returns a
DataFrame.  The last stage returns the encoded documents, all others the columns of ``docs``.
Between stages the rows are written as Parquet and read again.

Edge cases follow the operators: null texts aren't toxic unless the model says so, have no
determined language and so go at the second stage; repeated rows are near duplicates of each
other.  Decisions name rows, not ids, so rows without an id or with different texts under one
id are documents like all others.  Columns beyond those of ``documents`` pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm import bpe, language_id, mixing, ngram_jaccard, toxicity
from marlstone.llm.registry import vocabulary
from marlstone.llm.storage import Scratch, prepare


def _keyed(docs: DataFrame) -> DataFrame:
    """``_key, _row``: the whole row, and a key that is never null and the same only for equal rows."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    parts = [F.to_json(F.struct(f.name)) if isinstance(f.dataType, nested) else F.col(f.name) for f in docs.schema]
    digest = F.hex(F.xxhash64(*parts, *[p.isNull() for p in parts]))  # the hash passes over nulls
    return docs.select(F.concat_ws("|", digest, F.col("doc_id").cast("string")).alias("_key"), F.struct(*docs.columns).alias("_row"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the toxicity model, learned from all labels, doesn't predict to be toxic.

    Labels of one class, or too few to learn from, tell nothing about a text: all documents stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.train(docs, labels, Scratch(spark, "pipeline-toxicity"))
    if model.trees is None:
        return docs
    scored = model.score(docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("_text")), text="_text")
    return scored.where("predicted = 0").select("_row.*")


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language can be determined; profiles come from the rows' own ``lang``."""
    prepare(spark)
    profiles = language_id.learn_profiles(docs.select("text", "lang"))
    found = language_id.identify(docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("_text")), profiles, text="_text")
    return found.where(F.col("lang_pred") != language_id.UNDETERMINED).select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of each group of near duplicates, and all that link with nothing.

    A group without any id keeps one of its documents.
    """
    rows = _keyed(docs)
    found = ngram_jaccard.similar_documents(rows.select("_key", F.col("_row.text").alias("text")), Scratch(spark, "pipeline-jaccard"), key="_key")
    at = F.instr("_key", F.lit("|"))
    doc_id = F.when(at > 0, F.expr("substring(_key, instr(_key, '|') + 1)")).cast(docs.schema["doc_id"].dataType)
    first = found.groupBy("component_id").agg(F.min(F.struct(doc_id.isNull().alias("unnamed"), doc_id.alias("id"), F.col("_key"))).alias("first"))
    return rows.join(first.select("first._key"), "_key").dropDuplicates(["_key"]).select("_row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once or twice."""
    rows = _keyed(docs)
    mixed = mixing.mix(rows.select("_key", "_row.text", "_row.source"), key="_key", scratch=Scratch(spark, "pipeline-mixing"))
    copies = mixed.groupBy("_key").agg(F.sum("copies").cast("int").alias("_copies")).where("_copies > 0")  # equal rows share a key
    taken = rows.join(copies, "_key").dropDuplicates(["_key"])
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with what they decode to, as counts and digests."""
    prepare(spark)
    path = vocabulary()
    coded = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), path)
    return coded.select(
        "doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"), "ids",
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_known_languages),
    ("ngram_jaccard", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode_texts),
]

#: No stage can be stated in SQL; the tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    prepare(spark)
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    name, stage = STAGES[-1]
    return stage(spark, docs, sf_dir)
