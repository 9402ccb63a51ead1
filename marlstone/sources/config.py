"""Small files that configure or seed a store: the routing of a vault, and concept pages kept as one JSON object."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone import schemas
from marlstone.sources import tables

_PAGE = (
    "struct<concept_name: string, mention_count: bigint, enrichment_level: int, first_seen: string, last_seen: string, needs_review: boolean, related_concepts: array<string>, "
    "compiled_truth: struct<summary: string, confidence: double, key_facts: array<string>, contradictions: array<string>, open_questions: array<string>>>"
)


def routing(spark: SparkSession, config: dict, default: str) -> tuple[DataFrame, DataFrame, str]:
    """``routes, rules, default`` for ``ingest`` from a configuration; the first rule of a file holds."""
    routes = [(str(folder), str(name)) for folder, name in (config.get("routes") or {}).items()]
    rules: dict[str, tuple] = {}
    for r in config.get("file_rules") or []:
        rules.setdefault(r.get("match"), (r.get("match"), r.get("collection"), r.get("chunk_size"), r.get("overlap")))
    return (
        spark.createDataFrame(routes, "top_folder string, collection string"),
        spark.createDataFrame(list(rules.values()), "match string, collection string, chunk_size int, overlap int"),
        config.get("default") or default,
    )


def read_routing(spark: SparkSession, path: str, default: str) -> tuple[DataFrame, DataFrame, str]:
    """The same from a YAML file (needs the ``yaml`` package); without the file everything goes to the default."""
    if not tables.exists(spark, path):
        return routing(spark, {}, default)
    import yaml

    return routing(spark, yaml.safe_load(spark.read.text(path, wholetext=True).first()["value"]) or {}, default)


def read_concepts(spark: SparkSession, path: str) -> DataFrame:
    """Concept pages of a JSON file ``{concept_id: page}`` in the schema of the store; a broken or missing file has none."""
    if not tables.exists(spark, path):
        return spark.createDataFrame([], schemas.CONCEPTS)
    pages = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string, {_PAGE}>")).alias("concept_id", "p")).where("p is not null")
    truth = [F.col(f"p.compiled_truth.{c}").alias(c) for c in ("summary", "confidence", "key_facts", "contradictions", "open_questions")]
    return pages.select(
        "concept_id", F.coalesce("p.concept_name", "concept_id").alias("concept_name"), F.coalesce("p.mention_count", F.lit(0)).cast("long").alias("mention_count"),
        F.coalesce("p.enrichment_level", F.lit(0)).alias("enrichment_level"), F.try_to_timestamp("p.first_seen").alias("first_seen"), F.try_to_timestamp("p.last_seen").alias("last_seen"),
        F.coalesce("p.needs_review", F.lit(False)).alias("needs_review"), *truth, F.col("p.related_concepts").alias("related"), F.lit(None).cast("string").alias("run"),
    )
