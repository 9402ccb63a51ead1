"""A stored index of concept names by their runs of one to three letters, for search by any part of a name.

Every id and lower-cased name is cut into its runs of up to three characters.  A query of four
characters or more looks at the run of three that the fewest concepts have and verifies what it
finds; a shorter one is itself such a run, and all that have it are found.  Only the folders of
the runs looked at are read.  The results are those of ``graph.search`` for every query.

Queries that are null or empty find nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.sources import tables

RUN, FOLDERS = 3, 64
_GRAMS = "gram string, concept_id string, concept_name string, folder int"
_COUNTS = "gram string, concepts long, folder int"


def _folder() -> Column:
    return F.pmod(F.xxhash64("gram"), F.lit(FOLDERS)).cast("int")


def _runs(text: Column, lengths) -> Column:
    """The distinct runs of given lengths of a text."""
    cut = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[cut(n) for n in lengths]))


def build(pages: DataFrame, path: str) -> None:
    """Index ``concept_id, concept_name`` under a path, in place of what was there."""
    spark, run = pages.sparkSession, uuid.uuid4().hex
    before = tables.version(spark, path)
    lengths = range(1, RUN + 1)
    both = F.array_distinct(F.concat(_runs(F.col("concept_id"), lengths), _runs(F.lower(F.coalesce("concept_name", F.lit(""))), lengths)))
    rows = pages.where("concept_id is not null").select("concept_id", "concept_name", F.explode(both).alias("gram")).withColumn("folder", _folder())
    rows.hint("rebalance", "folder").sortWithinPartitions("gram", "concept_id").write.partitionBy("folder").parquet(f"{path}/data/{run}/grams")
    counts = spark.read.schema(_GRAMS).parquet(f"{path}/data/{run}/grams").groupBy("gram", "folder").agg(F.count(F.lit(1)).alias("concepts"))
    counts.hint("rebalance", "folder").sortWithinPartitions("gram").write.partitionBy("folder").parquet(f"{path}/data/{run}/counts")
    tables.publish(spark, path, before, {"run": run})


def _stored(spark: SparkSession, path: str, table: str, grams: DataFrame) -> DataFrame:
    """The rows of some runs of letters, from their folders."""
    folders = sorted(r["folder"] for r in grams.select(_folder().alias("folder")).distinct().collect())  # no more than there are
    rows = spark.read.schema(_GRAMS if table == "grams" else _COUNTS).parquet(f"{path}/data/{tables.version(spark, path)['notes']['run']}/{table}")
    return rows.where(F.col("folder").isin(*folders)).drop("folder")


def candidates(queries: DataFrame, path: str) -> DataFrame:
    """``query_id, query, concept_id, concept_name``: what has the rarest run of every query."""
    spark = queries.sparkSession
    asked = queries.select("query_id", F.lower("text").alias("query")).where("query <> ''")
    grams = asked.select("query_id", "query", F.explode(F.when(F.length("query") > RUN, _runs(F.col("query"), [RUN])).otherwise(F.array("query"))).alias("gram"))
    grams = tables.settle(grams)
    met = grams.join(_stored(spark, path, "counts", grams), "gram", "left").withColumn("concepts", F.coalesce("concepts", F.lit(0)))
    rarest = met.groupBy("query_id", "query").agg(F.min(F.struct("concepts", "gram")).alias("rarest")).where("rarest.concepts > 0")  # 0: nothing has it
    rarest = tables.settle(rarest.select("query_id", "query", "rarest.gram"))
    return rarest.join(_stored(spark, path, "grams", rarest), "gram")


def search(queries: DataFrame, path: str, k: int) -> DataFrame:
    """``query_id, rank, concept_id, concept_name``: the first k concepts whose id or name holds ``query_id, text``, exact ids first, then by id."""
    hit = candidates(queries, path).where(F.contains("concept_id", F.col("query")) | F.contains(F.lower("concept_name"), F.col("query")))
    order = Window.partitionBy("query_id").orderBy((F.col("concept_id") != F.col("query")).cast("int"), "concept_id")
    return hit.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "concept_id", "concept_name")


def lookup(queries: DataFrame, path: str) -> DataFrame:
    """The page of every name: the exact id, else the first that a search finds."""
    return search(queries, path, 1).drop("rank")
