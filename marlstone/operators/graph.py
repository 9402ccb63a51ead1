"""The concept graph: mentions by source, backlinks and related concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.sources import tables


def mentions(rows: DataFrame, links: str = "links", source: str = "source", chunk: str | None = None) -> DataFrame:
    """``concept_id, source, n, display``: how often a source mentions a concept.

    ``rows`` has an array of ``struct(concept_id, display)``; the first display name by chunk
    and place stands for a concept, whatever order rows come in.
    """
    at = F.col(chunk) if chunk else F.lit(0)
    link = rows.select(F.coalesce(F.col(source), F.lit("unknown")).alias("source"), at.alias("chunk"), F.posexplode(links).alias("pos", "link")).where("link.concept_id <> ''")
    first = F.min(F.struct("chunk", "pos", "link.display"))
    return link.groupBy(F.col("link.concept_id").alias("concept_id"), "source").agg(F.count(F.lit(1)).alias("n"), first["display"].alias("display"))


def concepts(edges: DataFrame) -> DataFrame:
    """``concept_id, concept_name, total_mentions, n_sources, backlinks`` from mentions by source; the first source's name holds.

    Only who selects ``backlinks`` has a concept's sources gathered in a row; ``edges`` has them as rows.
    """
    grouped = edges.groupBy("concept_id").agg(
        F.min(F.struct("source", "display")).alias("first"), F.sum("n").alias("total_mentions"), F.count(F.lit(1)).alias("n_sources"), F.array_sort(F.collect_set("source")).alias("backlinks")
    )
    return grouped.select("concept_id", F.coalesce("first.display", "concept_id").alias("concept_name"), "total_mentions", "n_sources", "backlinks")


def stats(edges: DataFrame) -> DataFrame:
    """One row: concepts, edges, the most and the average mentions of a concept."""
    per = edges.groupBy("concept_id").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("sources"))
    return per.agg(
        F.count(F.lit(1)).alias("concepts"), F.coalesce(F.sum("sources"), F.lit(0)).alias("edges"), F.coalesce(F.max("total"), F.lit(0)).alias("max_mentions"),
        F.round(F.coalesce(F.sum("total"), F.lit(0)) / F.greatest(F.lit(1), F.count(F.lit(1))), 4).alias("avg_mentions"),
    )


def level(count):
    """Enrichment level of a number of mentions: stub, basic or full."""
    return F.when(count >= 8, 2).when(count >= 3, 1).otherwise(0)


HUB = 256  # concepts beyond which a source's pairs aren't written out


def related(edges: DataFrame, k: int = 5, of: DataFrame | None = None) -> DataFrame:
    """``concept_id, rank, related_id, shared``: the k concepts that share most sources with each, ties by id.

    ``of`` (``concept_id``): only for these.  Exact, without the pairs of a source that mentions more
    than ``HUB`` concepts, a hub:

    - Other sources give their pairs, counted; what such a pair shares of hubs is added by
      comparing the two concepts' lists of hubs.
    - Concepts with the same list of hubs form a class.  A class as large as k + 1 has k partners that
      share all its hubs, so only classes with its rarest hub can be as good; a smaller one looks at
      all of its hubs.  Of the classes' members the first 2 k by id are enough: at most one is the
      concept itself, and where k are its partners by other sources, those are better than what follows.
    """
    pairs = tables.settle(edges.select("source", "concept_id").distinct())  # read several times
    sizes = pairs.groupBy("source").agg(F.count(F.lit(1)).alias("size"))
    hubs = tables.settle(sizes.where(F.col("size") > HUB).withColumn("hub", F.monotonically_increasing_id()))
    small = pairs.join(hubs.select("source"), "source", "left_anti")
    asked = small if of is None else small.join(of.select("concept_id").distinct(), "concept_id", "left_semi")
    met = asked.join(small.withColumnRenamed("concept_id", "related_id"), "source").where("concept_id <> related_id").groupBy("concept_id", "related_id").agg(F.count(F.lit(1)).alias("shared"))
    if hubs.limit(1).count():
        met = _with_hubs(pairs, hubs, met, k, of)
    order = Window.partitionBy("concept_id").orderBy(F.desc("shared"), "related_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("concept_id", "rank", "related_id", "shared")


def _with_hubs(pairs: DataFrame, hubs: DataFrame, met: DataFrame, k: int, of: DataFrame | None) -> DataFrame:
    """Pairs by other sources with their hubs added, and each concept's best pairs by hubs alone."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("size", "hub"))), lambda x: x["hub"])  # rarest first
    held = tables.settle(pairs.join(hubs, "source").groupBy("concept_id").agg(listed.alias("hubs")))
    classes = tables.settle(held.groupBy("hubs").agg(F.count(F.lit(1)).alias("members")).withColumn("class", F.monotonically_increasing_id()))
    by_class = Window.partitionBy("class").orderBy("concept_id")
    member = held.join(classes.select("hubs", "class"), "hubs").select("concept_id", "class")
    first = member.withColumn("_place", F.row_number().over(by_class)).where(F.col("_place") <= 2 * k).select(F.col("class").alias("other"), F.col("concept_id").alias("related_id"))
    near = tables.settle(_class_pairs(classes, k))
    best = Window.partitionBy("class").orderBy(F.desc("shared"), "related_id")
    best_of = near.join(first, "other").withColumn("_place", F.row_number().over(best)).where(F.col("_place") <= 2 * k).select("class", "related_id", "shared")
    asked = member if of is None else member.join(of.select("concept_id").distinct(), "concept_id", "left_semi")
    by_hubs = asked.join(best_of, "class").where("concept_id <> related_id").select("concept_id", "related_id", "shared")
    one, two = held.withColumnRenamed("hubs", "_one"), held.select(F.col("concept_id").alias("related_id"), F.col("hubs").alias("_two"))
    both = met.join(one, "concept_id", "left").join(two, "related_id", "left")
    both = both.withColumn("shared", F.col("shared") + F.coalesce(F.size(F.array_intersect("_one", "_two")), F.lit(0)))
    whole = both.select("concept_id", "related_id", "shared").unionByName(by_hubs)  # a pair in both has its whole count in the first
    return whole.groupBy("concept_id", "related_id").agg(F.max("shared").alias("shared"))


def _class_pairs(classes: DataFrame, k: int) -> DataFrame:
    """``class, other, shared``: the classes that can hold one of a class's best partners, and how many hubs both have."""
    looks = F.when(F.col("members") > k, F.lit(1)).otherwise(F.size("hubs"))
    left = classes.select("class", F.col("hubs").alias("_one"), F.explode(F.slice("hubs", F.lit(1), looks)).alias("hub"))
    right = classes.select(F.col("class").alias("other"), F.col("hubs").alias("_two"), F.explode("hubs").alias("hub"))
    found = left.join(right, "hub").select("class", "other", F.size(F.array_intersect("_one", "_two")).cast("long").alias("shared"))
    return found.distinct()


def search(pages: DataFrame, query: str, k: int) -> DataFrame:
    """Concepts whose id or name holds the query, exact ids first."""
    q = F.lower(F.lit(query))
    hit = pages.where(F.contains(F.col("concept_id"), q) | F.contains(F.lower("concept_name"), q))
    return hit.orderBy((F.col("concept_id") != q).cast("int"), "concept_id").limit(k)


def lookup(pages: DataFrame, name: str) -> DataFrame:
    """The page of a name: the exact id, else the first that a search finds."""
    return search(pages, name, 1)
