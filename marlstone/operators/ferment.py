"""Reconciling the concept graph with stored pages, enrichment and cleanup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.graph import level


def reconcile(store: DataFrame, graph: DataFrame, as_of: Column) -> DataFrame:
    """Stored pages brought up to the graph.

    New concepts enter at level 0 whatever their mentions; known ones get the level of their
    mentions and are marked for review; pages the graph doesn't name stay as they are.
    ``store``: concept_id, concept_name, mention_count, enrichment_level, last_seen, needs_review.
    """
    old = store.select("concept_id", F.col("concept_name").alias("old_name"), F.col("mention_count").alias("old_count"), F.col("enrichment_level").alias("old_level"), F.col("last_seen").alias("old_seen"), F.col("needs_review").alias("old_review"))
    new = graph.select("concept_id", F.col("concept_name").alias("new_name"), F.col("total_mentions").alias("new_count"))
    rows = old.join(new, "concept_id", "full_outer")
    created, gone = F.col("old_count").isNull(), F.col("new_count").isNull()
    event = F.when(created, F.concat(F.lit("first seen, "), F.col("new_count").cast("string"), F.lit(" mentions"))).when(~gone & (F.col("old_count") != F.col("new_count")), F.concat(F.lit("mentions: "), F.col("old_count").cast("string"), F.lit(" -> "), F.col("new_count").cast("string")))
    return rows.select(
        "concept_id", F.coalesce("old_name", "new_name").alias("concept_name"), F.coalesce("new_count", "old_count").alias("mention_count"),
        F.when(created, F.lit(0)).when(gone, F.col("old_level")).otherwise(level(F.col("new_count"))).alias("enrichment_level"),
        F.when(gone, F.col("old_seen")).otherwise(as_of).alias("last_seen"), F.when(created, F.lit(False)).when(gone, F.col("old_review")).otherwise(F.lit(True)).alias("needs_review"),
        F.when(created, "created").when(gone, "kept").otherwise("updated").alias("action"), F.col("old_level").alias("previous_level"), event.alias("event"),
    )


def report(pages: DataFrame) -> DataFrame:
    """One row of counters; a page that goes from 0 to 2 counts as both upgrades."""
    updated, now, then = F.col("action") == "updated", F.col("enrichment_level"), F.col("previous_level")
    return pages.agg(
        F.count_if(F.col("action") == "created").alias("stubs_created"), F.count_if(updated & (now > then) & (now >= 1)).alias("upgrades_basic"),
        F.count_if(updated & (now >= 2) & (then < 2)).alias("upgrades_full"), F.count_if(F.col("event").isNotNull()).alias("timeline_entries"), F.count(F.lit(1)).alias("pages"),
    )


def enrichment_queue(pages: DataFrame) -> DataFrame:
    """Pages to review, most mentioned first, with the level that they have and the one that their mentions ask for.

    The order is that of a range-partitioned sort: no level's pages come to one task.
    """
    rows = pages.where("needs_review").select("concept_id", "concept_name", "mention_count", F.col("enrichment_level").alias("current_level"), level(F.col("mention_count")).alias("target_level"))
    return rows.orderBy(F.desc("mention_count"), "concept_id")


def stale_stubs(pages: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Stubs that were last seen more than so many whole days ago."""
    age = F.floor((F.unix_micros(as_of) - F.unix_micros("last_seen")) / F.lit(86_400_000_000))
    return pages.where("enrichment_level = 0").withColumn("age_days", age).where(F.col("age_days") > days)


def level_distribution(pages: DataFrame) -> DataFrame:
    n, c = F.col("enrichment_level"), F.col("mention_count")
    return pages.agg(
        F.count_if(n == 0).alias("stubs"), F.count_if(n == 1).alias("basic"), F.count_if(n == 2).alias("full"),
        F.sum(c).alias("total_mentions"), F.max(c).alias("max_mentions"), F.round(F.avg(c), 1).alias("avg_mentions"),
    )


def evidence(found: DataFrame, full: bool) -> DataFrame:
    """Rows of a concept's evidence with their facts, from its nearest rows (``concept, rank, distance, source, text``).

    Basic enrichment keeps a similarity of 0.4 and 200 characters, full enrichment 0.35 and 300.
    """
    least, width = (0.35, 300) if full else (0.4, 200)
    near = F.greatest(F.lit(0.0), 1 - F.col("distance") / 2)
    near = F.when(F.col("distance").isNull(), F.lit(0.5) if full else F.lit(None)).otherwise(near)
    return found.withColumn("similarity", F.round(near, 6)).where(F.col("similarity") >= least).withColumn("fact", F.trim(F.substring("text", 1, width)))


def compiled(rows: DataFrame, full: bool) -> DataFrame:
    """``concept, facts, sources, contradictions, confidence``: what evidence adds up to.

    In full enrichment a source that is new after at least one other and among at least three
    facts counts as a possible contradiction.
    """
    if not full:
        return rows.groupBy("concept").agg(F.count_if(F.col("fact") != "").alias("facts"), F.countDistinct("source").alias("sources")).withColumn("contradictions", F.lit(0).cast("long")).withColumn("confidence", F.lit(0.5))
    out = _marked(rows).groupBy("concept").agg(F.count(F.lit(1)).alias("facts"), F.count_if("is_new").alias("sources"), F.count_if("odd").alias("contradictions"))
    return out.withColumn("confidence", F.when(F.col("contradictions") > 0, 0.55).otherwise(0.75))


def _marked(rows: DataFrame) -> DataFrame:
    """Evidence with ``is_new`` (the first of its source) and ``odd`` (a possible contradiction)."""
    upto = Window.partitionBy("concept").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    first = F.row_number().over(Window.partitionBy("concept", F.coalesce("source", F.lit("unknown"))).orderBy("rank")) == 1
    marked = rows.withColumn("is_new", first).withColumn("position", F.count(F.lit(1)).over(upto))
    marked = marked.withColumn("known", F.sum(F.col("is_new").cast("int")).over(upto) - F.col("is_new").cast("int"))
    return marked.withColumn("odd", F.col("is_new") & (F.col("known") >= 1) & (F.col("position") >= 3))


# fixed values: the sentences of compiled knowledge
_BASIC = "关于 '%s' 的基础信息，基于 %d 条相关片段"
_FULL = "'%s' 的完整知识图谱，基于 %d 条证据，来自 %d 个独立来源"
_ODD = "多源信息交叉验证中: %s vs 其他来源"
_QUESTION = "多源信息存在差异，需要人工确认"


def truth(rows: DataFrame, full: bool) -> DataFrame:
    """``concept, summary, confidence, key_facts, contradictions, open_questions`` from evidence with the concept's ``name``.

    A concept has at most ten rows of evidence.  Basic enrichment keeps its facts that aren't
    blank, full enrichment the first eight facts and three contradictions.
    """
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("rank", c)))), lambda x: x[c])
    nothing = F.array().cast("array<string>")
    if not full:
        told = rows.withColumn("told", F.when(F.col("fact") != "", F.col("fact"))).groupBy("concept").agg(F.max("name").alias("name"), in_order("told").alias("facts"))
        summary = F.when(F.size("facts") > 0, F.format_string(_BASIC, "name", F.size("facts"))).otherwise("")
        return told.select("concept", summary.alias("summary"), F.lit(0.5).alias("confidence"), F.slice("facts", 1, 5).alias("key_facts"), nothing.alias("contradictions"), nothing.alias("open_questions"))
    marked = _marked(rows).withColumn("doubt", F.when(F.col("odd"), F.format_string(_ODD, F.coalesce("source", F.lit("unknown")))))
    told = marked.groupBy("concept").agg(F.max("name").alias("name"), in_order("fact").alias("facts"), in_order("doubt").alias("doubts"), F.count_if("is_new").alias("sources"))
    return told.select(
        "concept", F.format_string(_FULL, "name", F.size("facts"), "sources").alias("summary"), F.when(F.size("doubts") > 0, 0.55).otherwise(0.75).alias("confidence"),
        F.slice("facts", 1, 8).alias("key_facts"), F.slice("doubts", 1, 3).alias("contradictions"), F.when(F.size("doubts") > 0, F.array(F.lit(_QUESTION))).otherwise(nothing).alias("open_questions"),
    )


def numbered(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Entries with their place ``seq``, from 1, within their key."""
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def appended(timeline: DataFrame, events: DataFrame) -> DataFrame:
    """New entries of a timeline (``concept_id, seq``), numbered on from each concept's last one in order of ``pos``."""
    last = timeline.groupBy("concept_id").agg(F.max("seq").alias("last"))
    rows = numbered(events, "concept_id", "pos").join(last, "concept_id", "left")
    return rows.withColumn("seq", F.coalesce("last", F.lit(0)) + F.col("seq")).drop("last")


def timeline_of(timeline: DataFrame, pages: DataFrame) -> DataFrame:
    """Entries with the name and mentions of their concept."""
    return timeline.join(pages.select("concept_id", "concept_name", "mention_count"), "concept_id")


def diff_summary(told: DataFrame) -> DataFrame:
    """``summary``: a line of what a night did, from one row of counters; steps that did nothing aren't named.

    ``pages, concepts, edges, avg_mentions, stubs_created, upgrades_basic, upgrades_full, enriched_basic, enriched_full, removed``.
    """
    some = lambda c, text: F.when(F.col(c) > 0, F.format_string(text, c))
    joined = lambda head, *parts: F.when(F.concat_ws(", ", *parts) != "", F.concat(F.lit(head), F.concat_ws(", ", *parts)))
    return told.select(
        F.concat_ws(
            # fixed values: the sentences of the summary
            " | ", F.format_string("总计 %d 个概念页面", "pages"), F.format_string("图谱: %d 概念, %d 边, 平均 %.1f 次引用", "concepts", "edges", "avg_mentions"), some("stubs_created", "新建 %d 个 stub 页面"),
            joined("升级: ", some("upgrades_basic", "basic=%d"), some("upgrades_full", "full=%d")), joined("富化: ", some("enriched_basic", "基础富化 %d"), some("enriched_full", "完整富化 %d")), some("removed", "清理 %d 个孤立概念"),
        ).alias("summary")
    )
