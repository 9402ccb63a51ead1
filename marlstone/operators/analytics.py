"""Health, freshness and completeness of a collection.

Rows are chunks with ``source, type, ts, chunk_index``; the present moment is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_DAY = 86_400_000_000
UNKNOWN = "未知"


def age_days(ts: Column, as_of: Column) -> Column:
    """Whole elapsed days, not calendar days."""
    return F.floor((F.unix_micros(as_of) - F.unix_micros(ts)) / F.lit(_DAY))


def stats(df: DataFrame) -> DataFrame:
    """One row: rows, distinct sources and types, first and last time."""
    return df.agg(F.count(F.lit(1)).alias("total"), F.countDistinct(F.coalesce("source", F.lit(UNKNOWN))).alias("sources"), F.countDistinct("type").alias("types"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"))


def breakdown(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def volume(df: DataFrame, size: str = "size") -> DataFrame:
    """One row: files, their bytes together, and the largest."""
    return df.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"), F.max(size).cast("long").alias("largest"))


def expired(df: DataFrame, as_of: Column, days: int = 180) -> DataFrame:
    """Sources with rows older than so many whole days: their number, the oldest and its age, oldest first; the scan gets the bound."""
    old = df.where(F.col("ts") <= as_of - F.make_dt_interval(F.lit(days + 1)))
    rows = old.groupBy("source").agg(F.min("ts").alias("oldest"), F.count(F.lit(1)).alias("n"))
    return rows.select("source", "oldest", age_days(F.col("oldest"), as_of).alias("age_days"), "n").orderBy(F.desc("age_days"), "source")


def expiring(df: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Sources with rows of more than so many days: their number, the oldest and its age."""
    old = df.where(F.col("ts") < as_of - F.make_dt_interval(F.lit(days)))
    return old.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("oldest")).withColumn("age_days", age_days(F.col("oldest"), as_of)).orderBy("oldest", "source")


def recent(df: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Sources with rows of the last days: their number, their types and the first of them."""
    new = df.where(F.col("ts") >= as_of - F.make_dt_interval(F.lit(days)))
    return new.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("type")), ", ").alias("types"), F.min("ts").alias("first_seen")).orderBy("first_seen", "source")


def today_by_type(df: DataFrame, as_of: Column) -> DataFrame:
    """``type, n`` of the rows since midnight."""
    return breakdown(df.where(F.col("ts") >= F.date_trunc("day", as_of)), "type")


def today_and_week(df: DataFrame, as_of: Column) -> DataFrame:
    """One row: rows and sources since midnight and of the seven days before it."""
    midnight = F.date_trunc("day", as_of)
    today, week = F.col("ts") >= midnight, F.col("ts") >= midnight - F.make_dt_interval(F.lit(7))
    return df.agg(
        F.count_if(today).alias("today_rows"), F.countDistinct(F.when(today, F.col("source"))).alias("today_sources"),
        F.count_if(week).alias("week_rows"), F.countDistinct(F.when(week, F.col("source"))).alias("week_sources"),
    )


def chunk_gaps(df: DataFrame) -> DataFrame:
    """Gaps in the numbers of a source's chunks, one row per gap: ``source, after, before, n_missing``.

    Neighbouring numbers are compared after repeated ones have gone, so no source's numbers
    are gathered or listed, however many there are or lack.
    """
    order = Window.partitionBy("source").orderBy("chunk_index")
    numbers = df.select("source", "chunk_index").where("chunk_index is not null").distinct()
    steps = numbers.select("source", F.col("chunk_index").alias("after"), F.lead("chunk_index").over(order).alias("before"))
    return steps.where("before - after > 1").withColumn("n_missing", (F.col("before") - F.col("after") - 1).cast("long"))


def gap_summary(df: DataFrame) -> DataFrame:
    """Sources of several chunks whose numbers have gaps: the range, how many are there, and how many are missing."""
    per = df.groupBy("source").agg(F.min("chunk_index").alias("first"), F.max("chunk_index").alias("last"), F.countDistinct("chunk_index").alias("present"))
    missing = (F.col("last") - F.col("first") + 1 - F.col("present")).cast("long")
    return per.where("present > 1").withColumn("n_missing", missing).where("n_missing > 0")


def dead_links(df: DataFrame, existing: DataFrame, key: str = "source", other: str = "original_file") -> DataFrame:
    """Rows that name no existing file, by their source or their original file, whatever the case.

    Two equality joins take the place of one on either name.
    """
    files = existing.select(F.lower("name").alias("name")).distinct()
    by_source = df.join(files.withColumnRenamed("name", "_a"), F.lower(F.col(key).cast("string")) == F.col("_a"), "left_anti")
    return by_source.join(files.withColumnRenamed("name", "_b"), F.lower(F.col(other).cast("string")) == F.col("_b"), "left_anti")


def health_score(n_expired: Column, n_dead: Column, n_gaps: Column) -> Column:
    return F.greatest(F.lit(0), 100 - 5 * n_expired - 3 * n_dead - 2 * n_gaps)


def completeness(df: DataFrame, *columns: str) -> DataFrame:
    """One row: rows, rows that have all columns, and rows that lack each."""
    every = F.lit(True)
    for c in columns:
        every = every & F.col(c).isNotNull()
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(every).alias("complete"), *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in columns])


# fixed values: probe results from best to worst
SEVERITY = ("ok", "warn", "fail")


def severity(status: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITY)), status) - 1


def roll_up(probes: DataFrame, by: str) -> DataFrame:
    """Health of each group of probes: the worst result decides."""
    worst = F.max(severity(F.col("status")))
    return probes.groupBy(by).agg(F.count(F.lit(1)).alias("probes"), F.when(worst >= 2, "critical").when(worst == 1, "warning").otherwise("healthy").alias("health"))


def briefing(df: DataFrame, as_of: Column, most: int = 5) -> DataFrame:
    """One row with the text of a briefing: totals, the last week, and its most active sources."""
    week = today_and_week(df, as_of)
    totals = df.agg(F.count(F.lit(1)).alias("total"), F.countDistinct("source").alias("sources"))
    active = recent(df, as_of).orderBy(F.desc("n"), "source").limit(most)
    lines = active.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "source", "n"))).alias("a"))
    named = F.array_join(F.transform("a", lambda x: F.concat(x["source"].cast("string"), F.lit(" ("), x["n"].cast("string"), F.lit(")"))), ", ")
    rows = totals.crossJoin(week).crossJoin(lines)  # one row each
    return rows.select(
        F.concat_ws(
            " | ", F.format_string("%d rows from %d sources", "total", "sources"), F.format_string("today %d, week %d rows from %d sources", "today_rows", "week_rows", "week_sources"),
            F.when(F.size("a") > 0, F.concat(F.lit("most active: "), named)),
        ).alias("briefing")
    )


def dependency_health(probes: DataFrame) -> DataFrame:
    """One row: ``status, checked, warned, failed`` of the required dependencies (``required, code, error``).

    A dependency passes with code 200, warns with another and fails with an error or no answer; the
    whole passes only if all do, and warns otherwise.
    """
    rows = probes.where("required")
    failed = F.col("error").isNotNull() | F.col("code").isNull()
    counts = rows.agg(F.count(F.lit(1)).alias("checked"), F.count_if(~failed & (F.col("code") != 200)).alias("warned"), F.count_if(failed).alias("failed"))
    return counts.select(F.when(F.col("warned") + F.col("failed") > 0, "warn").otherwise("pass").alias("status"), "checked", "warned", "failed")


# fixed values: the sentences of the health report
_HEALTH = ("知识库共 %d 条记录", "%d 个来源已过期", "%d 个死链接", "%d 个文档存在碎片缺失", "一切正常!")


def health_summary(counts: DataFrame) -> DataFrame:
    """``summary``: a line of what ``total, expired, dead, gaps`` say; issues of which there are none aren't named."""
    named = [F.when(F.col(c) > 0, F.format_string(text, c)) for c, text in zip(("expired", "dead", "gaps"), _HEALTH[1:4], strict=True)]
    fine = F.when(F.col("expired") + F.col("dead") + F.col("gaps") == 0, F.lit(_HEALTH[4]))
    return counts.select(F.concat_ws(" | ", F.format_string(_HEALTH[0], "total"), *named, fine).alias("summary"))
