"""URL filters whose lists change over time: an as-of join of captures with list entries.

List entries are dated additions and removals.  Per entry they become validity intervals,
``[added, removed)``; the last one may be open.  Every capture is evaluated against the
entries that were active on the day of its fetch, at all the keys of its URL: the host and
each parent domain, and each path prefix below the host.  The most specific active entry
decides: the longest path prefix, else the longest domain.  ``allow`` entries let a URL pass
that a wider entry blocks.

Captures of one URL on one day are brought together first, so a host with a third of all
captures weighs no more than its distinct URLs.  Keys that the list doesn't name, such as a
top-level domain, go before anything is shuffled by key (where the list is too large to be
broadcast, by a join); a listed key's captures are dealt over ``SALT`` parts.  The verdicts go
back to the captures by URL and day.  All of it is DataFrame operations.

A null or host-less URL, or a null date, has no verdict entry and isn't blocked.  Additions and
removals of an entry on one day: the removal holds.  Repeated list rows change nothing;
repeated captures each get their verdict.  An empty list blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


LISTED, LISTED_BYTES = 200_000, 16 << 20  # keys of a list that is broadcast
SALT = 8


def url_host(url: Column) -> Column:
    """Host of an absolute URL in lower case, without user, port and trailing dots; null without one.  An IPv6 host keeps its brackets."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]+)", 1))
    host = F.regexp_replace(host, r"\.+$", "")
    return F.when(host != "", host)


def url_path(url: Column) -> Column:
    """Path of an absolute URL without query and fragment, empty where there is none."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)", 1)


def url_keys(url: Column) -> Column:
    """All keys of a URL as ``struct(kind, value, weight)``: domains, and paths below the host.

    ``weight`` grows with how specific the key is; every path outweighs every domain.
    """
    host = url_host(url)
    labels = F.split(host, r"\.")
    steps = F.filter(F.split(url_path(url), "/"), lambda s: s != "")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, -i, i), ".").alias("value"), i.cast("long").alias("weight")))
    paths = F.transform(
        F.filter(F.sequence(F.lit(0), F.size(steps)), lambda i: i > 0),
        lambda i: F.struct(F.lit("path").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/")).alias("value"), (i + F.lit(1_000_000)).cast("long").alias("weight")),
    )
    return F.when(host.isNotNull(), F.concat(domains, paths))


def validity(entries: DataFrame) -> DataFrame:
    """``kind, value, verdict, since, until`` of entries ``kind, value, verdict, action, day``.

    ``action`` is ``add`` or ``remove``; ``until`` is the first day on which the entry no longer
    holds, null while it still does.  An addition of an active entry replaces its verdict.
    """
    order = Window.partitionBy("kind", "value").orderBy("day")
    by_day = entries.where("kind is not null and value is not null and day is not null and action in ('add', 'remove')").groupBy("kind", "value", "day")
    by_day = by_day.agg(F.max("action").alias("action"), F.max("verdict").alias("verdict"))  # 'remove' > 'add', 'block' > 'allow'
    spans = by_day.withColumn("until", F.lead("day").over(order)).where("action = 'add'")
    return spans.select("kind", "value", "verdict", F.col("day").alias("since"), "until")


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "day") -> DataFrame:
    """Add ``blocked`` (boolean), ``matched_kind``, ``matched_value`` and ``matched_since`` to every capture."""
    added = ("blocked", "matched_kind", "matched_value", "matched_since")
    kept = [c for c in captures.columns if c not in added]
    seen = captures.where(F.col(url).isNotNull() & F.col(day).isNotNull()).select(F.col(url).alias("_url"), F.col(day).cast("date").alias("_day")).distinct()
    keyed = seen.select("_url", "_day", F.explode(url_keys(F.col("_url"))).alias("_key")).select("_url", "_day", F.col("_key.kind").alias("kind"), F.col("_key.value").alias("value"), F.col("_key.weight").alias("weight"))
    spans = validity(entries)
    listed = spans.select("kind", "value").distinct()
    n, size = listed.limit(LISTED + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("value")), F.lit(0))).first()
    keyed = keyed.join(F.broadcast(listed) if n <= LISTED and size <= LISTED_BYTES else listed, ["kind", "value"], "left_semi")
    asked = keyed.select("kind", "value", "_day").distinct()
    active = asked.join(spans, ["kind", "value"]).where((F.col("since") <= F.col("_day")) & (F.col("until").isNull() | (F.col("_day") < F.col("until"))))
    active = active.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    hits = keyed.withColumn("_salt", F.pmod(F.xxhash64("_url"), F.lit(SALT)).cast("int")).join(active, ["kind", "value", "_day", "_salt"])
    best = hits.groupBy("_url", "_day").agg(F.max_by(F.struct("verdict", "kind", "value", "since"), "weight").alias("_best"))
    rows = captures.select(F.struct(*kept).alias("_row"), F.col(url).alias("_at"), F.col(day).cast("date").alias("_on"))
    out = rows.join(best, (F.col("_at") == F.col("_url")) & (F.col("_on") == F.col("_day")), "left")
    return out.select(
        "_row.*",
        F.coalesce(F.col("_best.verdict") == "block", F.lit(False)).alias("blocked"),
        F.col("_best.kind").alias("matched_kind"), F.col("_best.value").alias("matched_value"), F.col("_best.since").alias("matched_since"),
    )
