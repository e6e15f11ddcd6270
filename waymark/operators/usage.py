"""Usage-log statistics: trailing windows, workflow audit, recent misses.

Retried events share their id; the copy that is least by (timestamp, command, query) counts. Windows have an
inclusive lower bound and no upper one. All windows are computed in one pass as conditional aggregates, so no
event is multiplied by the number of windows; empty windows and an empty log give zeros. Events with a null
timestamp are in no window but in the audit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOWS = ((1, "1d"), (2, "2d"), (5, "5d"), (30, "30d"))
"""Trailing windows in days, with their labels (fixed values)."""


def distinct_events(events: DataFrame) -> DataFrame:
    """One row per id; events without id are all kept."""
    cols = [c for c in events.columns if c != "id"]
    first = [c for c in ("timestamp", "command", "query") if c in cols]
    rest = [c for c in cols if c not in first]
    one = events.filter(F.col("id").isNotNull()).groupBy("id").agg(F.min(F.struct(*first, *rest)).alias("e"))
    return one.select("id", *[F.col(f"e.{c}").alias(c) for c in cols]).unionByName(events.filter(F.col("id").isNull()).select("id", *cols))


def zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0).cast("bigint"))


def window_stats(events: DataFrame, now: Column) -> DataFrame:
    """(label, days, total, hits, misses, hit_ratio, avg_results) of each trailing window."""
    e = events.select("timestamp", "hit", "result_count", now.alias("now"))
    aggs = []
    for days, label in WINDOWS:
        inside = F.col("timestamp") >= F.greatest(F.col("now") - days * 86_400, F.lit(0))
        aggs += [F.count_if(inside).alias(f"n{label}"), F.count_if(inside & F.col("hit")).alias(f"h{label}"), F.sum(F.when(inside, F.col("result_count"))).alias(f"r{label}")]
    one = e.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(label).alias("label"), F.lit(days).alias("days"), F.col(f"n{label}").alias("total"), F.col(f"h{label}").alias("hits"), zero(F.col(f"r{label}")).alias("results")) for days, label in WINDOWS]))
    w = one.select(rows.alias("w")).select("w.*")
    ratio = lambda x: F.when(F.col("total") == 0, 0.0).otherwise(x / F.col("total"))
    return w.select("label", "days", "total", "hits", (F.col("total") - F.col("hits")).alias("misses"), ratio(F.col("hits")).alias("hit_ratio"), ratio(F.col("results")).alias("avg_results"))


def workflow_audit(events: DataFrame) -> DataFrame:
    """One row of counts by command; unknown commands count as searches."""
    c = F.col("command")
    limited = F.col("used_type") | F.col("used_lang") | F.col("used_path") | F.col("used_limit")
    return events.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~F.coalesce(c.isin("refs", "pack", "impact"), F.lit(False))).alias("search"),
        *[F.count_if(c == k).alias(k) for k in ("refs", "pack", "impact")],
        F.count_if(limited).alias("filtered_or_limited"),
        F.count_if(~F.coalesce(F.col("hit"), F.lit(False))).alias("misses"),
    )


def recent_misses(events: DataFrame, limit: int = 10) -> DataFrame:
    """The newest events without results."""
    return events.filter(F.col("result_count") == 0).orderBy(F.desc("id"), "timestamp", "query").limit(limit).select("id", "query")


def ascii_bar(value: Column, most: Column, width: int = 30) -> Column:
    """A bar of # in proportion to ``value``; at least one for a positive value."""
    n = F.least(F.greatest(F.round(value / most * width).cast("int"), F.lit(1)), F.lit(width))
    return F.when((most == 0) | (value == 0), "").otherwise(F.repeat(F.lit("#"), n))


def hit_miss_graph(stats: DataFrame) -> DataFrame:
    """(label, hits, misses, hits_bar, misses_bar) of window statistics, which have four rows."""
    most = stats.agg(F.max(F.greatest("hits", "misses"))).scalar()
    return stats.select("label", "hits", "misses", ascii_bar(F.col("hits"), most).alias("hits_bar"), ascii_bar(F.col("misses"), most).alias("misses_bar"))
