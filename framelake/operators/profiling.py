"""Execution profiles: event kinds, totals by key, overhead of fences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ends of the names of a node's events.
KERNEL, BEFORE, AFTER = "_kernel_time", "_fence_before", "_fence_after"


def event_kind(cat: Column, name: Column) -> Column:
    return F.when(cat == "Session", "session").when(cat != "Node", "other").when(name.endswith(KERNEL), "kernel").when(name.endswith(BEFORE), "fence_before").when(name.endswith(AFTER), "fence_after").otherwise("node")


def totals(events: DataFrame, key: str, dur: str, top: int | None = None) -> DataFrame:
    """(key, total, n, mean, pct of all), the largest totals first, ties by key."""
    by = events.groupBy(key).agg(F.sum(dur).alias("total"), F.count("*").alias("n"), F.avg(dur).alias("mean"))
    out = by.select(key, "total", "n", "mean", (100 * F.try_divide(F.col("total"), by.agg(F.sum("total")).scalar())).alias("pct"))
    return out.orderBy(F.desc("total"), key).limit(top) if top else out


def fence_overhead(events: DataFrame, node: str, kind: str, dur: str) -> DataFrame:
    """(node, before, kernel, after, overhead): sums by kind; overhead is the fences' percentage of all three."""
    part = lambda k: F.coalesce(F.sum(F.when(F.col(kind) == k, F.col(dur))), F.lit(0))
    by = events.groupBy(node).agg(part("fence_before").alias("before"), part("kernel").alias("kernel"), part("fence_after").alias("after"))
    return by.withColumn("overhead", F.coalesce(100 * F.try_divide(F.col("before") + F.col("after"), F.col("before") + F.col("kernel") + F.col("after")), F.lit(0.0)))


def running_rank(events: DataFrame, key: str, *order: Column) -> DataFrame:
    """events with place: its row number in the key (1: the value's first, of which alone a warning is given)."""
    return events.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
