"""Exact percentiles of keys of any size.

A sketch of each key's values, added up over tasks, brackets every wanted rank between two of the key's values that are
2 SLACK / ACCURACY of its rows apart: apart by ranks, so an outlier doesn't widen a bracket. One pass then counts what lies
below each bracket and each distinct value inside, and running counts of these give the value at the rank. Rows are added up
by value before they are dealt, so neither a hot key nor a hot value comes to one task; what a task sorts of a key are the
distinct values of a bracket, 0.03 % of its rows at most. Where no key has over COUNTED values there is no sketch.

Nulls and NaN don't count; a key without other values has no row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.sources.scratch import materialise

ACCURACY, SLACK = 20_000, 3
#: Values of a key that are counted without a sketch, if no key has more.
COUNTED = 100_000
#: Rows of a table of keys that may be broadcast, of some hundred bytes each; more are joined by a shuffle.
BROADCAST = 200_000
_INF = float("inf")


def percentiles(df: DataFrame, value: str, shares: Sequence[float], *keys: str, lower: bool = False, accuracy: int = ACCURACY) -> DataFrame:
    """(keys, n, q): the percentiles of value as an array, interpolated, or with lower the lower of the values around."""
    own = list(keys) or ["_all"]
    rows = (df if keys else df.withColumn("_all", F.lit(0))).select(*own, F.col(value).cast("double").alias("_v"))
    rows = rows.where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    step = SLACK / accuracy
    sizes = materialise(rows.groupBy(*own).agg(F.count("*").alias("_n")), "sizes")
    n_keys, most = sizes.agg(F.count("*"), F.max("_n")).first()
    n = F.col("_n")
    ranks = [(F.ceil(p * n) - 1, F.ceil(p * n) - 1) if lower else (F.floor(p * (n - 1)), F.ceil(p * (n - 1))) for p in map(F.lit, shares)]
    near = lambda df: F.broadcast(df) if n_keys <= BROADCAST else df
    wanted = lambda i, *more: F.struct(F.lit(i).alias("_i"), *[F.greatest(r, F.lit(0)).cast("long").alias(c) for r, c in zip(ranks[i], ("_first", "_last"))], *more)
    upto = lambda *by: F.sum("_k").over(Window.partitionBy(*own, *by).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    if (most or 0) <= COUNTED:  # no key has more values than a task may sort: all are counted
        counts = rows.groupBy(*own, "_v").agg(F.count("*").alias("_k")).withColumn("_upto", upto())
        ends = counts.join(near(sizes.select(*own, F.array(*[wanted(i) for i in range(len(shares))]).alias("_wanted"))), own)
        inside = lambda r: (r < F.col("_upto")) & (r >= F.col("_upto") - F.col("_k"))
        placed = ends.select(*own, "_v", "_k", "_upto", F.explode(F.filter("_wanted", lambda w: inside(w["_first"]) | inside(w["_last"]))).alias("_w")).select(*own, "_v", "_k", "_upto", "_w.*")
    else:
        edges = [min(1.0, max(0.0, p + s)) for p in shares for s in (-step, step)]
        sketch = rows.groupBy(*own).agg(F.percentile_approx("_v", edges, accuracy).alias("_edges"))

        def bracket(i: int) -> Column:
            few = n * step < 2  # too few for the sketch's ranks to be apart from those beside them
            low, high = (F.lit(beyond) if edges[2 * i + k] in (0.0, 1.0) else F.when(few, beyond).otherwise(F.get("_edges", F.lit(2 * i + k))) for k, beyond in ((0, -_INF), (1, _INF)))
            return wanted(i, low.alias("_low"), high.alias("_high"))

        brackets = materialise(sketch.join(near(sizes), own).select(*own, F.array(*[bracket(i) for i in range(len(shares))]).alias("_wanted")), "brackets")
        below = F.when(F.col("_v") >= F.col("_w._low"), F.col("_v"))  # what lies below is one null
        each = rows.join(near(brackets), own).select(*own, "_v", F.explode("_wanted").alias("_w")).where(F.col("_v") <= F.col("_w._high"))
        placed = each.groupBy(*own, "_w._i", "_w._first", "_w._last", below.alias("_v")).agg(F.count("*").alias("_k")).withColumn("_upto", upto("_i"))
    placed = placed.withColumn("_before", F.col("_upto") - F.col("_k"))
    holds = lambda rank: (F.col("_before") <= F.col(rank)) & (F.col("_upto") > F.col(rank))
    value_at = lambda rank: F.max(F.when(holds(rank), F.col("_v"))).alias(rank)
    found = placed.where(holds("_first") | holds("_last")).groupBy(*own, "_i").agg(value_at("_first"), value_at("_last"))
    by = found.groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("_i", F.col("_first").alias("low"), F.col("_last").alias("high")))).alias("_f")).join(near(sizes), own)

    def q(i: int, p: float) -> Column:
        exact, f = F.lit(p) * (n - 1), F.get("_f", F.lit(i))
        known = lambda c: F.coalesce(f[c], F.raise_error(F.lit("a rank lies outside its bracket")).cast("double"))
        if lower:
            return known("low")
        return F.when(F.floor(exact) == F.ceil(exact), known("low")).otherwise(known("low") * (F.ceil(exact) - exact) + known("high") * (exact - F.floor(exact)))

    return by.select(*keys, n.alias("n"), F.array(*[q(i, p) for i, p in enumerate(shares)]).alias("q"))


def lower_median(df: DataFrame, value: str, *keys: str, name: str = "med") -> DataFrame:
    """(keys, name): the lower middle value."""
    return percentiles(df, value, [0.5], *keys, lower=True).select(*keys, F.col("q")[0].alias(name))
