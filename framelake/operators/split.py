"""Splits that keep groups whole and strata balanced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.operators.sequence import fold


def stratum_of(first: Column, second: Column) -> Column:
    """A row's stratum from two flags: 1 for the first, 2 for the second, 3 for both."""
    return first.cast("int") + 2 * second.cast("int")


def group_folds(rows: DataFrame, group: str, stratum: Column, folds: int = 5, seed: int | None = None) -> DataFrame:
    """(group, stratum, n, fold): whole groups, dealt to folds back and forth by falling size within their stratum.

    A group's stratum is the largest of its rows'. Only a row per group is ranked; with a seed, groups of one size come
    in an order drawn by it.
    """
    by = rows.groupBy(group).agg(F.max(stratum).alias("stratum"), F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("stratum").orderBy(F.desc("n"), *([F.xxhash64(group, F.lit(seed))] if seed is not None else []), group)) - 1
    lap, at = F.floor(place / folds), F.pmod(place, F.lit(folds))
    return by.withColumn("fold", F.when(lap % 2 == 0, at).otherwise(folds - 1 - at).cast("int"))


def balanced_folds(rows: DataFrame, group: str, stratum: Column, folds: int = 5, seed: int | None = None) -> DataFrame:
    """(group, n, fold): whole groups, each dealt to the fold where all strata's shares then spread least over the folds.

    Groups come by falling spread of their strata's shares, then size, then an order drawn by seed. A group may have rows of
    any strata, of which there are few; with c the rows of a stratum that a fold has, t those there are and g the group's, the
    squared shares grow by the sum of (2 c g + g^2) / t^2: the least sum of c g / t^2 wins, then the smaller and the first
    fold. It is a row for each group that one task streams through, with a count for each fold and stratum.
    """
    per = rows.groupBy(group, stratum.alias("_s")).agg(F.count("*").alias("_n")).where("_s is not null")
    totals = {r["_s"]: r["t"] for r in per.groupBy("_s").agg(F.sum("_n").alias("t")).orderBy("_s").collect()}  # a row for each stratum
    if not totals:
        return rows.select(group, F.lit(0).cast("long").alias("n"), F.lit(0).alias("fold")).limit(0)
    count_of = lambda s: F.coalesce(F.sum(F.when(F.col("_s") == s, F.col("_n"))), F.lit(0))
    by = per.groupBy(group).agg(F.sum("_n").alias("n"), F.array(*[count_of(s) for s in totals]).alias("_counts"))
    shares = [F.col("_counts")[i] / F.lit(float(t)) for i, t in enumerate(totals.values())]
    mean = sum(shares, F.lit(0.0)) / len(shares)
    spread = F.round(sum(((x - mean) * (x - mean) for x in shares), F.lit(0.0)), 12)
    draw = F.xxhash64(group, F.lit(seed)) if seed is not None else F.lit(0)
    by = by.select(group, "n", "_counts", F.lit(0).alias("_one"), (-spread).alias("_spread"), (-F.col("n")).alias("_size"), draw.alias("_draw"))
    squares = [t * t for t in totals.values()]

    def step(state: list[list[int]] | None, row) -> tuple[list[list[int]], tuple[int]]:
        state, own = state or [[0] * len(squares) for _ in range(folds)], [int(c) for c in row[2]]
        cost = lambda f: (round(sum(c * g / t for c, g, t in zip(state[f], own, squares)), 12), sum(state[f]), f)
        best = min(range(folds), key=cost)
        state[best] = [c + g for c, g in zip(state[best], own)]
        return state, (best,)

    return fold(by, "_one", ["_spread", "_size", "_draw", group], step, ["fold"], "fold int").select(group, "n", "fold")


def in_fold(rows: DataFrame, folds: DataFrame, group: str) -> DataFrame:
    """rows with their group's fold."""
    return rows.join(folds.select(group, "fold"), group)


def fixed_parts(rows: DataFrame, group: str, test: tuple[str, ...]) -> DataFrame:
    """rows with part: test for the named groups, else train."""
    return rows.withColumn("part", F.when(F.col(group).isin(*test), "test").otherwise("train"))
