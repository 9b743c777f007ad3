"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies, its source's target over the source's size. The
whole part is taken at once; the fractions are rounded by the pivotal method: two fractional documents exchange words
in a random direction until one of them is integral, so the words taken by the pair don't change. Blocks of about
BLOCK units are rounded in parallel, each leaves one fractional unit at most, and these residuals are combined in
further levels of blocks until one per source is left, which goes to its nearer side. So the words taken from a source
differ from its target by at most half a document.

Rows equal in id, source and size are one unit: of their expected copies together, the whole part is taken at once and
only the fraction is rounded; they are dealt to the rows as evenly as whole numbers allow.

Defined results: null texts have size 0 and are never taken; a null source is a source of its own, last in order; an
empty table gives an empty result; a text of any length is one unit. Extra columns, whatever their names, are kept by
mixed_documents(); of rows that share id, source and size but differ elsewhere, those with smaller hashes come first. The random choices come from hashes of the ids and of the block numbers, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.common import WORD, materialise, small, whole

WEIGHTS = (3, 1, 2)
SHARE, CEILING = 1.5, 2.0
#: Units that one group rounds, and residuals that the next level joins.
BLOCK = 1024
SEED = 20_11


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): words of each whole text."""
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.regexp_count(whole(), F.lit(WORD)).cast("long").alias("size"))


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """(source, source_size, units, weight, target), one row per source.

    Sharing the excess of full sources again and again ends where every open source has the same target per weight.
    That level is found in one pass over the sources in the order in which they fill up.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("units"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))
    by = by.withColumn("full", F.col("source_size") * F.lit(float(ceiling)))
    order = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    by = by.withColumn("level", level)
    open_ = F.when(F.col("level") * F.col("weight") <= F.col("full"), F.col("level"))
    by = by.withColumn("level", F.first(open_, ignorenulls=True).over(every))
    target = F.least(F.col("full"), F.coalesce(F.col("level") * F.col("weight"), F.col("full")))
    return by.select("source", "source_size", "units", "weight", target.alias("target"))


def pivot(mass: np.ndarray, p: np.ndarray, seed: int) -> np.ndarray:
    """Probabilities after pairwise exchanges of mass; at most one stays fractional."""
    p, toss, held = p.copy(), np.random.default_rng(seed).random(len(p)), -1
    for j in np.flatnonzero((p > 0) & (p < 1)):
        if held < 0:
            held = j
            continue
        a, b = mass[held], mass[j]
        rise, fall = min(a * (1 - p[held]), b * p[j]), min(a * p[held], b * (1 - p[j]))
        move = rise if toss[j] * (rise + fall) < fall else -fall
        p[held] += move / a
        p[j] -= move / b
        for k in (held, j):
            if p[k] < 1e-12 or p[k] > 1 - 1e-12:
                p[k] = round(p[k])
        held = held if 0 < p[held] < 1 else j if 0 < p[j] < 1 else -1
    return p


def _round_block(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["toss", "doc_id", "size"], kind="stable")
    seed = abs(hash((int(pdf["source_no"].iat[0]), int(pdf["block"].iat[0]), int(pdf["height"].iat[0]), SEED)))
    return pdf.assign(p=pivot(pdf["size"].to_numpy("float64"), pdf["p"].to_numpy("float64"), seed))


def unit_copies(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """(doc_id, source, size, rows, source_size, target, each, more): units of equal rows with their copies.

    Each of a unit's rows has each copies, and more of them one further. sized should be a stored table: it is read
    twice.
    """
    names = Window.orderBy(F.col("source").asc_nulls_last())
    targets = materialise(source_targets(sized, weights, share, ceiling).withColumn("source_no", F.row_number().over(names).cast("long")), "targets")
    near = small(targets, targets.count(), 200_000).withColumnRenamed("source", "target_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    own = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")).join(near, F.col("source").eqNullSafe(F.col("target_source")))
    extra = F.when(F.col("size") > 0, F.col("rows") * (rate - F.floor(rate))).otherwise(0.0)
    own = own.withColumn("each", F.when(F.col("size") > 0, F.floor(rate)).otherwise(0).cast("long")).withColumn("whole", F.floor(extra + 1e-9).cast("long")).withColumn("p", extra - F.col("whole"))
    own = own.withColumn("p", F.when(F.col("p") > 1e-9, F.col("p")).otherwise(0.0))
    own = materialise(own.select("doc_id", "source", "size", "rows", "source_size", "target", "source_no", "each", "whole", "p", F.ceil(F.col("units") / BLOCK).alias("blocks")), "units")
    toss = F.xxhash64("doc_id", "size", F.lit(SEED))
    shape = f"doc_id {own.schema['doc_id'].dataType.simpleString()}, source_no long, size long, p double, toss long, block long, height int"
    level = own.where("p > 0").select("doc_id", "source_no", "size", "p", toss.alias("toss"), F.pmod(F.xxhash64(toss), F.col("blocks")).alias("block"), F.lit(0).alias("height"))
    most = own.agg(F.max("blocks")).first()[0] or 1
    done, height = [], 0
    while True:
        rounded = materialise(level.groupBy("source_no", "block").applyInPandas(_round_block, shape), f"level{height}")
        done.append(rounded.where("p = 0 or p = 1" if most > 1 else "true"))
        if most <= 1:
            break
        most, height = -(-most // BLOCK), height + 1
        level = rounded.where("p > 0 and p < 1").withColumn("block", F.floor(F.col("block") / BLOCK)).withColumn("height", F.lit(height))
    bits = done[0]
    for more in done[1:]:
        bits = bits.unionByName(more)
    bits = bits.where("p >= 0.5").select(F.col("doc_id").alias("unit_id"), F.col("source_no").alias("unit_source"), F.col("size").alias("unit_size"), F.lit(1).alias("bit"))
    same = F.col("doc_id").eqNullSafe(F.col("unit_id")) & (F.col("source_no") == F.col("unit_source")) & (F.col("size") == F.col("unit_size"))
    return own.join(bits, same, "left").select("doc_id", "source", "size", "rows", "source_size", "target", "each", (F.col("whole") + F.coalesce("bit", F.lit(0))).alias("more"))


def mix(sized: DataFrame, **how) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for each row of sized, which has doc_id, source and size."""
    row = unit_copies(sized, **how).withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return row.select("doc_id", "source", "size", "source_size", "target", (F.col("each") + (F.col("row") <= F.col("more")).cast("long")).alias("copies"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """docs as the mix takes them: each row as many times as it has copies, with the columns of docs."""
    units = materialise(unit_copies(materialise(sizes(docs), "sizes"), **how).where("each > 0 or more > 0"), "copies")
    words = F.regexp_count(whole(), F.lit(WORD)).cast("long")
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"), F.col("doc_id").alias("id"), F.col("source").cast("string").alias("of"), words.alias("words"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & F.col("of").eqNullSafe(F.col("source")) & (F.col("words") == F.col("size"))
    even = units.where("more = 0 or more = rows").hint("merge")  # documents are dealt by unit, at any size
    taken = rows.join(even, same).select("doc", (F.col("each") + (F.col("more") > 0).cast("long")).alias("copies"))
    torn = units.where("more > 0 and more < rows")
    if torn.head(1):  # some of a unit's rows get one copy more: those of the smallest hashes, equal rows together
        key = ["doc_id", "source", "size"]
        alike = rows.join(torn, same).groupBy(*key, "each", "more", "rows", F.xxhash64("doc").alias("toss"), F.xxhash64(F.lit(SEED), "doc").alias("tie")).agg(F.first("doc").alias("doc"), F.count("*").alias("n"))
        lots = F.ceil(F.col("rows") / BLOCK)
        alike = materialise(alike.withColumn("lot", F.floor((F.col("toss") / F.lit(2.0**64) + 0.5) * lots)), "torn")
        counts = alike.groupBy(*key, "lot").agg(F.sum("n").alias("n"))
        upto = Window.partitionBy(*key).orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.select(*[F.col(c).alias(f"of_{c}") for c in (*key, "lot")], F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
        on = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in (*key, "lot")]
        within = Window.partitionBy(*key, "lot").orderBy("toss", "tie").rowsBetween(Window.unboundedPreceding, -1)
        at = alike.withColumn("place", F.coalesce(F.sum("n").over(within), F.lit(0))).join(counts, on[0] & on[1] & on[2] & on[3])
        more = F.least(F.greatest(F.col("more") - F.col("before") - F.col("place"), F.lit(0)), F.col("n"))
        parts = at.select("doc", (F.col("each") * F.col("n") + more).alias("copies")).where("copies > 0")
        parts = parts.select("doc", "copies", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / BLOCK))).alias("piece"))
        piece = F.least(F.col("copies") - F.col("piece") * BLOCK, F.lit(BLOCK).cast("long"))
        taken = taken.unionByName(parts.select("doc", piece.alias("copies")).hint("rebalance"))
    return taken.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc.*")
