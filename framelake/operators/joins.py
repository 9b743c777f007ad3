"""Joins: intervals, priorities, continuity, mutual nearest neighbours, gathers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.operators.keypoints import matrix


def lag_offset(frame: Column, start: Column, every: int = 6) -> Column:
    """greatest(0, ceil((frame - start) / every)); 0 where there is no start."""
    return F.coalesce(F.greatest(F.lit(0), F.ceil((frame - start) / F.lit(every))), F.lit(0)).cast("bigint")


def correct_lag(frames: DataFrame, segments: DataFrame, bound: int = 100_000) -> DataFrame:
    """frames (video, frame_id, ...) with offset and actual from the segment that holds them, offset 0 outside.

    segments: video, start_frame, end_frame, startpoint, without overlaps in a video. They are broadcast if there are
    at most bound of them; else frames and segment starts are merged in order and the last start carried forward, which
    needs no theta join.
    """
    if segments.count() <= bound:
        s = F.broadcast(segments.withColumnRenamed("video", "seg_video"))
        held = frames.join(s, (F.col("video") == F.col("seg_video")) & F.col("frame_id").between(F.col("start_frame"), F.col("end_frame")), "left").drop("seg_video", "start_frame", "end_frame")
    else:
        marks = segments.select("video", F.col("start_frame").alias("frame_id"), F.struct("end_frame", "startpoint").alias("seg"), F.lit(0).alias("kind"))
        rows = frames.withColumn("seg", F.lit(None).cast(marks.schema["seg"].dataType)).withColumn("kind", F.lit(1))
        w = Window.partitionBy("video").orderBy("frame_id", "kind").rowsBetween(Window.unboundedPreceding, 0)
        both = rows.unionByName(marks, allowMissingColumns=True).withColumn("seg", F.last("seg", ignorenulls=True).over(w)).where("kind = 1")
        held = both.withColumn("startpoint", F.when(F.col("frame_id") <= F.col("seg.end_frame"), F.col("seg.startpoint"))).drop("seg", "kind")
    out = held.withColumn("offset", lag_offset(F.col("frame_id"), F.col("startpoint")))
    return out.withColumn("actual", F.col("frame_id") - F.col("offset")).drop("startpoint")


def expand_lag(segments: DataFrame, every: int = 6) -> DataFrame:
    """The other form: a row for each frame of a segment with a running lag (+1 at each frame that starts a new step)."""
    rows = segments.select("video", "start_frame", "startpoint", F.explode(F.sequence("start_frame", "end_frame")).alias("frame_id"))
    before = F.greatest(F.lit(0), F.ceil((F.col("start_frame") - 1 - F.col("startpoint")) / every))
    step = F.when((F.col("frame_id") > F.col("startpoint")) & (F.pmod(F.col("frame_id") - F.col("startpoint") - 1, F.lit(every)) == 0), 1).otherwise(0)
    w = Window.partitionBy("video", "start_frame").orderBy("frame_id")
    return rows.select("video", "frame_id", (before + F.sum(step).over(w)).cast("bigint").alias("offset"))


def by_priority(rows: DataFrame, key: str, first: DataFrame, second_key: str, second: DataFrame) -> DataFrame:
    """rows with value and status: from first by key, else from second by second_key, else 'missing'.

    first and second have their key once and a column value.
    """
    a, b = first.select(key, F.col("value").alias("v1")), second.select(second_key, F.col("value").alias("v2"))
    both = rows.join(a, key, "left").join(b, second_key, "left")
    status = F.when(F.col("v1").isNotNull(), "direct").when(F.col("v2").isNotNull(), "fallback").otherwise("missing")
    return both.withColumn("value", F.coalesce("v1", "v2")).withColumn("status", status).drop("v1", "v2")


def consecutive(frames: DataFrame, key: str, frame: str) -> DataFrame:
    """frames with prev_frame (of the row before in the key) and continuous: whether that is frame - 1."""
    prev = F.lag(frame).over(Window.partitionBy(key).orderBy(frame))
    return frames.withColumn("prev_frame", prev).withColumn("continuous", F.coalesce(prev == F.col(frame) - 1, F.lit(False)))


def matches(prev: DataFrame, curr: DataFrame, pair: str, least: float | None = None) -> DataFrame:
    """(pair, i, j, score) of keypoints (pair, id, descriptor) that are each other's best, ties to the smaller id.

    A pair's sides are two frames' keypoints, a few thousand at most: one product of matrices in a task gives the scores,
    of which only the matches leave it.
    """

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = a.sort_by("id"), b.sort_by("id")
        i = j = np.zeros(0, "int64")
        scores = np.zeros((0, 0))
        if a.num_rows and b.num_rows:
            scores = np.round(matrix(a["descriptor"]) @ matrix(b["descriptor"]).T, 6)
            i = np.arange(a.num_rows)
            j = scores.argmax(axis=1)
            mutual = scores.argmax(axis=0)[j] == i
            i, j = i[mutual], j[mutual]
            if least is not None:
                i, j = (x[scores[i, j] > least] for x in (i, j))
        key = (a if a.num_rows else b)[pair][0]
        return pa.table([pa.array([key.as_py()] * len(i), key.type), a["id"].take(pa.array(i)), b["id"].take(pa.array(j)), pa.array(scores[i, j] if len(i) else [], pa.float64())], [pair, "i", "j", "score"])

    kinds = [x.schema[c].dataType.simpleString() for x, c in ((prev, pair), (prev, "id"), (curr, "id"))]
    # columns of their own, since both sides often come from one table
    sides = (side.select(*[F.col(c).alias(c) for c in (pair, "id", "descriptor")]).groupBy(pair) for side in (prev, curr))
    return next(sides).cogroup(next(sides)).applyInArrow(run, f"{pair} {kinds[0]}, i {kinds[1]}, j {kinds[2]}, score double")


def mutual_best(scores: DataFrame, pair: str, least: float | None = None) -> DataFrame:
    """Matches (pair, i, j, score): j is i's best and i is j's best, ties to the smaller id; score above least."""
    best_j = scores.groupBy(pair, "i").agg(F.max_by("j", F.struct("score", -F.col("j"))).alias("j"), F.max("score").alias("score"))
    best_i = scores.groupBy(pair, "j").agg(F.max_by("i", F.struct("score", -F.col("i"))).alias("i"))
    both = best_j.join(best_i, [pair, "i", "j"])
    return both.select(pair, "i", "j", "score") if least is None else both.where(F.col("score") > least).select(pair, "i", "j", "score")


def gather(cells: DataFrame, source: DataFrame, x: Column, y: Column, name: str = "v") -> DataFrame:
    """cells (img, ...) with the value of their image in source (img, x, y, v) at places x and y, 0 outside.

    Places are rounded already; source has a row per place.
    """
    s = source.select(F.col("img").alias("_img"), F.col("x").alias("_sx"), F.col("y").alias("_sy"), F.col("v").alias("_sv"))
    rows = cells.withColumn("_gx", x.cast("int")).withColumn("_gy", y.cast("int"))
    same = F.col("img").eqNullSafe(F.col("_img")) & (F.col("_gx") == F.col("_sx")) & (F.col("_gy") == F.col("_sy"))
    return rows.join(s, same, "left").withColumn(name, F.coalesce("_sv", F.lit(0).cast("bigint"))).drop("_img", "_sx", "_sy", "_sv", "_gx", "_gy")


def aligned(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """(img, x, y, pred, gt) of two label images (img, x, y, v), pred brought to gt's size by nearest places where they differ.

    An image's size is what its cells span from 0.
    """
    size = lambda df, a, b: df.groupBy("img").agg((F.max("x") + 1).alias(a), (F.max("y") + 1).alias(b))
    sizes = size(gt, "gw", "gh").join(size(pred, "pw", "ph"), "img")
    cells = gt.withColumnRenamed("v", "gt").join(sizes, "img")
    at = lambda c, a, b: F.floor(F.col(c) * F.col(a) / F.col(b))
    return gather(cells, pred, at("x", "pw", "gw"), at("y", "ph", "gh"), "pred").select("img", "x", "y", "pred", "gt")
