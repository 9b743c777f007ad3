"""Evaluation metrics: confusion counts, Dice and IoU by class and bin, robust statistics, latency summaries.

All of them are hash aggregations with partial sums on the map side; what is shuffled has a row per class or bin and
task. Missing values are NULL, never NaN.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.operators import tiles
from framelake.operators.raster import ground_distance
from framelake.operators.selection import lower_median, percentiles
from framelake.sources.scratch import materialise

EPS = 1e-6
#: Bins whose counts are columns of one row.
FEW = 4


def pairs(df: DataFrame, pred: Column, gt: Column, *keys: str, ignore: Sequence[int] = ()) -> DataFrame:
    """(keys, pred, gt, n): the confusion table; pixels whose gt is ignored don't count."""
    rows = df.where(~gt.isin(*ignore)) if ignore else df
    return rows.groupBy(*keys, pred.alias("pred"), gt.alias("gt")).agg(F.count("*").alias("n"))


def class_counts(confusion: DataFrame, classes: Sequence[int], *keys: str) -> DataFrame:
    """(keys, cls, inter, pred_sum, gt_sum) of the classes that occur, from a confusion table."""
    side = F.explode(F.array(F.struct(F.col("pred").alias("cls"), F.lit(True).alias("p")), F.struct(F.col("gt").alias("cls"), F.lit(False).alias("p")))).alias("s")
    rows = confusion.select(*keys, "pred", "gt", "n", side).where(F.col("s.cls").isin(*classes))
    one = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return rows.groupBy(*keys, F.col("s.cls").alias("cls")).agg(one(F.col("s.p") & (F.col("pred") == F.col("gt"))).alias("inter"), one(F.col("s.p")).alias("pred_sum"), one(~F.col("s.p")).alias("gt_sum"))


def dice(inter: Column, pred: Column, gt: Column, eps: float = EPS) -> Column:
    """2 I / (P + G + eps); NULL where P + G is 0."""
    return F.when(pred + gt > 0, 2 * inter / (pred + gt + F.lit(eps)))


def iou(inter: Column, pred: Column, gt: Column, eps: float = EPS) -> Column:
    """I / (U + eps); NULL where the union is empty."""
    union = pred + gt - inter
    return F.when(union > 0, inter / (union + F.lit(eps)))


def macro_mean(per_class: DataFrame, value: str, exclude: Sequence[int] = (), *keys: str) -> DataFrame:
    """Mean of value over the classes that have one and aren't excluded."""
    rows = per_class.where(F.col(value).isNotNull())
    if exclude:
        rows = rows.where(~F.col("cls").isin(*exclude))
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count("*").alias("n_classes"))


def bin_of(value: Column, edges: Sequence[float]) -> Column:
    """Place of the half-open bin [edge, next edge); the last bin holds all beyond."""
    out = F.lit(len(edges) - 2)
    for i in range(len(edges) - 2, 0, -1):
        out = F.when(value < edges[i], F.lit(i - 1)).otherwise(out)
    return out


def centre_distance(x: Column, y: Column, width: int, height: int) -> Column:
    """Distance to the image's centre, 1 at its corners."""
    cx, cy = (width - 1) / 2, (height - 1) / 2
    return F.hypot(x - cx, y - cy) / (F.hypot(F.lit(cx), F.lit(cy)) + F.lit(1e-12))


def _sides(pixels: DataFrame, keys: Sequence[str], classes: Sequence[int]) -> tuple[DataFrame, dict[str, Column]]:
    """(keys, s) with each pixel's truth and, where that is another, its prediction; and which of them count as gt (g), hit (i) and wrong (w)."""
    hit = F.col("pred") == F.col("gt")
    truth = F.struct(F.col("gt").alias("cls"), F.when(hit, 1).otherwise(0).alias("kind"))
    wrong = F.struct(F.when(~F.coalesce(hit, F.lit(False)), F.col("pred")).alias("cls"), F.lit(2).alias("kind"))
    sides = pixels.select(*keys, F.explode(F.array(truth, wrong)).alias("s")).where(F.col("s.cls").isin(*classes))
    return sides, {"g": F.col("s.kind") < 2, "i": F.col("s.kind") == 1, "w": F.col("s.kind") == 2}


def size_bins(pixels: DataFrame, image: Sequence[str], small: float, medium: float, classes: Sequence[int] = range(256)) -> DataFrame:
    """(cls, bin, inter, pred_sum, gt_sum): a class's counts by its area within each image (0 small, 1 medium, 2 large).

    pixels has pred and gt. Classes that an image's gt lacks don't count there, even where predicted, nor do others than
    classes. A task holds one table of counts by image and class: rows are combined before they are dealt, by that key alone.
    """
    sides, kinds = _sides(pixels, image, classes)
    g, i, w = (F.col(k) for k in kinds)
    held = sides.groupBy(*image, F.col("s.cls").alias("cls")).agg(*[F.count_if(cond).alias(k) for k, cond in kinds.items()]).where(g > 0)
    per_image = held.select("cls", i.alias("inter"), (i + w).alias("pred_sum"), g.alias("gt_sum"))
    size = F.when(F.col("gt_sum") < small, 0).when(F.col("gt_sum") < medium, 1).otherwise(2)
    return per_image.groupBy("cls", size.alias("bin")).agg(*[F.sum(c).alias(c) for c in ("inter", "pred_sum", "gt_sum")])


def counts_in_bins(pixels: DataFrame, image: Sequence[str], classes: Sequence[int], bins: int) -> DataFrame:
    """(cls, bin, inter, pred_sum, gt_sum) of pixels (image, pred, gt, bin from 0 to bins - 1), as size_bins() counts.

    With up to FEW bins one row for each image and class is dealt, with its counts of all bins; with more, a row for each of
    these bins, and once again by image and class.
    """
    if bins > FEW:
        per_bin = class_counts(pairs(pixels, F.col("pred"), F.col("gt"), *image, "bin"), classes, *image, "bin")
        rows = per_bin.withColumn("_has", F.sum("gt_sum").over(Window.partitionBy(*image, "cls"))).where("_has > 0")
        return rows.groupBy("cls", "bin").agg(*[F.sum(c).alias(c) for c in ("inter", "pred_sum", "gt_sum")])
    sides, kinds = _sides(pixels, [*image, "bin"], classes)
    counts = [F.count_if(cond & (F.col("bin") == b)).alias(f"{k}{b}") for k, cond in kinds.items() for b in range(bins)]
    per_image = sides.groupBy(*image, F.col("s.cls").alias("cls")).agg(*counts).where(sum((F.col(f"g{b}") for b in range(bins)), F.lit(0)) > 0)
    whole = per_image.groupBy("cls").agg(*[F.sum(f"{k}{b}").alias(f"{k}{b}") for k in kinds for b in range(bins)])
    each = F.array(*[F.struct(F.lit(b).alias("bin"), F.col(f"i{b}").alias("inter"), (F.col(f"i{b}") + F.col(f"w{b}")).alias("pred_sum"), F.col(f"g{b}").alias("gt_sum")) for b in range(bins)])
    return whole.select("cls", F.explode(each).alias("e")).select("cls", "e.*").where("pred_sum + gt_sum > 0")


def ground_bins(pixels: DataFrame, classes: Sequence[int] = range(256), bins: int = 12) -> DataFrame:
    """(cls, bin, inter, pred_sum, gt_sum) of pixels (img, x, y, pred, gt) off the background, class 0 of gt.

    bin is by the distance to the background over the image's largest. Images without background take no part, nor do
    classes but those named.
    """
    far = ground_distance(pixels, F.col("gt") == 0).where("gt != 0 and d is not null")
    rows = far.withColumn("bin", F.least(F.floor(F.col("d") / (1.01 / bins)), F.lit(bins - 1)).cast("int"))
    return counts_in_bins(rows, ["img"], [c for c in classes if c != 0], bins)


def rolled_up(counts: DataFrame, group: int = 4) -> DataFrame:
    """(bins, bin, mean_dice): the classes' mean Dice of each bin of counts, without an epsilon, and of bins joined by group."""
    counts = materialise(counts, "counts")  # a row for each class and bin
    sums = [F.sum(c).alias(c) for c in ("inter", "pred_sum", "gt_sum")]
    coarse = counts.groupBy("cls", F.floor(F.col("bin") / group).cast("int").alias("bin")).agg(*sums)
    plain = counts.groupBy("bin").agg(F.avg(F.try_divide(2 * F.col("inter"), F.col("pred_sum") + F.col("gt_sum"))).alias("mean_dice"))
    joined = coarse.groupBy("bin").agg(F.avg(dice(F.col("inter"), F.col("pred_sum"), F.col("gt_sum"))).alias("mean_dice"))
    return plain.select(F.lit(12).alias("bins"), "bin", "mean_dice").unionByName(joined.select(F.lit(12 // group).alias("bins"), "bin", "mean_dice"))


def temporal_consistency(labels: DataFrame, flow: DataFrame, classes: Sequence[int], ignore: Sequence[int] = ()) -> DataFrame:
    """(video, n_pairs, consistency): mean over consecutive frames of the classes' mean IoU with the frame before, warped.

    labels (video, frame_id, x, y, v); flow (video, frame_id, x, y, dx, dy) leads from a frame to the one before. Class 0
    and ignored classes don't count, nor pairs of frames without any other. Cells are dealt once, as tiles; the warp moves
    their bytes, and counts leave it.
    """
    img = F.struct("video", "frame_id").alias("img")
    now, led = labels.select(img, "x", "y", "v"), flow.select(img, "x", "y", "dx", "dy", F.lit(1).alias("there"))
    side = lambda df: df.groupBy("img").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    own = side(now).unionByName(side(led)).select("img", F.col("img.video").alias("video"), "x", "y")
    whole = own.groupBy("video").agg(*[(F.max(c) + 1).cast("int").alias(n) for c, n in (("x", "iw"), ("y", "ih"))])
    sides = materialise(own.select("img", "video").distinct().join(whole, "video").select("img", "iw", "ih"), "sides")  # a row for each frame
    held = materialise(tiles.from_cells(now, sides, kind="i4", empty=-1), "labels")
    seen = held.withColumn("img", F.struct("img.video", (F.col("img.frame_id") + 1).alias("frame_id")))
    after = sides.select(F.struct("img.video", (F.col("img.frame_id") + 1).alias("frame_id")).alias("img"))
    known = tiles.from_cells(led, sides.join(after, "img", "left_semi"), ("dx", "dy", "there"), kind="f8")
    counted = tiles.confusion(tiles.warp_labels(seen, known, kind="i4", flow_kind="f8"), held)
    counts = class_counts(counted, [c for c in classes if c not in (0, *ignore)], "img")
    union = F.col("pred_sum") + F.col("gt_sum") - F.col("inter")
    per_pair = counts.where(union > 0).groupBy("img").agg(F.avg(F.col("inter") / union).alias("iou"))
    return per_pair.groupBy(F.col("img.video").alias("video")).agg(F.count("*").alias("n_pairs"), F.avg("iou").alias("consistency"))


def robust_flags(df: DataFrame, key: str, value: str, factor: float = 3.0) -> DataFrame:
    """df's key and value with flags: far from the key's lower median by mean + factor sample deviations, and by MAD.

    motion: |v - median| > avg(|v - median|) + factor * stddev_samp of it; mad: value > median + 50 (MAD + 1e-6).
    """
    away = df.join(lower_median(df, value, key), key).withColumn("away", F.abs(F.col(value) - F.col("med")))
    stats = away.groupBy(key).agg(F.avg("away").alias("mean"), F.stddev_samp("away").alias("sd")).join(lower_median(away, "away", key, name="mad"), key)
    rows = away.join(stats, key)
    return rows.withColumn("motion", F.coalesce(F.col("away") > F.col("mean") + factor * F.col("sd"), F.lit(False))).withColumn("outlier", F.col(value) > F.col("med") + 50 * (F.col("mad") + 1e-6))


def latency_summary(df: DataFrame, ms: str, *keys: str) -> DataFrame:
    """Mean, population deviation, extremes, interpolated percentiles, and frames a second of mean and p95."""
    by = df.groupBy(*keys).agg(F.count(ms).alias("n"), F.round(F.avg(ms), 3).alias("mean"), F.round(F.stddev_pop(ms), 3).alias("std"), F.min(ms).alias("least"), F.max(ms).alias("most"), F.avg(ms).alias("exact"))
    out = by.join(percentiles(df, ms, (0.5, 0.9, 0.95, 0.99), *keys).drop("n"), list(keys), "left")
    named = [F.round(F.col("q")[i], 3).alias(f"p{p}") for i, p in enumerate((50, 90, 95, 99))]
    fps = lambda x: F.round(F.coalesce(F.try_divide(F.lit(1000.0), x), F.lit(0.0)), 3)
    return out.select(*keys, "n", "mean", "std", "least", "most", *named, fps(F.col("exact")).alias("fps_mean"), fps(F.col("q")[2]).alias("fps_p95"))


def majority_votes(images: DataFrame, key: str, order: Sequence[Column], pixel: str, first: int = 5) -> DataFrame:
    """(key, pixel, votes, mask): 255 where at least (n + 1) div 2 of a key's first n images hold the pixel."""
    picked = images.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rn") <= first)
    n = picked.groupBy(key).agg(F.count("*").alias("n"))
    votes = picked.groupBy(key, pixel).agg(F.count("*").alias("votes")).join(n, key)
    return votes.select(key, pixel, "votes", F.when(F.col("votes") >= F.floor((F.col("n") + 1) / 2), 255).otherwise(0).alias("mask"))


def presence(df: DataFrame, key: str, label: str, labels: Sequence[str]) -> DataFrame:
    """A boolean column per label: whether the key has it."""
    return df.groupBy(key).agg(*[F.coalesce(F.bool_or(F.col(label) == x), F.lit(False)).alias(f"has_{x}") for x in labels])
