"""Keypoints: local maxima, thresholds, top-k, sub-pixel refinement, descriptors, assignment.

A score map is a table (img, x, y, s) with one row for each cell that has a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.operators import images


def suppress(cells: DataFrame, radius: int, recoveries: int = 2) -> DataFrame:
    """cells with kept: local maxima (ties all stay), then those that are maxima once the kept ones' surroundings are out."""
    return images.by_image(cells, ["s"], lambda p, there: {"kept": images.kept_maxima(p["s"], there, radius, recoveries)}, "kept boolean")


def inside(x: Column, y: Column, width: int, height: int, border: int) -> Column:
    """Whether a place keeps border from each side."""
    return (x >= border) & (x < width - border) & (y >= border) & (y < height - border)


def threshold_or_mean(rows: DataFrame, key: str, score: str, least: float) -> DataFrame:
    """Rows with a score over least; in keys where none is, those over the key's mean score."""
    w = Window.partitionBy(key)
    any_ = F.max(F.when(F.col(score) > least, 1).otherwise(0)).over(w)
    cut = F.when(any_ == 1, F.lit(least)).otherwise(F.avg(score).over(w))
    return rows.withColumn("_cut", cut).where(F.col(score) > F.col("_cut")).drop("_cut")


def top_k(rows: DataFrame, key: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each key in the order, with rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def soft_argmax(cells: DataFrame, radius: int, temperature: float = 0.1) -> DataFrame:
    """(img, x, y, ox, oy, spread): offsets of the softmax's centre of mass, and its mean squared distance from there."""
    of = lambda p, there: dict(zip(("ox", "oy", "spread"), images.centres_of_mass(p["s"], there, radius, temperature)))
    return images.by_image(cells.select("img", "x", "y", "s"), ["s"], of, "ox double, oy double, spread double").drop("s")


def bilinear(points: DataFrame, cells: DataFrame) -> DataFrame:
    """points (id, img, px, py) with value: the four cells around each, weighted; cells that lack count as 0."""
    corners = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])).alias("c")
    base = points.withColumn("bx", F.floor("px")).withColumn("by", F.floor("py")).select("*", corners)
    weight = F.abs(1 - F.col("c.i") - (F.col("px") - F.col("bx"))) * F.abs(1 - F.col("c.j") - (F.col("py") - F.col("by")))
    at = base.select("id", "img", "px", "py", (F.col("bx") + F.col("c.i")).cast("int").alias("x"), (F.col("by") + F.col("c.j")).cast("int").alias("y"), weight.alias("w"))
    hit = at.join(cells.select("img", "x", "y", F.col("s").cast("double").alias("s")), ["img", "x", "y"], "left")
    return hit.groupBy("id", "img", "px", "py").agg(F.sum(F.col("w") * F.coalesce("s", F.lit(0.0))).alias("value"))


def root_normalised(x: Column, eps: float = 1e-6) -> Column:
    """L1-normalised, clipped below at eps, square roots, L2-normalised.

    Sums and arrays are bound to names, so that they are made once for a row and not once for each of its components.
    """
    bound = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)
    add = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, v: s + f(v))
    least = lambda c: F.greatest(c, F.lit(1e-12))
    one = bound(least(add(x, lambda u: F.abs(u.cast("double")))), lambda n: F.transform(x, lambda v: v.cast("double") / n))
    root = F.transform(one, lambda v: F.sqrt(F.greatest(v, F.lit(eps))))
    return bound(root, lambda r: bound(least(F.sqrt(add(r, lambda u: u * u))), lambda n: F.transform(r, lambda v: v / n)))


def assignments(prev: DataFrame, curr: DataFrame, pair: str, *, dustbin: bool = True, least: float | None = None) -> DataFrame:
    """(pair, i, j, log_p) of keypoints (pair, id, descriptor, z): log-softmax over i and over j plus both sides' gates.

    Similarities are inner products over the square root of the descriptors' length, gates the log-sigmoid of z. With
    dustbin there are rows with i or j null: the log-probability that a keypoint matches none, from its gate alone. A
    pair's sides are two frames' keypoints: one product of matrices in a task. With least only rows of at least that
    log-probability leave it.
    """

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        found = []
        if a.num_rows and b.num_rows:
            log_p = _log_assignment(a, b)
            i, j = np.nonzero(log_p >= least) if least is not None else (np.repeat(np.arange(len(log_p)), log_p.shape[1]), np.tile(np.arange(log_p.shape[1]), len(log_p)))
            found = [(pa.array(a["id"].to_numpy()[i]), pa.array(b["id"].to_numpy()[j]), pa.array(log_p[i, j]))]
        if dustbin:
            none = lambda t: pa.nulls(t.num_rows, pa.int64())
            found += [(a["id"].combine_chunks().cast(pa.int64()), none(a), pa.array(-np.logaddexp(0, a["z"].to_numpy()))), (none(b), b["id"].combine_chunks().cast(pa.int64()), pa.array(-np.logaddexp(0, b["z"].to_numpy())))]
        key = (a if a.num_rows else b)[pair][0]
        tables = [pa.table([pa.array([key.as_py()] * len(p), key.type), i, j, p], [pair, "i", "j", "log_p"]) for i, j, p in found]
        return pa.concat_tables(tables) if tables else pa.table([pa.array([], key.type), *(pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64()))], [pair, "i", "j", "log_p"])

    a, b = _sides(prev, curr, pair)
    return a.cogroup(b).applyInArrow(run, f"{pair} {prev.schema[pair].dataType.simpleString()}, i long, j long, log_p double")


def best_assignments(prev: DataFrame, curr: DataFrame, pair: str) -> DataFrame:
    """(pair, i, j, best, mass, unmatched): of each keypoint of prev what assignments() says, a row each leaving the task.

    j is its best partner, the one of the smaller id of several, best that log-probability, mass the sum of all
    probabilities, unmatched the log-probability of having no partner. Keypoints of pairs without another side are left out.
    """

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
        names = [pair, "i", "j", "best", "mass", "unmatched"]
        if not (a.num_rows and b.num_rows):
            return pa.table([(a if a.num_rows else b)[pair].slice(0, 0), *(pa.array([], t) for t in kinds)], names)
        b = b.sort_by("id")
        log_p = _log_assignment(a, b)
        at = log_p.argmax(axis=1)
        columns = (a["id"].to_numpy(), b["id"].to_numpy()[at], log_p.max(axis=1), np.exp(log_p).sum(axis=1), -np.logaddexp(0, a["z"].to_numpy()))
        return pa.table([a[pair], *(pa.array(c, t) for c, t in zip(columns, kinds))], names)

    a, b = _sides(prev, curr, pair)
    return a.cogroup(b).applyInArrow(run, f"{pair} {prev.schema[pair].dataType.simpleString()}, i long, j long, best double, mass double, unmatched double")


def _sides(prev: DataFrame, curr: DataFrame, pair: str) -> list:
    return [side.select(F.col(pair).alias(pair), F.col("id").cast("long").alias("id"), F.col("descriptor").alias("descriptor"), F.col("z").cast("double").alias("z")).groupBy(pair) for side in (prev, curr)]


def _log_assignment(a: pa.Table, b: pa.Table) -> np.ndarray:
    """Log-softmax over both sides plus both gates, of all keypoints of two frames."""
    x, y = matrix(a["descriptor"]), matrix(b["descriptor"])
    s = x @ y.T / np.sqrt(x.shape[1])
    norm = lambda axis: s.max(axis, keepdims=True) + np.log(np.exp(s - s.max(axis, keepdims=True)).sum(axis, keepdims=True))
    z0, z1 = a["z"].to_numpy(), b["z"].to_numpy()
    return 2 * s - norm(1) - norm(0) - np.logaddexp(0, -z0)[:, None] - np.logaddexp(0, -z1)


def matrix(lists: pa.ChunkedArray) -> np.ndarray:
    """Descriptors of one length as rows."""
    column = lists.combine_chunks()
    return column.flatten().to_numpy().astype(float).reshape(len(column), -1)


def pruned(confidence: Column, matchability: Column, layer: int, layers: int, keep: float = 0.95) -> Column:
    """Whether a token stays: its matchability is over 1 - keep, or it isn't yet as sure as its layer asks (null: no such test)."""
    return (matchability > 1 - keep) | F.coalesce(confidence <= stop_threshold(F.lit(layer), layers), F.lit(False))


def fixed_length(values: Column, length: int, sentinel: float) -> Column:
    """An array cut or filled up with sentinel to length."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(sentinel), length)), 1, length)


def normalised_points(x: Column, y: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Points moved to the image's centre and divided by half its longer side."""
    half = F.greatest(width, height) / 2
    return (x - width / 2) / half, (y - height / 2) / half


def normalised(points: DataFrame, key: str, sizes: DataFrame | None = None) -> DataFrame:
    """points (key, x, y, ...) with nx, ny: normalised_points() by their image's size (key, w, h), or where it lacks by their range.

    The size that a range stands for is one more than the range.
    """
    side = lambda c: (1 + F.max(c) - F.min(c)).cast("double")
    own = points.groupBy(key).agg(side("x").alias("_w"), side("y").alias("_h"))
    if sizes is not None:
        given = sizes.select(key, F.col("w").cast("double").alias("_gw"), F.col("h").cast("double").alias("_gh"))
        own = own.join(given, key, "left").select(key, F.coalesce("_gw", "_w").alias("_w"), F.coalesce("_gh", "_h").alias("_h"))
    nx, ny = normalised_points(F.col("x"), F.col("y"), F.col("_w"), F.col("_h"))
    return points.join(own, key).withColumn("nx", nx).withColumn("ny", ny).drop("_w", "_h")


def scaled_back(place: Column, scale: Column) -> Column:
    """A place in a resized image, in the image that was resized by scale: middles of pixels stay middles."""
    return (place + 0.5) / scale - 0.5


def stop_threshold(layer: Column, layers: int) -> Column:
    """Confidence that a layer asks for: 0.8 + 0.1 exp(-4 layer / layers), within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.8 + 0.1 * F.exp(-4.0 * layer / F.lit(layers))))


def patches(points: DataFrame, cells: DataFrame, size: int, width: int, height: int) -> DataFrame:
    """(id, px, py, v): the size x size cells around each point (id, img, x, y), its corner clamped into the image."""
    low = lambda c, most: F.greatest(F.lit(0), F.least(F.col(c) - size // 2, F.lit(most - size)))
    offsets = F.explode(F.sequence(F.lit(0), F.lit(size * size - 1))).alias("k")
    at = points.select("id", "img", low("x", width).alias("x0"), low("y", height).alias("y0"), offsets)
    at = at.select("id", "img", (F.col("k") % size).cast("int").alias("px"), F.floor(F.col("k") / size).cast("int").alias("py"), (F.col("x0") + F.col("k") % size).cast("int").alias("x"), (F.col("y0") + F.floor(F.col("k") / size)).cast("int").alias("y"))
    return at.join(cells.select("img", "x", "y", "v"), ["img", "x", "y"], "left").select("id", "px", "py", F.coalesce("v", F.lit(0)).alias("v"))


def one_per_cell(points: DataFrame, img: str = "img") -> DataFrame:
    """Of the points (img, x, y, score, ori, ...) that round to one cell, that with the highest score, then least |ori|.

    Points equal in all that are told apart by x, y and then their other columns, the smallest first, so that reruns agree.
    """
    cell = [F.rint("x").cast("int"), F.rint("y").cast("int")]
    rest = [f"`{c}`" for c in points.columns if c not in (img, "x", "y", "score")]
    w = Window.partitionBy(img, *cell).orderBy(F.desc("score"), F.abs("ori"), "x", "y", *rest)
    return points.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def matched_points(matches: DataFrame, prev: DataFrame, curr: DataFrame, pair: str) -> DataFrame:
    """matches (pair, i, j) with both points' places: x, y of j in the current frame, u, v of i in the one before."""
    a = prev.select(pair, F.col("id").alias("i"), F.col("x").alias("u"), F.col("y").alias("v"))
    return matches.join(a, [pair, "i"]).join(curr.select(pair, F.col("id").alias("j"), "x", "y"), [pair, "j"])


def stops(tokens: DataFrame, pair: str, layer: int, layers: int, share: float = 0.95) -> DataFrame:
    """(pair, sure, stop): the share of tokens (confidence) over the layer's threshold, and whether that is enough."""
    sure = F.avg(F.when(F.col("confidence") >= stop_threshold(F.lit(layer), layers), 1.0).otherwise(0.0))
    return tokens.groupBy(pair).agg(sure.alias("sure")).withColumn("stop", F.col("sure") > share)
