"""Raster operators as tables of pixels (img, x, y, v), with an Arrow form over packed images where noted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.parsing import padded
from framelake.operators import geometry, images, tiles
from framelake.operators.joins import gather


def grid(width: int, height: int, spark) -> DataFrame:
    """(x, y) of all places of an image."""
    return spark.range(width * height).select((F.col("id") % width).cast("int").alias("x"), F.floor(F.col("id") / width).cast("int").alias("y"))


def warp_nearest(src: DataFrame, dx: int, dy: int, width: int, height: int) -> DataFrame:
    """src moved by whole pixels, zero where nothing comes from; images keep the places they have."""
    moved = src.select("img", (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), F.col("v").alias("moved"))
    rows = src.select("img", "x", "y").join(moved, ["img", "x", "y"], "left")
    return rows.where((F.col("x") < width) & (F.col("y") < height)).select("img", "x", "y", F.coalesce("moved", F.lit(0)).cast("bigint").alias("v"))


def sampled(places: DataFrame, source: DataFrame, u: Column, v: Column, mode: str = "nearest", edge: DataFrame | None = None) -> DataFrame:
    """places (img, x, y, ...) with v: their image's value in source (img, x, y, v) at (u, v), which needn't be whole.

    nearest rounds half to even; bilinear weighs the four cells around. What lies outside, or has no cell, counts as 0;
    with edge (img, w, h), the sizes of the images, places are moved to the nearest one inside first.
    """
    rows = places.withColumn("_u", u.cast("double")).withColumn("_v", v.cast("double"))
    if edge is not None:
        rows = rows.join(edge.select("img", F.col("w").alias("_w"), F.col("h").alias("_h")), "img")
        inside = lambda c, most: F.greatest(F.lit(0.0), F.least(F.col(c), F.col(most) - 1.0))
        rows = rows.withColumn("_u", inside("_u", "_w")).withColumn("_v", inside("_v", "_h")).drop("_w", "_h")
    if mode == "nearest":
        return gather(rows, source, F.rint("_u"), F.rint("_v")).drop("_u", "_v")
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])).alias("_c")
    rows = rows.withColumn("_bu", F.floor("_u")).withColumn("_bv", F.floor("_v")).select("*", corner)
    weight = F.abs(1 - F.col("_c.i") - (F.col("_u") - F.col("_bu"))) * F.abs(1 - F.col("_c.j") - (F.col("_v") - F.col("_bv")))
    rows = rows.withColumn("_weight", weight).where("_weight > 0")
    hit = gather(rows, source, F.col("_bu") + F.col("_c.i"), F.col("_bv") + F.col("_c.j"), "_value")
    return hit.groupBy(*places.columns).agg(F.sum(F.col("_weight") * F.col("_value")).alias("v"))


def _as_tiles(source: DataFrame, sizes: DataFrame) -> DataFrame:
    return tiles.from_cells(source.select("img", "x", "y", "v"), sizes, kind="f8")


def _as_cells(made: DataFrame, source: DataFrame, mode: str) -> DataFrame:
    kind = source.schema["v"].dataType if mode == "nearest" else "double"
    return tiles.to_cells(made, kind="f8").select("img", "x", "y", F.col("v").cast(kind).alias("v"))


def warp(source: DataFrame, transforms: DataFrame, width: int, height: int, mode: str = "nearest") -> DataFrame:
    """(img, x, y, v): each image of source (img, x, y, v) under its transform (img, h00..h22), on width x height places.

    Each place takes the value from where the inverse sends it; a singular transform gives an image of zeros. Cells are
    dealt once, as tiles, and what is moved for the warp are their bytes.
    """
    spans = source.groupBy("img").agg((F.max("x") + 1).cast("int").alias("iw"), (F.max("y") + 1).cast("int").alias("ih"))
    known = transforms.select("img").distinct().join(spans, "img", "left").select("img", *[F.greatest(F.coalesce(c, F.lit(1)), F.lit(1)).alias(c) for c in ("iw", "ih")])
    return _as_cells(tiles.warp(_as_tiles(source, known), transforms, width, height, mode, kind="f8"), source, mode)


def resize(source: DataFrame, sizes: DataFrame, width: int, height: int, mode: str = "nearest", align_corners: bool = False) -> DataFrame:
    """(img, x, y, v): images of source (img, x, y, v), of the sizes (img, w, h), on width x height places.

    nearest takes the place whose share of the side is as large, cut to whole numbers; bilinear maps the pixels' middles,
    or with align_corners the outermost pixels, onto each other, and the edge goes on outside.
    """
    own = sizes.select("img", F.col("w").cast("int").alias("iw"), F.col("h").cast("int").alias("ih"))
    return _as_cells(tiles.resize(_as_tiles(source, own), width, height, mode, align_corners, kind="f8"), source, mode)


def warp_labels(labels: DataFrame, flow: DataFrame) -> DataFrame:
    """(img, x, y, label): labels (img, x, y, v) of the frame before at the places to which flow (img, x, y, dx, dy) leads.

    Each class has the bilinear weight of its cells among the four; the heaviest class wins, ties to the smallest, and
    places that reach no cell are class 0.
    """
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])).alias("c")
    at = flow.select("img", "x", "y", (F.col("x") + F.col("dx")).alias("u"), (F.col("y") + F.col("dy")).alias("v")).select("*", corner)
    weight = F.abs(1 - F.col("c.i") - (F.col("u") - F.floor("u"))) * F.abs(1 - F.col("c.j") - (F.col("v") - F.floor("v")))
    at = at.select("img", "x", "y", (F.floor("u") + F.col("c.i")).alias("sx"), (F.floor("v") + F.col("c.j")).alias("sy"), weight.alias("weight"))
    hit = at.join(labels.select("img", F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("v").alias("cls")), ["img", "sx", "sy"], "left")
    by = hit.groupBy("img", "x", "y", F.coalesce("cls", F.lit(0)).alias("cls")).agg(F.round(F.sum("weight"), 9).alias("weight"))
    return by.groupBy("img", "x", "y").agg(F.max_by("cls", F.struct("weight", -F.col("cls"))).alias("label"))


def chebyshev(cells: DataFrame, seeds: Column, most: int) -> DataFrame:
    """cells with d: the Chebyshev distance to the nearest seed cell, null beyond most."""
    near = images.by_image(cells.withColumn("_seed", F.coalesce(seeds, F.lit(False))), ["_seed"], lambda p, there: {"d": images.square_distance(p["_seed"], most)}, "d double")
    return near.withColumn("d", F.col("d").cast("int")).drop("_seed")


def ground_distance(cells: DataFrame, ground: Column) -> DataFrame:
    """cells with d: the Euclidean distance to their image's nearest cell of ground, over the image's largest (plus 1e-12).

    null in images without such a cell. The distance is exact, where a chamfer approximates it.
    """

    def share(p, there):
        d = images.plain_distance(p["_ground"])
        return {"d": np.where(np.isfinite(d), d / (d[there].max() + 1e-12), np.nan)}

    return images.by_image(cells.withColumn("_ground", F.coalesce(ground, F.lit(False))), ["_ground"], share, "d double").drop("_ground")


def ramp(d: Column, radius: int) -> Column:
    """1 on the mask and next to it, falling by 1/radius a step, 0 beyond radius."""
    value = (F.lit(radius) - F.greatest(d, F.lit(1)) + 1) / F.lit(float(radius))
    return F.when(d.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def paste(canvas: DataFrame, warped: DataFrame, only_new: bool = False) -> DataFrame:
    """(img, x, y, v, part): canvas (v) and warped (v, alpha) joined: blended where both are, else whichever is there.

    part: overlap, only_new or kept. only_new leaves the overlap as it is.
    """
    c = canvas.select("img", "x", "y", F.col("v").alias("cv"))
    w = warped.select("img", "x", "y", F.col("v").alias("wv"), "alpha")
    both = c.join(w, ["img", "x", "y"], "full_outer")
    part = F.when(F.col("cv").isNull(), "only_new").when(F.col("wv").isNull(), "kept").otherwise("overlap")
    blend = F.col("cv") if only_new else F.col("cv") * (1 - F.col("alpha")) + F.col("wv") * F.col("alpha")
    return both.select("img", "x", "y", F.when(part == "overlap", blend).when(part == "kept", F.col("cv")).otherwise(F.col("wv")).alias("v"), part.alias("part"))


def morph(cells: DataFrame, radius: int, largest: bool) -> DataFrame:
    """Dilation (largest) or erosion of v by a square; places that lack don't count."""

    def run(p, there):
        v = np.where(there, p["v"].astype(float), -np.inf if largest else np.inf)
        return {"m": images.spread(v, radius, np.maximum if largest else np.minimum)}

    out = images.by_image(cells.select("img", "x", "y", "v"), ["v"], run, "m double")
    return out.select("img", "x", "y", F.col("m").cast(cells.schema["v"].dataType).alias("v"))


def laplacian_variance(cells: DataFrame) -> DataFrame:
    """(img, blur): population variance of the 4-neighbour Laplacian, places outside counting as zero."""
    return images.by_image(cells.select("img", "x", "y", "v"), ["v"], lambda p, there: {"lap": images.laplacian(p["v"])}, "lap double").groupBy("img").agg(F.var_pop("lap").alias("blur"))


def complement(mask: Column) -> Column:
    """255 where a mask is 0, else 0."""
    return F.when(mask == 0, 255).otherwise(0)


def vignette(x: Column, y: Column, v: Column, width: int, height: int, sigma: float = 0.95) -> Column:
    """v plus what an image's dark rim lacks: clamp((1 - g)^2 64, 0, 128), within 0 to 255; g is 1 where it is largest."""
    u, w = 2.0 * x / F.lit(width - 1) - 1.0, 2.0 * y / F.lit(height - 1) - 1.0
    middle = sum((1 - n % 2) / (n - 1) ** 2 for n in (width, height))  # an even side has no place in its middle
    g = F.exp((F.lit(middle) - u * u - w * w) / F.lit(2 * sigma * sigma))
    add = F.greatest(F.lit(0.0), F.least(F.lit(128.0), (1 - g) * (1 - g) * 64.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), v + add))


def joined_masks(*shares: Column, least: float = 0.5) -> Column:
    """Whether any of several masks' values is over least; those that lack don't count."""
    out = F.lit(False)
    for share in shares:
        out = out | F.coalesce(share.cast("double") > least, F.lit(False))
    return out


def palette(cls: Column) -> tuple[Column, Column, Column]:
    """Colours of a class. 41, 73; 17, 131; 89, 29."""
    return tuple(F.pmod(a * cls + b, F.lit(256)) for a, b in ((41, 73), (17, 131), (89, 29)))


def overridden(logit: Column, cls: Column, masked_cls: Column, mode: str) -> Column:
    """A class's output where a mask claims a pixel for masked_cls (null: no claim).

    logits: the claimed channel becomes 255, and 0 outside its mask; sigmoid: the claimed channel is set to 1;
    softmax: the pixel becomes one-hot.
    """
    own = cls == masked_cls
    if mode == "logits":
        return F.when(own, 255.0).otherwise(F.when(cls == 0, logit).otherwise(F.when(masked_cls.isNull(), logit).otherwise(0.0)))
    if mode == "sigmoid":
        return F.when(own, 1.0).otherwise(logit)
    return F.when(masked_cls.isNull(), logit).otherwise(F.when(own, 1.0).otherwise(0.0))


def gray(r: Column, g: Column, b: Column, luma: bool = True) -> Column:
    """Luma (0.299, 0.587, 0.114) or the mean of the channels."""
    return 0.299 * r + 0.587 * g + 0.114 * b if luma else (r + g + b) / 3.0


def components(cells: DataFrame) -> DataFrame:
    """cells (img, x, y) with component, struct(img, x, y): the first cell, by y and x, of those reachable over 8 neighbours."""

    def run(p, there):
        first = images.first_cells(there)
        x0, y0 = p["x"][there].min(), p["y"][there].min()
        return {"_fx": first % there.shape[1] + x0, "_fy": first // there.shape[1] + y0}

    out = images.by_image(cells, ["x", "y"], run, "_fx long, _fy long")
    return out.withColumn("component", F.struct("img", F.col("_fx").alias("x"), F.col("_fy").alias("y"))).drop("_fx", "_fy")


def warped(image: np.ndarray, m: np.ndarray, width: int, height: int, mode: str = "nearest") -> np.ndarray | None:
    """An image under a transform, on width x height places, 0 where nothing comes from; None for a singular one."""
    if abs(np.linalg.det(m)) < 1e-12:
        return None
    y, x = np.mgrid[:height, :width]
    u, v, w = np.tensordot(np.linalg.inv(m), np.stack((x, y, np.ones_like(x))).astype(float), 1)
    w = np.maximum(w, 1e-8)
    u, v = u / w, v / w
    h0, w0 = image.shape

    def at(sx: np.ndarray, sy: np.ndarray) -> np.ndarray:
        ok = (sx >= 0) & (sx < w0) & (sy >= 0) & (sy < h0)
        return np.where(ok, image[sy.clip(0, h0 - 1).astype(int), sx.clip(0, w0 - 1).astype(int)], 0)

    if mode == "nearest":
        return at(np.rint(u), np.rint(v))
    bu, bv = np.floor(u), np.floor(v)
    return sum(np.abs(1 - i - (u - bu)) * np.abs(1 - j - (v - bv)) * at(bu + i, bv + j) for i in (0, 1) for j in (0, 1))


def warp_packed(images_: DataFrame, mode: str = "nearest") -> DataFrame:
    """images (img, h, w, pixels binary of h x w bytes, h00..h22) with warped: samples at the inverse's places."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                m = np.array([getattr(r, n) for n in geometry.NAMES], float).reshape(3, 3)
                image = warped(np.frombuffer(r.pixels, "u1").reshape(r.h, r.w), m, r.w, r.h, mode)
                out.append(None if image is None else np.rint(image).astype("u1").tobytes())
            yield pd.DataFrame({"img": pdf["img"], "h": pdf["h"], "w": pdf["w"], "warped": out})

    return images_.mapInPandas(run, f"img {images_.schema['img'].dataType.simpleString()}, h int, w int, warped binary")


def pack(cells: DataFrame, width: int, height: int) -> DataFrame:
    """(img, h, w, pixels): an image's cells (v from 0 to 255) as bytes, zero where cells lack."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((height, width), "u1")
        image[pdf["y"], pdf["x"]] = pdf["v"]
        return pd.DataFrame({"img": [pdf["img"].iat[0]], "h": height, "w": width, "pixels": [image.tobytes()]})

    kind = cells.schema["img"].dataType.simpleString()
    return cells.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)).groupBy("img").applyInPandas(run, f"img {kind}, h int, w int, pixels binary")


membrane = images.membrane


def membrane_pasted(cells: DataFrame, rounds: int = 50) -> DataFrame:
    """cells (img, x, y, canvas, patch, mask) with v: patch pasted where mask is set, its edge's difference spread inwards."""
    return images.by_image(cells, ["canvas", "patch", "mask"], lambda p, there: {"v": images.membrane(p["canvas"], p["patch"], p["mask"], rounds)}, "v double")


def pyramid_levels(cells: DataFrame, levels: int = 3) -> DataFrame:
    """cells (img, x, y, v) with low, the coarsest level of the Gaussian pyramid brought back to full size, and high, what it lacks of v."""

    def run(p, there):
        low, shapes = p["v"].astype(float), []
        for _ in range(levels - 1):
            shapes.append(low.shape)
            low = images.halved(low)
        for shape in reversed(shapes):
            low = images.doubled(low, shape)
        return {"low": low, "high": p["v"] - low}

    return images.by_image(cells, ["v"], run, "low double, high double")


def multiband_pasted(cells: DataFrame, levels: int = 3) -> DataFrame:
    """cells (img, x, y, canvas, patch, mask) with v: patch pasted by bands, each of them blended under the mask of its level."""
    f = lambda p, there: {"v": images.multiband(p["canvas"].astype(float), p["patch"].astype(float), p["mask"].astype(float), levels)}  # noqa: E731, ARG005
    return images.by_image(cells, ["canvas", "patch", "mask"], f, "v double")


def grown_boxes(cells: DataFrame, box: tuple[int, int, int, int], valid: Column, passes: int = 10) -> DataFrame:
    """(img, x1, y1, x2, y2): each image's box grown over rows and columns that are valid all along; places as cells give them."""

    def run(p, there):
        x0, y0 = int(p["x"][there].min()), int(p["y"][there].min())
        grown = grown_box(p["_valid"], (box[0] - x0, box[1] - y0, box[2] - x0, box[3] - y0), passes)
        return {n: np.full(there.shape, v + o) for n, v, o in zip(("x1", "y1", "x2", "y2"), grown, (x0, y0, x0, y0))}

    rows = cells.select("img", "x", "y", F.coalesce(valid, F.lit(False)).alias("_valid"))
    return images.by_image(rows, ["x", "y", "_valid"], run, "x1 long, y1 long, x2 long, y2 long").groupBy("img").agg(*[F.first(c).alias(c) for c in ("x1", "y1", "x2", "y2")])


def padded_image(source: DataFrame, sizes: DataFrame, multiple: int = 8) -> DataFrame:
    """(img, x, y, v): images of source, of the sizes (img, w, h), with their edges repeated so that multiple divides both sides."""
    (left, right), (top, bottom) = padded(F.col("w"), multiple), padded(F.col("h"), multiple)
    rows = sizes.select("img", left.alias("left"), top.alias("top"), F.explode(F.sequence(F.lit(0), F.col("h") + top + bottom - 1)).alias("y"), (F.col("w") + left + right - 1).alias("last"))
    rows = rows.select("img", "left", "top", "y", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("x"))
    return sampled(rows, source, F.col("x") - F.col("left"), F.col("y") - F.col("top"), "nearest", sizes).select("img", "x", "y", "v")


def unpadded_image(cells: DataFrame, sizes: DataFrame, multiple: int = 8) -> DataFrame:
    """What padded_image() made, without what it added."""
    (left, _), (top, _) = padded(F.col("w"), multiple), padded(F.col("h"), multiple)
    rows = cells.join(sizes, "img").withColumn("x", F.col("x") - left).withColumn("y", F.col("y") - top)
    return rows.where("x between 0 and w - 1 and y between 0 and h - 1").select("img", "x", "y", "v")


def boxes(cells: DataFrame) -> DataFrame:
    """(img, component, x1, y1, x2, y2, n, cx, cy) of each connected set of cells."""
    mid = lambda c: F.avg(F.col(c).cast("double"))
    return components(cells).groupBy("img", "component").agg(F.min("x").alias("x1"), F.min("y").alias("y1"), (F.max("x") + 1).alias("x2"), (F.max("y") + 1).alias("y2"), F.count("*").alias("n"), mid("x").alias("cx"), mid("y").alias("cy"))


def regions(cells: DataFrame) -> DataFrame:
    """(img, x1, y1, x2, y2, n, radius) of each image's cells: their box, number, and the radius of a disc as large."""
    return cells.groupBy("img").agg(F.min("x").alias("x1"), F.min("y").alias("y1"), (F.max("x") + 1).alias("x2"), (F.max("y") + 1).alias("y2"), F.count("*").alias("n"), F.sqrt(F.count("*") / F.pi()).alias("radius"))


def grown_box(valid: np.ndarray, box: tuple[int, int, int, int], passes: int = 10) -> tuple[int, int, int, int]:
    """box (x1, y1, x2, y2) grown by whole rows and columns that are valid all along: left, right, up, down, in turn.

    Each step sees the edges that those before it moved.
    """
    x1, y1, x2, y2 = box
    h, w = valid.shape
    for _ in range(passes):
        old = (x1, y1, x2, y2)
        while x1 > 0 and valid[y1:y2, x1 - 1].all():
            x1 -= 1
        while x2 < w and valid[y1:y2, x2].all():
            x2 += 1
        while y1 > 0 and valid[y1 - 1, x1:x2].all():
            y1 -= 1
        while y2 < h and valid[y2, x1:x2].all():
            y2 += 1
        if (x1, y1, x2, y2) == old:
            break
    return x1, y1, x2, y2


def scope_circle(cells: DataFrame, least: int = 15, trim: int = 4, radius: int = 4) -> DataFrame:
    """(img, cx, cy, r): the smallest circle around the largest lit set of each image, less a trim.

    Lit is v over least, after opening and closing by a square of radius (4: a 5 x 5 one, twice). Images with nothing lit
    have no row.
    """

    def run(p, there):
        found = images.scope(p["v"], there, least, radius)
        return {n: np.full(there.shape, np.nan if found is None else found[i] + o) for i, (n, o) in enumerate((("cx", p["x"][there].min()), ("cy", p["y"][there].min()), ("r", -trim)))}

    rows = images.by_image(cells.select("img", "x", "y", "v"), ["x", "y", "v"], run, "cx double, cy double, r double")
    return rows.groupBy("img").agg(*[F.first(c).alias(c) for c in ("cx", "cy", "r")]).where("r is not null")


def outside_circle(cells: DataFrame, circle: DataFrame) -> DataFrame:
    """cells with masked: whether they lie outside their image's circle."""
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    return cells.join(circle, "img").withColumn("masked", F.round(dx * dx + dy * dy, 4) > F.round(F.col("r") * F.col("r"), 4)).drop("cx", "cy", "r")


def cropped_boxes(masks: DataFrame) -> DataFrame:
    """masks (img, h, w, mask, mode, x1, y1, x2, y2 and maybe fx1..fy2) with cx1, cy1, cx2, cy2, the crop of each canvas.

    mask holds h x w bytes, where the canvas is painted; x1..y2 are the projected frame's sides, fx1..fy2 those of a video's
    first frame. internal: the projected box, grown while it is painted, if all of it is; external: the box around all that
    is painted, or the projected one if nothing is; entire: the canvas; first: the first frame's box; else the projected one.
    Boxes are cut to the canvas; an empty one gives the whole canvas, sides that lack give none.
    """
    names, columns = ("cx1", "cy1", "cx2", "cy2"), masks.columns

    def box(r: dict) -> tuple[int, int, int, int] | None:
        w, h, mode = r["w"], r["h"], r["mode"]
        sides = [r.get(c) for c in ("fx1", "fy1", "fx2", "fy2")] if mode == "first" else [None]
        sides = [r[c] for c in ("x1", "y1", "x2", "y2")] if None in sides else sides
        known = None not in sides and all(np.isfinite(s) for s in sides)
        x1, y1, x2, y2 = (max(0, int(np.floor(sides[0]))), max(0, int(np.floor(sides[1]))), min(w, int(np.ceil(sides[2]))), min(h, int(np.ceil(sides[3])))) if known else (0, 0, 0, 0)
        painted = None if r["mask"] is None else np.frombuffer(r["mask"], "u1").reshape(h, w) > 0
        if mode == "entire":
            return 0, 0, w, h
        if mode == "external" and painted is not None and painted.any():
            ys, xs = np.flatnonzero(painted.any(axis=1)), np.flatnonzero(painted.any(axis=0))
            return int(xs[0]), int(ys[0]), int(xs[-1]) + 1, int(ys[-1]) + 1
        if not known:
            return None
        if x2 <= x1 or y2 <= y1:
            return 0, 0, w, h
        if mode == "internal" and painted is not None and painted[y1:y2, x1:x2].all():
            return grown_box(painted, (x1, y1, x2, y2))
        return x1, y1, x2, y2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [box(r) or (None,) * 4 for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([f[i] for f in found], pa.int32()) for i in range(4))], [*columns, *names])

    return masks.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in masks.schema) + ", cx1 int, cy1 int, cx2 int, cy2 int")
