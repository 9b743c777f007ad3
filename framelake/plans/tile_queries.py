"""Images of three channels as tiles, made of lineitem: one for each supplier."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators import geometry, paste, raster, tiles
from framelake.plans.registry import query, r6, table
from framelake.sources.scratch import materialise

WIDE, TALL, SIDE = 40, 24, 16


def photo_cells(spark: SparkSession, d: str) -> DataFrame:
    """(img, x, y, r, g, b): an image of 40 x 24 places, some of them empty, for each supplier."""
    x, y = (F.col("l_orderkey") % WIDE).cast("int"), (F.col("l_partkey") % TALL).cast("int")
    value = F.sum(F.col("l_quantity").cast("bigint") * 7 + F.col("l_linenumber") * 31) % 256
    cells = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("img"), x.alias("x"), y.alias("y")).agg(value.cast("int").alias("r"))
    return cells.select("*", ((F.col("r") * 3 + F.col("x")) % 256).alias("g"), (255 - F.col("r")).alias("b"))


def photo_tiles(spark: SparkSession, d: str, channels: int = 3) -> DataFrame:
    """photo_cells() as tiles: lineitem's rows are dealt once, by tile, and added up as the tiles are filled."""
    lineitem = table(spark, d, "lineitem")
    img = F.col("l_suppkey").alias("img")
    sizes = lineitem.select(img).distinct().select("img", F.lit(WIDE).alias("iw"), F.lit(TALL).alias("ih"))
    x, y = (F.col("l_orderkey") % WIDE).cast("int"), (F.col("l_partkey") % TALL).cast("int")
    rows = lineitem.select(img, x.alias("x"), y.alias("y"), (F.col("l_quantity").cast("bigint") * 7 + F.col("l_linenumber") * 31).alias("v"))

    def summed(totals: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:  # noqa: ARG001
        r = np.fmod(totals, 256)
        return [r, np.fmod(r * 3 + x, 256), 255 - r][:channels]

    return tiles.from_cells(rows, sizes, ("v",), SIDE, summed=summed)


def photos(spark: SparkSession, d: str) -> DataFrame:
    """photo_tiles(), made once: operators read their sides and their bytes apart."""
    return materialise(photo_tiles(spark, d), "photos")


PHOTOS = f"""
cells AS (SELECT l_suppkey AS img, l_orderkey % {WIDE} AS x, l_partkey % {TALL} AS y, CAST(sum(CAST(l_quantity AS BIGINT) * 7 + l_linenumber * 31) % 256 AS INTEGER) AS r FROM lineitem GROUP BY 1, 2, 3),
photo AS (SELECT img, x, y, c, CASE c WHEN 0 THEN r WHEN 1 THEN (r * 3 + x) % 256 ELSE 255 - r END AS v FROM cells, (SELECT unnest([0, 1, 2]) AS c)),
sizes AS (SELECT DISTINCT img FROM cells)"""
_CORNERS = "(SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)"


def _sql_places(width: int, height: int) -> str:
    return f"places AS (SELECT img, x, y, c FROM sizes, (SELECT unnest(range({width})) AS x), (SELECT unnest(range({height})) AS y), (SELECT unnest([0, 1, 2]) AS c))"


def _sql_bilinear(edge: bool) -> str:
    """hit (img, x, y, c, v) from spot (img, x, y, c, u, w): bilinear values; with edge, places are moved inside first."""
    u, w = (f"greatest(0, least({p}, {n - 1}))" if edge else p for p, n in (("u", WIDE), ("w", TALL)))
    return f"""near AS (SELECT img, x, y, c, {u} AS u, {w} AS w FROM spot),
    corner AS (SELECT img, x, y, c, floor(u) + i AS sx, floor(w) + j AS sy, abs(1 - i - (u - floor(u))) * abs(1 - j - (w - floor(w))) AS weight FROM near, {_CORNERS}),
    hit AS (SELECT a.img, a.x, a.y, a.c, coalesce(sum(a.weight * coalesce(p.v, 0)), 0) AS v FROM corner a LEFT JOIN photo p ON p.img = a.img AND p.x = a.sx AND p.y = a.sy AND p.c = a.c GROUP BY 1, 2, 3, 4)"""


_SUMS = "SELECT img, CAST(c AS INTEGER) AS c, CAST(round(sum(v), 3) AS DOUBLE) AS total, CAST(round(sum(v * (x + 1)), 3) AS DOUBLE) AS by_x, CAST(round(sum(v * (y + 1)), 3) AS DOUBLE) AS by_y FROM hit GROUP BY 1, 2"


def _sums(out: DataFrame, kind: str) -> DataFrame:
    """Moments of each image's channels, which any wrong place would change."""
    return tiles.moments(out, SIDE, kind).select("img", "c", *[F.round(c, 3).alias(c) for c in ("total", "by_x", "by_y")])


def _transforms(spark: SparkSession, d: str) -> DataFrame:
    """A turn, shear, growth, move and slant for each supplier; for some a transform without an inverse."""
    k, flat = F.col("l_suppkey"), F.col("l_suppkey") % 29 == 0
    h = (1 + (k % 5 - 2) / 97.3, (k % 7 - 3) / 61.7, k % 11 - 5.3137, (k % 3 - 1) / 53.9, 1 + (k % 4 - 1) / 89.1, k % 9 - 4.2871, (k % 13 - 6) / 1.93e4, (k % 17 - 8) / 2.07e4, F.lit(1.0))
    return table(spark, d, "lineitem").select("l_suppkey").distinct().select(k.alias("img"), *[F.when(flat, 0.0).otherwise(c.cast("double")).alias(n) for c, n in zip(h, geometry.NAMES)])


_H = dict(zip(("a", "b", "c", "d", "e", "f", "g", "h", "i"), ("1 + (img % 5 - 2) / 97.3", "(img % 7 - 3) / 61.7", "img % 11 - 5.3137", "(img % 3 - 1) / 53.9", "1 + (img % 4 - 1) / 89.1", "img % 9 - 4.2871", "(img % 13 - 6) / 1.93e4", "(img % 17 - 8) / 2.07e4", "1")))
_INVERSE = "h AS (SELECT img, " + ", ".join(f"CASE WHEN img % 29 = 0 THEN 0 ELSE CAST({e} AS DOUBLE) END AS h{n}" for n, e in _H.items()) + " FROM sizes), det AS (SELECT *, nullif(ha * (he * hi - hf * hh) - hb * (hd * hi - hf * hg) + hc * (hd * hh - he * hg), 0) AS det FROM h)"
_AT = """spot AS (SELECT p.img, x, y, p.c, ((he * hi - hf * hh) * x + (hc * hh - hb * hi) * y + (hb * hf - hc * he)) / det / greatest(((hd * hh - he * hg) * x + (hb * hg - ha * hh) * y + (ha * he - hb * hd)) / det, 1e-8) AS u,
    ((hf * hg - hd * hi) * x + (ha * hi - hc * hg) * y + (hc * hd - ha * hf)) / det / greatest(((hd * hh - he * hg) * x + (hb * hg - ha * hh) * y + (ha * he - hb * hd)) / det, 1e-8) AS w FROM places p JOIN det ON det.img = p.img)"""


@query(f"WITH {PHOTOS}, {_sql_places(44, 30)}, {_INVERSE}, {_AT}, {_sql_bilinear(False)} {_SUMS}")
def tile_warp_bilinear(spark: SparkSession, d: str) -> DataFrame:
    """Three channels under a transform for each image, on a larger canvas; border places fade over a step."""
    return _sums(tiles.warp(photos(spark, d), _transforms(spark, d), 44, 30, "bilinear", SIDE, out="f8"), "f8")


@query(f"WITH {PHOTOS}, {_sql_places(44, 30)}, {_INVERSE}, {_AT}, hit AS (SELECT a.img, a.x, a.y, a.c, coalesce(p.v, 0) AS v FROM spot a LEFT JOIN photo p ON p.img = a.img AND p.x = round_even(a.u, 0) AND p.y = round_even(a.w, 0) AND p.c = a.c) {_SUMS}")
def tile_warp_nearest(spark: SparkSession, d: str) -> DataFrame:
    return _sums(tiles.warp(photos(spark, d), _transforms(spark, d), 44, 30, "nearest", SIDE), "u1")


@query(f"WITH {PHOTOS}, {_sql_places(60, 35)}, spot AS (SELECT img, x, y, c, (x + 0.5) * {WIDE} / 60.0::DOUBLE - 0.5 AS u, (y + 0.5) * {TALL} / 35.0::DOUBLE - 0.5 AS w FROM places), {_sql_bilinear(True)} {_SUMS}")
def tile_resize_bilinear(spark: SparkSession, d: str) -> DataFrame:
    return _sums(tiles.resize(photos(spark, d), 60, 35, "bilinear", False, SIDE, out="f8"), "f8")


@query(f"WITH {PHOTOS}, {_sql_places(23, 50)}, spot AS (SELECT img, x, y, c, x * {WIDE - 1} / 22.0::DOUBLE AS u, y * {TALL - 1} / 49.0::DOUBLE AS w FROM places), {_sql_bilinear(True)} {_SUMS}")
def tile_resize_aligned(spark: SparkSession, d: str) -> DataFrame:
    """Resizing that brings the outermost places onto each other."""
    return _sums(tiles.resize(photos(spark, d), 23, 50, "bilinear", True, SIDE, out="f8"), "f8")


@query(f"WITH {PHOTOS}, {_sql_places(23, 50)}, hit AS (SELECT a.img, a.x, a.y, a.c, coalesce(p.v, 0) AS v FROM places a LEFT JOIN photo p ON p.img = a.img AND p.x = a.x * {WIDE} // 23 AND p.y = a.y * {TALL} // 50 AND p.c = a.c) {_SUMS}")
def tile_resize_nearest(spark: SparkSession, d: str) -> DataFrame:
    return _sums(tiles.resize(photos(spark, d), 23, 50, "nearest", False, SIDE), "u1")


@query(f"""WITH {PHOTOS}, label AS (SELECT img, x, y, r % 5 AS cls FROM cells),
places AS (SELECT img, x, y, ((x * 7 + y * 3 + img) % 13 - 6) / 4.0 AS dx, ((x * 5 + y * 11 + img) % 9 - 4) / 4.0 AS dy FROM sizes, (SELECT unnest(range({WIDE})) AS x), (SELECT unnest(range({TALL})) AS y)),
corner AS (SELECT img, x, y, floor(x + dx) + i AS sx, floor(y + dy) + j AS sy, abs(1 - i - (x + dx - floor(x + dx))) * abs(1 - j - (y + dy - floor(y + dy))) AS weight FROM places, {_CORNERS}),
vote AS (SELECT a.img, a.x, a.y, coalesce(l.cls, 0) AS cls, sum(weight) AS weight FROM corner a LEFT JOIN label l ON l.img = a.img AND l.x = a.sx AND l.y = a.sy GROUP BY 1, 2, 3, 4),
best AS (SELECT img, x, y, cls FROM vote QUALIFY row_number() OVER (PARTITION BY img, x, y ORDER BY weight DESC, cls) = 1)
SELECT img, CAST(cls AS INTEGER) AS cls, count(*) AS n, CAST(sum(x * 31 + y) AS BIGINT) AS places FROM best GROUP BY 1, 2
""")
def tile_label_warp(spark: SparkSession, d: str) -> DataFrame:
    """Labels of the frame before led by a flow; the heaviest class of four places wins."""
    sizes = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("img")).distinct().select("img", F.lit(WIDE).alias("iw"), F.lit(TALL).alias("ih"))
    labels = tiles.from_cells(photo_cells(spark, d).withColumn("cls", F.col("r") % 5), sizes, ("cls",), SIDE)
    flow = tiles.computed(sizes, lambda img, x, y: np.stack((((x * 7 + y * 3 + img) % 13 - 6) / 4.0, ((x * 5 + y * 11 + img) % 9 - 4) / 4.0), axis=2), 2, SIDE, "f4")
    return _class_sums(tiles.warp_labels(labels, flow, SIDE))


def _class_sums(out: DataFrame) -> DataFrame:
    """How many places a class has in each image, and a sum that any wrong place would change."""
    return tiles.class_places(out, SIDE).select("img", F.col("cls").cast("int").alias("cls"), "n", (F.col("sum_x") * 31 + F.col("sum_y")).alias("places"))


def _points(spark: SparkSession, d: str) -> DataFrame:
    place = lambda c, by, more: F.col(c) * by + more
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("img"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"))
    return rows.agg(F.min(place("l_discount", 391.7, -0.43)).alias("px"), F.min(place("l_tax", 301.3, 0.29)).alias("py"))


_POINTS = "points AS (SELECT l_suppkey AS img, l_orderkey * 8 + l_linenumber AS id, min(l_discount * 391.7::DOUBLE - 0.43::DOUBLE) AS px, min(l_tax * 301.3::DOUBLE + 0.29::DOUBLE) AS py FROM lineitem GROUP BY 1, 2)"


@query(f"""WITH {PHOTOS}, {_POINTS},
corner AS (SELECT img, id, floor(px) + i AS sx, floor(py) + j AS sy, abs(1 - i - (px - floor(px))) * abs(1 - j - (py - floor(py))) AS weight FROM points, {_CORNERS}),
hit AS (SELECT a.img, a.id, sum(weight * coalesce(c.r, 0)) AS r, sum(weight * coalesce((c.r * 3 + c.x) % 256, 0)) AS g, sum(weight * coalesce(255 - c.r, 0)) AS b FROM corner a LEFT JOIN cells c ON c.img = a.img AND c.x = a.sx AND c.y = a.sy GROUP BY 1, 2)
SELECT img, id, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM hit""")
def tile_points(spark: SparkSession, d: str) -> DataFrame:
    """Three channels' bilinear values at keypoints."""
    found = tiles.at_points(photos(spark, d), _points(spark, d), SIDE)
    return found.select("img", "id", *[r6(F.col("values")[i]).alias(c) for i, c in enumerate("rgb")])


@query(f"""WITH {PHOTOS}, {_POINTS},
corner AS (SELECT img, id, CAST(greatest(0, least(floor(px) - 2, {WIDE - 5})) AS INTEGER) AS "left", CAST(greatest(0, least(floor(py) - 2, {TALL - 5})) AS INTEGER) AS top FROM points),
place AS (SELECT k.img, id, "left", top, j, i, c FROM corner k, (SELECT unnest(range(5)) AS j), (SELECT unnest(range(5)) AS i), (SELECT unnest([0, 1, 2]) AS c))
SELECT k.img, id, "left", top, string_agg(printf('%02X', CAST(coalesce(v, 0) AS INTEGER)), '' ORDER BY j, i, k.c) AS patch FROM place k LEFT JOIN photo p ON p.img = k.img AND p.x = "left" + i AND p.y = top + j AND p.c = k.c GROUP BY 1, 2, 3, 4""")
def tile_patches(spark: SparkSession, d: str) -> DataFrame:
    """5 x 5 places around keypoints, moved inside the image."""
    return tiles.patches(photos(spark, d), _points(spark, d), 5, SIDE).select("img", "id", "left", "top", F.hex("patch").alias("patch"))


def _grid(spark: SparkSession, d: str) -> DataFrame:
    """photo_cells() with all places of each image, 0 where it has none."""
    sizes = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("img")).distinct()
    places = sizes.select("img", F.explode(F.sequence(F.lit(0), F.lit(WIDE - 1))).alias("x")).select("*", F.explode(F.sequence(F.lit(0), F.lit(TALL - 1))).alias("y"))
    cells = places.join(photo_cells(spark, d), ["img", "x", "y"], "left")
    return cells.select("img", "x", "y", *[F.coalesce(c, F.lit(0)).alias(c) for c in "rgb"])


_ALL = f"""every AS (SELECT s.img, x, y FROM sizes s, (SELECT unnest(range({WIDE})) AS x), (SELECT unnest(range({TALL})) AS y)),
whole AS (SELECT e.img, e.x, e.y, coalesce(r, 0) AS r, coalesce((r * 3 + c.x) % 256, 0) AS g, coalesce(255 - r, 0) AS b FROM every e LEFT JOIN cells c ON c.img = e.img AND c.x = e.x AND c.y = e.y)"""
_BY, _STEPS = 3, 4


@query(f"""WITH {PHOTOS}, {_ALL},
canvas AS (SELECT img, x, y, r, g, x < 22 + img % 5 AS painted, x BETWEEN 6 + img % 4 AND 36 AND y BETWEEN 3 AND 20 + img % 3 AND NOT (x BETWEEN 15 AND 19 AND y BETWEEN 8 AND 12) AS region FROM whole),
block AS (SELECT img, x // {_BY} AS bx, y // {_BY} AS cy, avg(CASE WHEN region THEN 0 ELSE 1 END) > 0.3 AS set FROM canvas WHERE x < {WIDE // _BY * _BY} AND y < {TALL // _BY * _BY} GROUP BY 1, 2, 3),
near AS (SELECT a.img, a.bx, a.cy, min(greatest(abs(a.bx - s.bx), abs(a.cy - s.cy))) AS d FROM block a LEFT JOIN block s ON s.img = a.img AND s.set GROUP BY 1, 2, 3),
small AS (SELECT img, bx, cy, least(1.0::DOUBLE, greatest(0.0::DOUBLE, ({_STEPS} - greatest(d, 1) + 1) / {_STEPS}.0::DOUBLE)) AS ramp FROM near),
spot AS (SELECT *, greatest(0, least((x + 0.5) * {WIDE // _BY} / {WIDE}.0::DOUBLE - 0.5, {WIDE // _BY - 1})) AS u, greatest(0, least((y + 0.5) * {TALL // _BY} / {TALL}.0::DOUBLE - 0.5, {TALL // _BY - 1})) AS w FROM canvas),
corner AS (SELECT *, floor(u) + i AS sx, floor(w) + j AS sy, abs(1 - i - (u - floor(u))) * abs(1 - j - (w - floor(w))) AS weight FROM spot, {_CORNERS}),
ramped AS (SELECT c.img, c.x, c.y, any_value(r) AS r, any_value(g) AS g, any_value(painted) AS painted, any_value(region) AS region, sum(weight * coalesce(s.ramp, 0)) AS ramp FROM corner c LEFT JOIN small s ON s.img = c.img AND s.bx = c.sx AND s.cy = c.sy GROUP BY 1, 2, 3),
alpha AS (SELECT *, CASE WHEN region THEN least(1, greatest(0, 1 - ramp)) ELSE 0 END AS alpha, CASE WHEN region AND NOT painted THEN g ELSE r END AS base FROM ramped)
SELECT img, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, round(alpha, 10) AS alpha, round(base * (1 - alpha) + g * alpha, 10) AS v FROM alpha WHERE region
""")
def feathered_paste(spark: SparkSession, d: str) -> DataFrame:
    """One channel pasted over another where a mask says so, weighted by the ramp that the mask's edge makes."""
    x, y, k = F.col("x"), F.col("y"), F.col("img")
    region = x.between(6 + k % 4, 36) & y.between(3, 20 + k % 3) & ~(x.between(15, 19) & y.between(8, 12))
    cells = _grid(spark, d).select("img", "x", "y", F.col("r").alias("canvas"), (x < 22 + k % 5).alias("painted"), F.col("g").alias("new"), region.alias("region"))
    done = paste.feathered_cells(cells, _BY * _STEPS, _BY).where("region")
    return done.select("img", "x", "y", F.round("alpha", 10).alias("alpha"), F.round("v", 10).alias("v"))


def _sql_blur(out: str, source: str, w: int, h: int) -> str:
    """out (img, ch, x, y, v): source under five taps along both sides, mirrored at the edges."""
    mirrored = lambda c, n: f"CASE WHEN abs({c}) >= {n} THEN 2 * ({n} - 1) - abs({c}) ELSE abs({c}) END"
    taps = "(SELECT unnest([-2, -1, 0, 1, 2]) AS {0}, unnest([1, 4, 6, 4, 1]) AS t{0})"
    return f"""{out} AS (SELECT a.img, a.ch, a.x, a.y, sum(b.v * ti * tj) / 256.0::DOUBLE AS v FROM (SELECT *, {mirrored("x + i", w)} AS sx, {mirrored("y + j", h)} AS sy FROM {source}, {taps.format("i")}, {taps.format("j")}) a
    JOIN {source} b ON b.img = a.img AND b.ch = a.ch AND b.x = a.sx AND b.y = a.sy GROUP BY 1, 2, 3, 4)"""


def _sql_down(out: str, source: str, w: int, h: int) -> str:
    return f"{_sql_blur(out + '_b', source, w, h)}, {out} AS (SELECT img, ch, x // 2 AS x, y // 2 AS y, avg(v) AS v FROM {out}_b GROUP BY 1, 2, 3, 4)"


def _sql_up(out: str, source: str, w: int, h: int) -> str:
    """out, of w x h places, from source on half of them along each side."""
    at = lambda c, n: f"greatest(0, least(({c} + 0.5) / 2.0::DOUBLE - 0.5, {n // 2 - 1}))"
    return f"""{out}_c AS (SELECT img, ch, x, y, floor(u) + i AS sx, floor(w) + j AS sy, abs(1 - i - (u - floor(u))) * abs(1 - j - (w - floor(w))) AS weight
        FROM (SELECT k.img, k.ch, x, y, {at("x", w)} AS u, {at("y", h)} AS w FROM (SELECT DISTINCT img, ch FROM {source}) k, (SELECT unnest(range({w})) AS x), (SELECT unnest(range({h})) AS y)), {_CORNERS}),
    {out}_r AS (SELECT c.img, c.ch, c.x, c.y, sum(weight * s.v) AS v FROM {out}_c c JOIN {source} s ON s.img = c.img AND s.ch = c.ch AND s.x = c.sx AND s.y = c.sy GROUP BY 1, 2, 3, 4), {_sql_blur(out, out + "_r", w, h)}"""


@query(f"""WITH {PHOTOS}, {_ALL}, source AS (SELECT img, 0 AS ch, x, y, r::DOUBLE AS v FROM whole),
{_sql_down("half", "source", WIDE, TALL)}, {_sql_up("low", "half", WIDE, TALL)}
SELECT s.img, CAST(s.x AS INTEGER) AS x, CAST(s.y AS INTEGER) AS y, round(l.v, 6) AS low, round(s.v - l.v, 6) + 0.0 AS high FROM source s JOIN low l ON l.img = s.img AND l.x = s.x AND l.y = s.y""")
def pyramid_two_levels(spark: SparkSession, d: str) -> DataFrame:
    """A Gaussian pyramid's second level brought back, and what it lacks."""
    levels = raster.pyramid_levels(_grid(spark, d).select("img", "x", "y", F.col("r").alias("v")), 2)
    return levels.select("img", "x", "y", r6(F.col("low")).alias("low"), (r6(F.col("high")) + 0.0).alias("high"))


_MASK = "CASE WHEN x BETWEEN 8 + img % 6 AND 27 AND y BETWEEN 5 AND 18 THEN 1 ELSE 0 END"


@query(f"""WITH {PHOTOS}, {_ALL}, source AS (SELECT img, ch, x, y, CASE ch WHEN 0 THEN r WHEN 1 THEN g ELSE {_MASK} END::DOUBLE AS v FROM whole, (SELECT unnest([0, 1, 2]) AS ch)),
{_sql_down("half", "source", WIDE, TALL)}, {_sql_up("low", "half", WIDE, TALL)},
mixed AS (SELECT c.img, 0 AS ch, c.x, c.y, c.v * (1 - m.v) + p.v * m.v AS v FROM half c JOIN half p ON p.img = c.img AND p.x = c.x AND p.y = c.y AND p.ch = 1 JOIN half m ON m.img = c.img AND m.x = c.x AND m.y = c.y AND m.ch = 2 WHERE c.ch = 0),
{_sql_up("base", "mixed", WIDE, TALL)},
high AS (SELECT s.img, s.ch, s.x, s.y, s.v - l.v AS v FROM source s JOIN low l ON l.img = s.img AND l.x = s.x AND l.y = s.y AND l.ch = s.ch)
SELECT c.img, CAST(c.x AS INTEGER) AS x, CAST(c.y AS INTEGER) AS y, round((c.v * (1 - m.v) + p.v * m.v + b.v) / 1.37::DOUBLE, 6) + 0.0 AS scaled FROM high c JOIN high p ON p.img = c.img AND p.x = c.x AND p.y = c.y AND p.ch = 1
JOIN source m ON m.img = c.img AND m.x = c.x AND m.y = c.y AND m.ch = 2 JOIN base b ON b.img = c.img AND b.x = c.x AND b.y = c.y WHERE c.ch = 0""")
def multiband_paste(spark: SparkSession, d: str) -> DataFrame:
    """One channel pasted over another by two bands; over 1.37, so that no rounded value lies half way."""
    mask = F.col("x").between(8 + F.col("img") % 6, 27) & F.col("y").between(5, 18)
    cells = _grid(spark, d).select("img", "x", "y", F.col("r").alias("canvas"), F.col("g").alias("patch"), mask.cast("int").alias("mask"))
    return raster.multiband_pasted(cells, 2).select("img", "x", "y", (r6(F.col("v") / 1.37) + 0.0).alias("scaled"))
