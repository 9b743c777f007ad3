"""Further operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions import parsing
from framelake.operators import geometry, keypoints, metrics, raster, sequence
from framelake.plans.image_queries import _H, _transforms
from framelake.plans.registry import GRID, HEIGHT, SUMS, WIDTH, codes, image_grid, query, r6, table

_G = f"WITH {GRID.strip()}"


@query("""
WITH f AS (SELECT user_id, value - 5 AS dx, CAST(event_id % 9 - 4 AS DOUBLE) AS dy, event_type <> 'view' AS valid FROM events),
s AS (SELECT user_id, avg(CAST(valid AS INTEGER)) AS share, quantile_disc(dx, 0.5) FILTER (valid) AS sx, quantile_disc(dy, 0.5) FILTER (valid) AS sy FROM f GROUP BY 1)
SELECT user_id, round(CASE WHEN share >= 0.5 THEN sx ELSE 0 END, 6) AS sx, round(CASE WHEN share >= 0.5 THEN sy ELSE 0 END, 6) AS sy FROM s
""")
def median_camera_shift(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", (F.col("value") - 5).alias("dx"), (F.col("event_id") % 9 - 4).cast("double").alias("dy"), (F.col("event_type") != "view").alias("valid"))
    return geometry.camera_shift(e, "user_id", 0.5).select("user_id", r6(F.col("sx")).alias("sx"), r6(F.col("sy")).alias("sy"))


@query("""
WITH p AS (SELECT event_id, event_type AS img, value AS x, CAST(user_id AS DOUBLE) AS y, event_id % 17 AS score, (event_id % 360) - 180 AS ori FROM events)
SELECT img, event_id FROM (SELECT *, row_number() OVER (PARTITION BY img, round_even(x, 0), round_even(y, 0) ORDER BY score DESC, abs(ori), x, y) AS rn FROM p) WHERE rn = 1
""")
def duplicate_keypoints(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    p = table(spark, d, "events").select("event_id", F.col("event_type").alias("img"), F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"), (e % 17).alias("score"), (e % 360 - 180).alias("ori"))
    return keypoints.one_per_cell(p).select("img", "event_id")


@query(_G + """, p AS (SELECT img, img * 10000 + x * 100 + y AS id, greatest(0, least(x - 1, 51 - 3)) AS x0, greatest(0, least(y - 1, 8 - 3)) AS y0 FROM grid WHERE v > 200),
k AS (SELECT img, id, CAST(k % 3 AS INTEGER) AS px, CAST(k // 3 AS INTEGER) AS py, x0 + k % 3 AS x, y0 + k // 3 AS y FROM p, (SELECT unnest(range(9)) AS k))
SELECT id, px, py, coalesce(v, 0) AS v FROM k LEFT JOIN grid g ON g.img = k.img AND g.x = k.x AND g.y = k.y""")
def keypoint_patches(spark: SparkSession, d: str) -> DataFrame:
    cells = image_grid(spark, d)
    points = cells.where("v > 200").select((F.col("img") * 10000 + F.col("x") * 100 + F.col("y")).alias("id"), "img", "x", "y")
    return keypoints.patches(points, cells, 3, WIDTH, HEIGHT)


@query("""
SELECT event_id, round(0.25 * coalesce(lag(value, 2) OVER w, 0) + 0.5 * value + 0.25 * coalesce(lead(value, 2) OVER w, 0), 6) AS smooth FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def dilated_temporal_sum(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", r6(sequence.dilated_sum(e, "user_id", ["ts", "event_id"], "value", (0.25, 0.5, 0.25), 2)).alias("smooth"))


@query("""
WITH o AS (SELECT o_orderkey, 320 + o_orderkey % 7 AS w, 240 + o_orderkey % 5 AS h, CASE o_orderkey % 3 WHEN 0 THEN 'entire' WHEN 1 THEN 'original' ELSE 'internal' END AS mode FROM orders)
SELECT o_orderkey, w * 3 AS cw, h * 3 AS ch, CAST(floor((w * 3 - w) / 2) AS BIGINT) AS ox, CAST(floor((h * 3 - h) / 2) AS BIGINT) AS oy,
       CASE mode WHEN 'entire' THEN 0 WHEN 'original' THEN 5 ELSE 9 END AS x1, CASE mode WHEN 'entire' THEN h * 3 WHEN 'original' THEN 60 ELSE 70 END AS y2 FROM o
""")
def canvas_and_crop(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    box = lambda *v: F.struct(*[F.lit(x).cast("bigint").alias(n) for x, n in zip(v, ("x1", "y1", "x2", "y2"))])
    o = table(spark, d, "orders").select("o_orderkey", geometry.canvas_of(320 + k % 7, 240 + k % 5).alias("c"), F.when(k % 3 == 0, "entire").when(k % 3 == 1, "original").otherwise("internal").alias("mode"))
    crop = geometry.crop_box(F.col("mode"), box(9, 9, 80, 70), box(5, 5, 50, 60), F.col("c.cw"), F.col("c.ch"))
    return o.select("o_orderkey", "c.*", crop.alias("b")).select("o_orderkey", "cw", "ch", "ox", "oy", F.col("b.x1").cast("int").alias("x1"), F.col("b.y2").alias("y2"))


_INV = """i AS (SELECT o_orderkey, (h11*h22 - h12*h21)/det AS i00, (h02*h21 - h01*h22)/det AS i01, (h01*h12 - h02*h11)/det AS i02, (h12*h20 - h10*h22)/det AS i10, (h00*h22 - h02*h20)/det AS i11, (h02*h10 - h00*h12)/det AS i12,
       (h10*h21 - h11*h20)/det AS i20, (h01*h20 - h00*h21)/det AS i21, (h00*h11 - h01*h10)/det AS i22 FROM (SELECT *, h00*(h11*h22 - h12*h21) - h01*(h10*h22 - h12*h20) + h02*(h10*h21 - h11*h20) AS det FROM h))"""


@query(f"""
WITH {_H.strip()}, {_INV},
p AS (SELECT o_orderkey, 10.0 + 30 AS x, 20.0 + 40 AS y, * EXCLUDE (o_orderkey) FROM i)
SELECT o_orderkey, round((i00*x + i01*y + i02) / greatest(i20*x + i21*y + i22, 1e-8) + 3, 5) AS fx, round((i10*x + i11*y + i12) / greatest(i20*x + i21*y + i22, 1e-8) + 4, 5) AS fy FROM p
""")
def points_to_frame(spark: SparkSession, d: str) -> DataFrame:
    f = lambda x: F.lit(float(x))
    x, y = geometry.to_frame(f(10), f(20), f(30), f(40), geometry.inverse(geometry.entries()), f(3), f(4))
    return _transforms(spark, d).select("o_orderkey", F.round(x, 5).alias("fx"), F.round(y, 5).alias("fy"))


_ENDS = ", ".join(f"(i00*{x} + i01*{y} + i02) / greatest(i20*{x} + i21*{y} + i22, 1e-8) AS u{k}, (i10*{x} + i11*{y} + i12) / greatest(i20*{x} + i21*{y} + i22, 1e-8) AS v{k}" for k, (x, y) in enumerate((x, y) for x in ("10.0", "110.0") for y in ("20.0", "90.0")))


@query(f"""
WITH {_H.strip()}, {_INV}, c AS (SELECT o_orderkey, {_ENDS} FROM i),
b AS (SELECT o_orderkey, least(u0, u1, u2, u3) AS x1, greatest(u0, u1, u2, u3) AS x2, least(v0, v1, v2, v3) AS y1, greatest(v0, v1, v2, v3) AS y2 FROM c)
SELECT o_orderkey, CAST(trunc(x1) AS BIGINT) AS x, CAST(trunc(y1) AS BIGINT) AS y, CAST(trunc(x2 - x1) AS BIGINT) AS w, CAST(trunc(y2 - y1) AS BIGINT) AS h FROM b
""")
def boxes_to_frame(spark: SparkSession, d: str) -> DataFrame:
    f = lambda x: F.lit(float(x))
    box = geometry.box_to_frame(f(10), f(20), f(110), f(90), geometry.inverse(geometry.entries()))
    return _transforms(spark, d).select("o_orderkey", box.alias("b")).select("o_orderkey", "b.*")


@query(_G.replace("WITH", "WITH RECURSIVE") + """, p AS (SELECT img, x, y FROM grid WHERE v > 200),
r AS (SELECT img, x, y, x AS fx, y AS fy FROM p UNION SELECT p.img, p.x, p.y, r.fx, r.fy FROM r JOIN p ON p.img = r.img AND abs(p.x - r.x) <= 1 AND abs(p.y - r.y) <= 1),
c AS (SELECT img, x, y, min(fy * 1000 + fx) AS first FROM r GROUP BY 1, 2, 3)
SELECT img, first % 1000 AS fx, first // 1000 AS fy, min(x) AS x1, min(y) AS y1, max(x) + 1 AS x2, max(y) + 1 AS y2, count(*) AS n, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM c GROUP BY img, first""")
def mask_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Connected sets of bright cells and their boxes."""
    found = raster.boxes(image_grid(spark, d).where("v > 200").select("img", "x", "y"))
    return found.select("img", F.col("component.x").alias("fx"), F.col("component.y").alias("fy"), "x1", "y1", "x2", "y2", "n", r6(F.col("cx")).alias("cx"), r6(F.col("cy")).alias("cy"))


_SQUARE = "{n} AS (SELECT c.img, c.x, c.y, {test} AS v FROM cells c LEFT JOIN {t} n ON n.img = c.img AND abs(n.x - c.x) <= 1 AND abs(n.y - c.y) <= 1 GROUP BY 1, 2, 3)"
_SMALLER, _LARGER = "bool_and(n.v)", "bool_or(n.v)"


@query(_G.replace("WITH", "WITH RECURSIVE") + """, o AS (SELECT img, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM grid GROUP BY 1),
cells AS (SELECT img, x, y FROM o, (SELECT CAST(unnest(range(60)) AS INTEGER) AS x), (SELECT CAST(unnest(range(12)) AS INTEGER) AS y) WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1),
lit AS (SELECT c.img, c.x, c.y, coalesce(g.v > 15, false) AS v FROM cells c LEFT JOIN grid g ON g.img = c.img AND g.x = c.x AND g.y = c.y),
""" + ", ".join(_SQUARE.format(n=n, t=t, test=test) for n, t, test in (("e1", "lit", _SMALLER), ("e2", "e1", _LARGER), ("e3", "e2", _LARGER), ("e4", "e3", _SMALLER))) + """,
p AS (SELECT img, x, y FROM e4 WHERE v),
r AS (SELECT img, x, y, y * 1000 + x AS first FROM p UNION SELECT p.img, p.x, p.y, r.first FROM r JOIN p ON p.img = r.img AND abs(p.x - r.x) <= 1 AND abs(p.y - r.y) <= 1),
k AS (SELECT img, x, y, min(first) AS first FROM r GROUP BY 1, 2, 3), s AS (SELECT img, first, count(*) AS n FROM k GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY img ORDER BY n DESC, first) = 1),
rim AS (SELECT k.img, unnest([min(x), max(x)])::DOUBLE AS x, y::DOUBLE AS y FROM k JOIN s ON s.img = k.img AND s.first = k.first GROUP BY k.img, y),
two AS (SELECT a.img, (a.x + b.x) / 2 AS cx, (a.y + b.y) / 2 AS cy, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / 2 AS r FROM rim a JOIN rim b ON a.img = b.img AND (a.x, a.y) <= (b.x, b.y)),
three AS (SELECT a.img, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS bz, c.x AS qx, c.y AS qy, 2 * (a.x * (b.y - c.y) + b.x * (c.y - a.y) + c.x * (a.y - b.y)) AS d FROM rim a JOIN rim b ON a.img = b.img AND (a.x, a.y) < (b.x, b.y) JOIN rim c ON c.img = a.img AND (b.x, b.y) < (c.x, c.y)),
mid AS (SELECT *, ((ax * ax + ay * ay) * (bz - qy) + (bx * bx + bz * bz) * (qy - ay) + (qx * qx + qy * qy) * (ay - bz)) / d AS cx, ((ax * ax + ay * ay) * (qx - bx) + (bx * bx + bz * bz) * (ax - qx) + (qx * qx + qy * qy) * (bx - ax)) / d AS cy FROM three WHERE abs(d) > 1e-9),
every AS (SELECT * FROM two UNION ALL SELECT img, cx, cy, sqrt((ax - cx) * (ax - cx) + (ay - cy) * (ay - cy)) FROM mid),
best AS (SELECT e.img, e.cx, e.cy, e.r FROM every e JOIN rim q ON q.img = e.img GROUP BY 1, 2, 3, 4 HAVING max(sqrt((q.x - e.cx) * (q.x - e.cx) + (q.y - e.cy) * (q.y - e.cy))) <= e.r + 1e-7 QUALIFY row_number() OVER (PARTITION BY e.img ORDER BY e.r) = 1)
SELECT g.img, g.x, g.y, round((g.x - cx) * (g.x - cx) + (g.y - cy) * (g.y - cy), 4) > round((b.r - 2) * (b.r - 2), 4) AS masked, round(b.r - 2, 4) AS r FROM grid g JOIN best b ON b.img = g.img""")
def scope_mask(spark: SparkSession, d: str) -> DataFrame:
    """What lies outside the circle around the largest lit set, opened and closed by a square of radius 1."""
    cells = image_grid(spark, d)
    circle = raster.scope_circle(cells, 15, 2, 1)
    return raster.outside_circle(cells, circle).join(circle.select("img", F.round("r", 4).alias("r")), "img").select("img", "x", "y", "masked", "r")


@query("""
SELECT page_id, CASE WHEN contains(lower(html), 'table') THEN 1 WHEN contains(lower(html), 'div') THEN 2 ELSE NULL END AS cls,
       replace(url, 'http', '') AS image, printf('GT_orig_%d/%s/frame_%06d_gt_idx.png', CAST(page_id % 5 AS INTEGER), 'video' || (page_id % 3), page_id) AS copy FROM pages
""")
def path_rewrites(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    copy = parsing.truth_copy(F.concat(F.lit("video"), (k % 3).cast("string")), k, (k % 5).cast("int"))
    return table(spark, d, "pages").select("page_id", parsing.keyword_class(F.col("html"), {"table": 1, "div": 2}).alias("cls"), parsing.image_of_mask(F.col("url"), "http").alias("image"), copy.alias("copy"))


@query("SELECT event_id, CAST(floor(((8 - event_id % 8) % 8) / 2) AS INTEGER) AS before, CAST((8 - event_id % 8) % 8 - floor(((8 - event_id % 8) % 8) / 2) AS INTEGER) AS after FROM events")
def padding_to_multiple(spark: SparkSession, d: str) -> DataFrame:
    before, after = parsing.padded(F.col("event_id"), 8)
    return table(spark, d, "events").select("event_id", before.alias("before"), after.alias("after"))


@query("SELECT user_id, list(event_id ORDER BY event_id) AS ids FROM events GROUP BY 1".replace("list(event_id ORDER BY event_id) AS ids", "count(*) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS ids"))
def frames_to_lists(spark: SparkSession, d: str) -> DataFrame:
    by = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("event_id")).alias("ids"))
    return by.withColumn("ids", F.array_join("ids", ","))


@query("""
WITH t AS (SELECT label AS pair, 1 / (1 + exp(-10 * CAST(embedding[1] AS DOUBLE))) AS c FROM embeddings)
SELECT pair, round(avg(CASE WHEN c >= 0.8 + 0.1 * exp(-4.0 * 2 / 9) THEN 1.0 ELSE 0.0 END), 6) AS sure, avg(CASE WHEN c >= 0.8 + 0.1 * exp(-4.0 * 2 / 9) THEN 1.0 ELSE 0.0 END) > 0.3 AS stop FROM t GROUP BY 1
""")
def early_stop(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "embeddings").select(F.col("label").alias("pair"), (1 / (1 + F.exp(-10 * F.col("embedding")[0].cast("double")))).alias("confidence"))
    return keypoints.stops(t, "pair", 2, 9, 0.3).select("pair", r6(F.col("sure")).alias("sure"), "stop")


@query(f"""
WITH {_H.strip()} SELECT o_orderkey, round((2.0/639) * (h00 * 319.5) + -1.0 * (h20 * 319.5), 6) AS n00, round((2.0/479) * (h11 * 239.5) + -1.0 * (h21 * 239.5), 6) AS n11 FROM h
""")
def unit_homography(spark: SparkSession, d: str) -> DataFrame:
    m = geometry.unit_transform(geometry.entries(), 640, 480, 640, 480)
    return _transforms(spark, d).select("o_orderkey", r6(m[0][0]).alias("n00"), r6(m[1][1]).alias("n11"))


_TRUTH = """, px AS (SELECT img, x, y, CAST(v % 3 AS INTEGER) AS gt, CAST((v // 3) % 3 AS INTEGER) AS pred FROM grid),
far AS (SELECT p.*, (SELECT min(sqrt((p.x - b.x) * (p.x - b.x) + (p.y - b.y) * (p.y - b.y))) FROM px b WHERE b.img = p.img AND b.gt = 0) AS d FROM px p),
bins AS (SELECT f.*, CAST(floor(d / (m.most + 1e-12) / (1.01 / 12)) AS INTEGER) AS bin FROM far f JOIN (SELECT img, max(d) AS most FROM far GROUP BY 1) m ON f.img = m.img WHERE gt <> 0)"""
_IN_BINS = f""", sides AS (SELECT *, pred AS cls, 1 AS p, 0 AS g FROM bins UNION ALL SELECT *, gt, 0, 1 FROM bins),
per AS (SELECT img, cls, bin, {SUMS} FROM sides GROUP BY 1, 2, 3),
has AS (SELECT DISTINCT img, gt AS cls FROM px),
c AS (SELECT cls, bin, CAST(sum(inter) AS BIGINT) AS inter, CAST(sum(pred_sum) AS BIGINT) AS pred_sum, CAST(sum(gt_sum) AS BIGINT) AS gt_sum FROM per SEMI JOIN has USING (img, cls) WHERE cls <> 0 GROUP BY 1, 2)"""


def _ground_bins(spark: SparkSession, d: str) -> DataFrame:
    px = image_grid(spark, d).select("img", "x", "y", (F.col("v") % 3).cast("int").alias("gt"), (F.floor(F.col("v") / 3) % 3).cast("int").alias("pred"))
    return metrics.ground_bins(px)


@query(_G + _TRUTH + _IN_BINS + " SELECT * FROM c")
def background_distance_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts by class and distance to the background over the image's largest, in twelve bins."""
    return _ground_bins(spark, d)


@query(_G + _TRUTH + _IN_BINS + """, r AS (SELECT cls, bin // 4 AS bin, CAST(sum(inter) AS BIGINT) AS inter, CAST(sum(pred_sum) AS BIGINT) AS pred_sum, CAST(sum(gt_sum) AS BIGINT) AS gt_sum FROM c GROUP BY 1, 2)
SELECT 12 AS bins, bin, round(avg(2 * inter / nullif(pred_sum + gt_sum, 0)), 6) AS mean_dice FROM c GROUP BY bin
UNION ALL SELECT 3, bin, round(avg(CASE WHEN pred_sum + gt_sum > 0 THEN 2 * inter / (pred_sum + gt_sum + 1e-6) END), 6) FROM r GROUP BY bin""")
def dice_12_to_3_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Twelve bins by distance to the background without an epsilon, and their roll-up to three with one."""
    return metrics.rolled_up(_ground_bins(spark, d)).withColumn("mean_dice", r6(F.col("mean_dice")))


@query("""
WITH m AS (SELECT event_type, user_id FROM events GROUP BY 1, 2), k AS (SELECT event_type, count(*) AS n FROM m GROUP BY 1), p AS (SELECT CAST(unnest([0, 6, 12]) AS DOUBLE) AS x), q AS (SELECT CAST(unnest([0, 5]) AS DOUBLE) AS y)
SELECT event_type, x, y, CASE WHEN n >= 10 THEN round(1.1 * x + 2, 2) END AS u, CASE WHEN n >= 10 THEN round(0.9 * y - 1, 2) END AS v FROM k, p, q
""")
def spline_fit(spark: SparkSession, d: str) -> DataFrame:
    """Thin-plate splines by event type over its users' places, which a straight map moves: they must give it back."""
    m = table(spark, d, "events").select("event_type", "user_id").distinct()
    m = m.select("event_type", (F.col("user_id") % 13).cast("double").alias("x"), F.floor(F.col("user_id") / 13).cast("double").alias("y"))
    m = m.select("event_type", "x", "y", (F.col("x") * 1.1 + 2).alias("u"), (F.col("y") * 0.9 - 1).alias("v"))
    places = [(float(x), float(y)) for x in (0, 6, 12) for y in (0, 5)]
    return geometry.splines(m, "event_type", places).select("event_type", "x", "y", F.round("u", 2).alias("u"), F.round("v", 2).alias("v"))


@query("""
SELECT l_returnflag, l_linestatus, CASE WHEN l_returnflag IN ('A', 'F') THEN 0 WHEN l_returnflag IN ('N', 'O') THEN 1 ELSE 2 END AS cls, count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1, 2, 3
""")
def classes_by_flags(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    return rows.groupBy("l_returnflag", "l_linestatus", codes(F.col("l_returnflag")).alias("cls")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"))
