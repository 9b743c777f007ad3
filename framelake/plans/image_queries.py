"""Keypoints, geometry and rasters on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions import models, parsing
from framelake.operators import geometry, joins, keypoints, raster
from framelake.plans.registry import GRID, HEIGHT, WIDTH, image_grid, query, r6, table
from framelake.sources import files

_G = f"WITH {GRID.strip()}"
_AROUND = "FROM grid a JOIN grid b ON b.x BETWEEN a.x - {r} AND a.x + {r} AND b.y BETWEEN a.y - {r} AND a.y + {r} AND a.img = b.img GROUP BY a.img, a.x, a.y"


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return image_grid(spark, d).select("img", "x", "y", F.col("v").cast("double").alias("s"))


@query(_G + """, m AS (SELECT a.*, (SELECT max(v) FROM grid b WHERE a.img = b.img AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1) AS m FROM grid a),
k0 AS (SELECT img, x, y, v, v = m AS kept FROM m),
n1 AS (SELECT a.*, (SELECT bool_or(kept) FROM k0 b WHERE a.img = b.img AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1) AS near FROM k0 a),
l1 AS (SELECT *, CASE WHEN near THEN 0 ELSE v END AS l FROM n1),
k1 AS (SELECT a.img, a.x, a.y, a.v, a.kept OR (NOT a.near AND a.l = (SELECT max(l) FROM l1 b WHERE a.img = b.img AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1)) AS kept FROM l1 a),
n2 AS (SELECT a.*, (SELECT bool_or(kept) FROM k1 b WHERE a.img = b.img AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1) AS near FROM k1 a),
l2 AS (SELECT *, CASE WHEN near THEN 0 ELSE v END AS l FROM n2)
SELECT a.img, a.x, a.y, a.v, a.kept OR (NOT a.near AND a.l = (SELECT max(l) FROM l2 b WHERE a.img = b.img AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1)) AS kept FROM l2 a
""")
def grid_nms(spark: SparkSession, d: str) -> DataFrame:
    return keypoints.suppress(_scores(spark, d), 1).select("img", "x", "y", F.col("s").cast("bigint").alias("v"), "kept")


@query(_G + """, m AS (SELECT a.img, a.x, a.y, max(b.v) AS m """ + _AROUND.format(r=1) + """),
w AS (SELECT a.img, a.x, a.y, b.x - a.x AS dx, b.y - a.y AS dy, exp((b.v / 255.0::DOUBLE - m / 255.0::DOUBLE) / 0.1::DOUBLE) AS w FROM grid a JOIN m ON a.img = m.img AND a.x = m.x AND a.y = m.y JOIN grid b ON a.img = b.img AND b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1)
SELECT img, x, y, round(sum(w * dx) / sum(w), 6) AS ox, round(sum(w * dy) / sum(w), 6) AS oy FROM w GROUP BY 1, 2, 3
""")
def soft_argmax_refine(spark: SparkSession, d: str) -> DataFrame:
    cells = image_grid(spark, d).select("img", "x", "y", (F.col("v") / F.lit(255.0)).alias("s"))
    return keypoints.soft_argmax(cells, 1).select("img", "x", "y", r6(F.col("ox")).alias("ox"), r6(F.col("oy")).alias("oy"))


@query(_G + """, p AS (SELECT img, x * 100 + y AS id, x + 0.25::DOUBLE AS px, y + 0.5::DOUBLE AS py, x, y FROM grid),
c AS (SELECT p.img, p.id, x + i AS cx, y + j AS cy, abs(1 - i - 0.25::DOUBLE) * abs(1 - j - 0.5::DOUBLE) AS w FROM p, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j))
SELECT c.img, CAST(c.id AS INTEGER) AS id, round(sum(w * coalesce(v, 0)), 6) AS value FROM c LEFT JOIN grid g ON c.img = g.img AND c.cx = g.x AND c.cy = g.y GROUP BY 1, 2
""")
def bilinear_sample(spark: SparkSession, d: str) -> DataFrame:
    cells = _scores(spark, d)
    points = cells.select((F.col("x") * 100 + F.col("y")).alias("id"), "img", (F.col("x") + 0.25).alias("px"), (F.col("y") + 0.5).alias("py"))
    return keypoints.bilinear(points, cells).select("img", "id", r6(F.col("value")).alias("value"))


@query("""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
o AS (SELECT vec_id, v, list_sum(list_transform(v, lambda x: abs(x))) AS n FROM e),
r AS (SELECT vec_id, list_transform(v, lambda x: sqrt(greatest(x / greatest(n, 1e-12), 1e-6))) AS r FROM o),
l AS (SELECT vec_id, r, sqrt(list_sum(list_transform(r, lambda x: x * x))) AS n FROM r)
SELECT vec_id, round(r[1] / n, 6) AS first, round(list_max(r) / n, 6) AS most, round(list_sum(r) / n, 5) AS total FROM l
""")
def rootsift_normalise(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", keypoints.root_normalised(F.col("embedding")).alias("r"))
    return rows.select("vec_id", r6(F.col("r")[0]).alias("first"), r6(F.array_max("r")).alias("most"), F.round(F.aggregate("r", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("""
WITH e AS (SELECT *, CAST(event_id % 854 AS DOUBLE) AS px, CAST(user_id % 480 AS DOUBLE) AS py FROM events)
SELECT event_id, round((px - 427) / 427, 6) AS nx, round((py - 240) / 427, 6) AS ny, round((px + 0.5) / 2 - 0.5, 6) AS bx, px >= 4 AND px < 850 AND py >= 4 AND py < 476 AS inside FROM e
""")
def normalise_keypoints(spark: SparkSession, d: str) -> DataFrame:
    x, y = (F.col("event_id") % 854).cast("double"), (F.col("user_id") % 480).cast("double")
    nx, ny = keypoints.normalised_points(x, y, F.lit(854.0), F.lit(480.0))
    return table(spark, d, "events").select("event_id", r6(nx).alias("nx"), r6(ny).alias("ny"), r6(keypoints.scaled_back(x, F.lit(2.0))).alias("bx"), keypoints.inside(x, y, 854, 480, 4).alias("inside"))


@query("""
WITH bad AS (SELECT DISTINCT CAST(l_quantity AS INTEGER) AS x, l_linenumber AS y FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)
SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.x = least(greatest(CAST(round_even(value, 0) AS INTEGER), 0), 50) AND bad.y = event_id % 8)
""")
def keypoints_outside_mask(spark: SparkSession, d: str) -> DataFrame:
    bad = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_quantity").cast("int").alias("x"), F.col("l_linenumber").cast("int").alias("y")).distinct()
    pts = table(spark, d, "events").select("event_id", F.least(F.greatest(F.rint("value").cast("int"), F.lit(0)), F.lit(50)).alias("x"), (F.col("event_id") % 8).cast("int").alias("y"))
    return pts.join(bad, ["x", "y"], "left_anti").select("event_id")


_PTS = "SELECT l_returnflag AS grp, l_quantity AS x, l_discount * 100 AS y, 1 + l_tax AS w FROM lineitem"


@query(f"""
WITH p AS ({_PTS}), c AS (SELECT grp, sum(w) AS t, sum(w * x) / sum(w) AS cx, sum(w * y) / sum(w) AS cy FROM p GROUP BY 1),
s AS (SELECT p.grp, cx, cy, sum(w * sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))) / t AS dist FROM p JOIN c ON p.grp = c.grp GROUP BY p.grp, cx, cy, t)
SELECT grp, round(cx, 6) AS cx, round(cy, 6) AS cy, round(dist, 6) AS dist, round(sqrt(2) / (dist + 1e-8), 6) AS scale FROM s
""")
def normalise_points_hartley(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (1 + F.col("l_tax")).alias("w"))
    return geometry.point_moments(p, "grp", "x", "y", "w").select("grp", *[r6(F.col(c)).alias(c) for c in ("cx", "cy", "dist", "scale")])


_R0, _R1 = ("x", "y", "1", "0", "0", "0", "-u*x", "-u*y"), ("0", "0", "0", "x", "y", "1", "-v*x", "-v*y")
_CELLS = ", ".join(f"round(avg(w*(({_R0[i]})*({_R0[j]})+({_R1[i]})*({_R1[j]}))), 5) AS a{i}{j}" for i in range(8) for j in range(i, 8))
_RIGHT = ", ".join(f"round(avg(w*(({_R0[i]})*u+({_R1[i]})*v)), 5) AS b{i}" for i in range(8))


@query(f"""
WITH p AS (SELECT l_returnflag AS grp, l_quantity / 50 AS x, l_discount * 10 AS y, l_quantity / 50 + 0.1 AS u, l_discount * 10 - 0.2 AS v, 1 + l_tax AS w FROM lineitem)
SELECT grp, count(*) AS n, {_CELLS}, {_RIGHT} FROM p GROUP BY grp
""")
def dlt_normal_matrix(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("l_quantity") / 50, F.col("l_discount") * 10
    p = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("grp"), x.alias("x"), y.alias("y"), (x + 0.1).alias("u"), (y - 0.2).alias("v"), (1 + F.col("l_tax")).alias("w"))
    sums = geometry.normal_sums(p, "grp", F.col("w"))
    return sums.select("grp", "n", *[F.round(F.col(c) / F.col("n"), 5).alias(c) for c in sums.columns[2:]])


@query("""
WITH k AS (SELECT o_orderpriority AS grp, CAST(left(o_orderpriority, 1) AS INTEGER) AS k FROM orders GROUP BY 1 HAVING count(*) >= 4)
SELECT grp, 1.0::DOUBLE AS h00, 0.0::DOUBLE AS h01, 3.0::DOUBLE * k AS h02, 0.0::DOUBLE AS h10, 1.1::DOUBLE AS h11, -2.0::DOUBLE * k AS h12, round(1e-5 * k, 5) AS h20, 0.0::DOUBLE AS h21, 1.0::DOUBLE AS h22 FROM k
""")
def homography_solve(spark: SparkSession, d: str) -> DataFrame:
    """Fits each order priority's transform from its orders as matches under a known one, which it must give back."""
    x, y = (F.col("o_orderkey") % 640).cast("double"), (F.col("o_custkey") % 480).cast("double")
    k = F.substring("o_orderpriority", 1, 1).cast("int")
    w = 1 + 1e-5 * k * x
    m = table(spark, d, "orders").select(F.col("o_orderpriority").alias("grp"), x.alias("x"), y.alias("y"), ((x + 3 * k) / w).alias("u"), ((1.1 * y - 2 * k) / w).alias("v"), F.lit(1.0).alias("w"))
    digits = dict.fromkeys(("h02", "h12"), 1) | dict.fromkeys(("h20", "h21"), 5)
    return geometry.solve_homographies(m, "grp").select("grp", *[(F.round(F.col(n), digits.get(n, 3)) + 0.0).alias(n) for n in geometry.NAMES])


def _transforms(spark: SparkSession, d: str) -> DataFrame:
    """A transform for each order."""
    k = F.col("o_orderkey").cast("double")
    f = lambda n: (F.col("o_orderkey") % n).cast("double")
    cells = (1 + f(7) / 10, (f(11) - 5) / 40, f(13) - 6, (f(5) - 2) / 40, 1 + f(3) / 10, f(17) - 8, (f(19) - 9) / 1e5, (f(23) - 11) / 1e5, F.lit(1.0))
    return table(spark, d, "orders").select("o_orderkey", *[c.alias(n) for c, n in zip(cells, geometry.NAMES)], k.alias("k"))


_H = """
h AS (SELECT o_orderkey, 1 + (o_orderkey % 7) / 10 AS h00, ((o_orderkey % 11) - 5) / 40 AS h01, (o_orderkey % 13) - 6.0::DOUBLE AS h02, ((o_orderkey % 5) - 2) / 40 AS h10, 1 + (o_orderkey % 3) / 10 AS h11,
      (o_orderkey % 17) - 8.0::DOUBLE AS h12, ((o_orderkey % 19) - 9) / 1e5 AS h20, ((o_orderkey % 23) - 11) / 1e5 AS h21, 1.0::DOUBLE AS h22 FROM orders)"""


@query(f"""
WITH {_H.strip()}, q AS (SELECT *, sqrt(h00*h00 + h10*h10 + 1e-8) AS r00, h00*h00 + h01*h01 + h10*h10 + h11*h11 AS tr, h00*h11 - h01*h10 AS det FROM h),
r AS (SELECT *, (h00*h01 + h10*h11) / r00 AS r01 FROM q),
s AS (SELECT *, degrees(abs(atan(r01 / (sqrt(greatest(h01*h01 + h11*h11 - r01*r01, 1e-8)) + 1e-8)))) AS shear, degrees(atan2(h10, h00)) AS rotation,
      greatest(sqrt((tr + sqrt(greatest(tr*tr - 4*det*det, 0))) / 2), 1 / sqrt(greatest((tr - sqrt(greatest(tr*tr - 4*det*det, 0))) / 2, 1e-16))) AS scale FROM r)
SELECT o_orderkey, round(shear, 6) AS shear, round(rotation, 6) AS rotation, round(scale, 6) AS scale, round(shear, 6) > 2 OR abs(round(rotation, 6)) > 2 OR round(scale, 6) > 1.5 AS reset FROM s
""")
def homography_decompose_reset(spark: SparkSession, d: str) -> DataFrame:
    """The engine's bounds are 15, 15 and 2; these transforms are milder, so 2, 2 and 1.5 here."""
    shear, rotation, scale = (r6(c) for c in geometry.decompose(geometry.entries()))
    rows = _transforms(spark, d).select("o_orderkey", shear.alias("shear"), rotation.alias("rotation"), scale.alias("scale"))
    return rows.withColumn("reset", geometry.needs_reset(F.col("shear"), F.col("rotation"), F.col("scale"), 2, 2, 1.5))


@query(f"""
WITH {_H.strip()}, det AS (SELECT *, h00*(h11*h22 - h12*h21) - h01*(h10*h22 - h12*h20) + h02*(h10*h21 - h11*h20) AS det FROM h)
SELECT o_orderkey, round((h11*h22 - h12*h21)/det, 6) + 0.0 AS h00, round((h02*h21 - h01*h22)/det, 6) + 0.0 AS h01, round((h01*h12 - h02*h11)/det, 6) + 0.0 AS h02,
       round((h12*h20 - h10*h22)/det, 6) + 0.0 AS h10, round((h00*h22 - h02*h20)/det, 6) + 0.0 AS h11, round((h02*h10 - h00*h12)/det, 6) + 0.0 AS h12,
       round((h10*h21 - h11*h20)/det, 8) + 0.0 AS h20, round((h01*h20 - h00*h21)/det, 8) + 0.0 AS h21, round((h00*h11 - h01*h10)/det, 6) + 0.0 AS h22 FROM det
""")
def inverse_3x3(spark: SparkSession, d: str) -> DataFrame:
    inv = geometry.inverse(geometry.entries())
    return _transforms(spark, d).select("o_orderkey", *[(F.round(inv[i][j], 8 if (i, j) in ((2, 0), (2, 1)) else 6) + 0.0).alias(f"h{i}{j}") for i in range(3) for j in range(3)])


_CORNER = ", ".join(f"({x}.0 * h00 + {y}.0 * h01 + h02) / greatest({x}.0 * h20 + {y}.0 * h21 + h22, 1e-6) AS u{i}, ({x}.0 * h10 + {y}.0 * h11 + h12) / greatest({x}.0 * h20 + {y}.0 * h21 + h22, 1e-6) AS v{i}" for i, (x, y) in enumerate((x, y) for x in (0, 639) for y in (0, 479)))


@query(f"""
WITH {_H.strip()}, c AS (SELECT o_orderkey, {_CORNER} FROM h)
SELECT o_orderkey, CAST(greatest(0, least(floor(least(u0, u1, u2, u3)), 1280)) AS BIGINT) AS x1, CAST(greatest(0, least(floor(least(v0, v1, v2, v3)), 960)) AS BIGINT) AS y1,
       CAST(greatest(0, least(ceil(greatest(u0, u1, u2, u3)), 1280)) AS BIGINT) AS x2, CAST(greatest(0, least(ceil(greatest(v0, v1, v2, v3)), 960)) AS BIGINT) AS y2 FROM c
""")
def project_corners_bbox(spark: SparkSession, d: str) -> DataFrame:
    return _transforms(spark, d).select("o_orderkey", geometry.corner_box(geometry.entries(), 640, 480, 1280, 960).alias("b")).select("o_orderkey", "b.*")


@query(_G + """, l AS (SELECT a.img, a.x, a.y, sum(CASE WHEN a.x = b.x AND a.y = b.y THEN -4 * b.v WHEN abs(a.x - b.x) + abs(a.y - b.y) = 1 THEN b.v ELSE 0 END) AS lap """ + _AROUND.format(r=1) + """)
SELECT img, round(var_pop(lap), 4) AS blur FROM l GROUP BY img""")
def laplacian_blur_score(spark: SparkSession, d: str) -> DataFrame:
    return raster.laplacian_variance(image_grid(spark, d)).select("img", F.round("blur", 4).alias("blur"))


@query(_G + " SELECT img, min(x) AS x1, min(y) AS y1, max(x) + 1 AS x2, max(y) + 1 AS y2, count(*) AS n, round(sqrt(count(*) / pi()), 6) AS radius FROM grid WHERE v > 30 GROUP BY img")
def roi_bbox(spark: SparkSession, d: str) -> DataFrame:
    return raster.regions(image_grid(spark, d).where("v > 30")).withColumn("radius", r6(F.col("radius")))


@query(_G + " SELECT a.img, a.x, a.y, coalesce(b.v, 0) AS v FROM grid a LEFT JOIN grid b ON a.img = b.img AND a.x = b.x + 3 AND a.y = b.y - 2")
def warp_gather_translate(spark: SparkSession, d: str) -> DataFrame:
    return raster.warp_nearest(image_grid(spark, d), 3, -2, 10**6, 10**6).select("img", "x", "y", "v")


@query(_G + """, p AS (SELECT *, (1.02 * x + 0.1 * y + 1) / greatest(0.001 * x + 1, 1e-8) AS u, (0.05 * x + 0.98 * y) / greatest(0.001 * x + 1, 1e-8) AS w FROM grid)
SELECT p.img, p.x, p.y, coalesce(g.v, 0) AS v FROM p LEFT JOIN grid g ON g.img = p.img AND g.x = CAST(round_even(p.u, 0) AS INTEGER) AND g.y = CAST(round_even(p.w, 0) AS INTEGER)""")
def warp_gather_projective(spark: SparkSession, d: str) -> DataFrame:
    """Each place takes the source pixel nearest to where the inverse transform sends it."""
    cells, f = image_grid(spark, d), lambda x: F.lit(float(x))
    u, v = geometry.apply([[f(1.02), f(0.1), f(1)], [f(0.05), f(0.98), f(0)], [f(0.001), f(0), f(1)]], F.col("x"), F.col("y"))
    return joins.gather(cells.select("img", "x", "y"), cells, F.rint(u), F.rint(v)).select("img", "x", "y", "v")


def _image_transforms(cells: DataFrame) -> DataFrame:
    """A transform for each image: all images are turned, scaled, moved and tilted differently."""
    k = F.col("img").cast("double")
    of = (1 + 0.05 * k, 0.02 * k, 2 * k - 1, 0.01 - 0.02 * k, 0.95 + 0.03 * k, 0.5 * k - 0.25, 0.0005 * k, 0.001 * k, F.lit(1.0))
    return cells.select("img").distinct().select("img", *[c.alias(n) for c, n in zip(of, geometry.NAMES)])


_WARP = f""", t AS (SELECT DISTINCT img, 1 + 0.05::DOUBLE * img AS h00, 0.02::DOUBLE * img AS h01, 2.0::DOUBLE * img - 1 AS h02, 0.01::DOUBLE - 0.02::DOUBLE * img AS h10, 0.95::DOUBLE + 0.03::DOUBLE * img AS h11, 0.5::DOUBLE * img - 0.25::DOUBLE AS h12, 0.0005::DOUBLE * img AS h20, 0.001::DOUBLE * img AS h21, 1.0::DOUBLE AS h22 FROM grid),
d AS (SELECT *, h00*(h11*h22 - h12*h21) - h01*(h10*h22 - h12*h20) + h02*(h10*h21 - h11*h20) AS det FROM t),
i AS (SELECT img, (h11*h22 - h12*h21)/det AS i00, (h02*h21 - h01*h22)/det AS i01, (h01*h12 - h02*h11)/det AS i02, (h12*h20 - h10*h22)/det AS i10, (h00*h22 - h02*h20)/det AS i11, (h02*h10 - h00*h12)/det AS i12, (h10*h21 - h11*h20)/det AS i20, (h01*h20 - h00*h21)/det AS i21, (h00*h11 - h01*h10)/det AS i22 FROM d),
spot AS (SELECT img, x, y, (i00*x + i01*y + i02) / greatest(i20*x + i21*y + i22, 1e-8) AS u, (i10*x + i11*y + i12) / greatest(i20*x + i21*y + i22, 1e-8) AS w FROM i, (SELECT CAST(unnest(range({WIDTH})) AS INTEGER) AS x), (SELECT CAST(unnest(range({HEIGHT})) AS INTEGER) AS y))"""


@query(_G + _WARP + " SELECT a.img, a.x, a.y, coalesce(g.v, 0) AS v FROM spot a LEFT JOIN grid g ON g.img = a.img AND g.x = round_even(a.u, 0) AND g.y = round_even(a.w, 0)")
def warp_images_nearest(spark: SparkSession, d: str) -> DataFrame:
    cells = image_grid(spark, d)
    return raster.warp(cells, _image_transforms(cells), WIDTH, HEIGHT)


@query(_G + _WARP + """, k AS (SELECT a.img, a.x, a.y, floor(u) + i AS sx, floor(w) + j AS sy, abs(1 - i - (u - floor(u))) * abs(1 - j - (w - floor(w))) AS f FROM spot a, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j))
SELECT k.img, k.x, k.y, round(sum(f * coalesce(g.v, 0)), 6) AS v FROM k LEFT JOIN grid g ON g.img = k.img AND g.x = k.sx AND g.y = k.sy GROUP BY 1, 2, 3""")
def warp_images_bilinear(spark: SparkSession, d: str) -> DataFrame:
    cells = image_grid(spark, d)
    return raster.warp(cells, _image_transforms(cells), WIDTH, HEIGHT, "bilinear").withColumn("v", r6(F.col("v")))


_PASTE = """, c AS (SELECT img, x, y, v FROM grid WHERE x < 30), w AS (SELECT img, x, y, 255 - v AS v, (x % 10) / 10 AS alpha FROM grid WHERE x >= 20 AND v > 40)"""


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    g = image_grid(spark, d)
    return g.where("x < 30"), g.where("x >= 20 and v > 40").select("img", "x", "y", (255 - F.col("v")).alias("v"), ((F.col("x") % 10) / 10).alias("alpha"))


@query(_G + _PASTE + """ SELECT coalesce(c.img, w.img) AS img, coalesce(c.x, w.x) AS x, coalesce(c.y, w.y) AS y, round(CASE WHEN c.x IS NULL THEN w.v WHEN w.x IS NULL THEN c.v ELSE c.v * (1 - alpha) + w.v * alpha END, 6) AS v FROM c FULL JOIN w ON c.img = w.img AND c.x = w.x AND c.y = w.y""")
def feather_paste(spark: SparkSession, d: str) -> DataFrame:
    return raster.paste(*_sides(spark, d)).select("img", "x", "y", r6(F.col("v")).alias("v"))


@query(_G + _PASTE + """ SELECT coalesce(c.img, w.img) AS img, coalesce(c.x, w.x) AS x, coalesce(c.y, w.y) AS y, CAST(coalesce(c.v, w.v) AS BIGINT) AS v FROM c FULL JOIN w ON c.img = w.img AND c.x = w.x AND c.y = w.y""")
def blurred_paste_only_new(spark: SparkSession, d: str) -> DataFrame:
    return raster.paste(*_sides(spark, d), only_new=True).select("img", "x", "y", F.col("v").cast("bigint").alias("v"))


@query(_G + _PASTE + """ SELECT CASE WHEN c.x IS NULL THEN 'only_new' WHEN w.x IS NULL THEN 'kept' ELSE 'overlap' END AS part, coalesce(c.img, w.img) AS img, count(*) AS n FROM c FULL JOIN w ON c.img = w.img AND c.x = w.x AND c.y = w.y GROUP BY 1, 2""")
def mask_partition(spark: SparkSession, d: str) -> DataFrame:
    return raster.paste(*_sides(spark, d)).groupBy("img", "part").agg(F.count("*").alias("n"))


@query(_G + """, d AS (SELECT a.img, a.x, a.y, min(greatest(abs(a.x - b.x), abs(a.y - b.y))) AS d FROM grid a LEFT JOIN grid b ON a.img = b.img AND b.v > 240 AND abs(a.x - b.x) <= 5 AND abs(a.y - b.y) <= 5 GROUP BY 1, 2, 3)
SELECT img, x, y, d, round(CASE WHEN d IS NULL THEN 0 ELSE greatest(0, least(1, (5 - greatest(d, 1) + 1) / 5)) END, 6) AS ramp FROM d""")
def distance_ramp(spark: SparkSession, d: str) -> DataFrame:
    return raster.chebyshev(image_grid(spark, d), F.col("v") > 240, 5).select("img", "x", "y", "d", r6(raster.ramp(F.col("d"), 5)).alias("ramp"))


@query(_G + f""", g AS (SELECT *, exp(-(pow(2.0 * x / {WIDTH - 1} - 1, 2) + pow(2.0 * y / {HEIGHT - 1} - 1, 2)) / (2 * 0.95 * 0.95)) AS g FROM grid),
m AS (SELECT max(exp(-(pow(2.0 * x / {WIDTH - 1} - 1, 2) + pow(2.0 * y / {HEIGHT - 1} - 1, 2)) / (2 * 0.95 * 0.95))) AS most FROM (SELECT unnest(range({WIDTH})) AS x), (SELECT unnest(range({HEIGHT})) AS y))
SELECT img, x, y, round(greatest(0, least(255, v + greatest(0, least(128, (1 - g / most) * (1 - g / most) * 64)))), 6) AS v FROM g, m""")
def vignette_correct(spark: SparkSession, d: str) -> DataFrame:
    v = raster.vignette(F.col("x"), F.col("y"), F.col("v"), WIDTH, HEIGHT)
    return image_grid(spark, d).select("img", "x", "y", r6(v).alias("v"))


@query(_G + """, c AS (SELECT *, v % 13 AS cls FROM grid)
SELECT img, x, y, round(0.5 * v + 0.5 * ((41 * cls + 73) % 256), 6) AS r, round(0.5 * v + 0.5 * ((17 * cls + 131) % 256), 6) AS g, round(0.5 * v + 0.5 * ((89 * cls + 29) % 256), 6) AS b,
       round(0.299 * v + 0.587 * (255 - v) + 0.114 * (v // 2), 6) AS luma FROM c""")
def palette_overlay(spark: SparkSession, d: str) -> DataFrame:
    v, colours = F.col("v"), raster.palette(F.col("v") % 13)
    luma = raster.gray(v, 255 - v, F.floor(v / 2))
    return image_grid(spark, d).select("img", "x", "y", *[r6(0.5 * v + 0.5 * c).alias(n) for c, n in zip(colours, "rgb")], r6(luma).alias("luma"))


@query(_G + """, c AS (SELECT img, x, y, v, k, v / 100 - k AS logit, CASE WHEN v % 3 = 0 THEN 1 WHEN v % 3 = 1 THEN 2 END AS m FROM grid, (SELECT unnest([0, 1, 2]) AS k))
SELECT img, x, y, k, round(CASE WHEN k = m THEN 255 WHEN k = 0 OR m IS NULL THEN logit ELSE 0 END, 6) AS logits, round(CASE WHEN k = m THEN 1 ELSE logit END, 6) AS sigmoid,
       round(CASE WHEN m IS NULL THEN logit WHEN k = m THEN 1 ELSE 0 END, 6) AS softmax FROM c""")
def output_override_modes(spark: SparkSession, d: str) -> DataFrame:
    m = F.when(F.col("v") % 3 == 0, 1).when(F.col("v") % 3 == 1, 2)
    rows = image_grid(spark, d).select("img", "x", "y", "v", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k")).withColumn("logit", F.col("v") / 100 - F.col("k")).withColumn("m", m)
    return rows.select("img", "x", "y", "k", *[r6(raster.overridden(F.col("logit"), F.col("k"), F.col("m"), mode)).alias(mode) for mode in ("logits", "sigmoid", "softmax")])


@query(_G + """, c AS (SELECT img, x, y, k, (v + 37 * k) % 101 / 25 AS logit FROM grid, (SELECT unnest([0, 1, 2]) AS k))
SELECT img, x, y, CAST(arg_max(k, logit * 1000 - k) AS INTEGER) AS label, round(max(exp(logit)) / sum(exp(logit)), 6) AS prob, CAST(1 / (1 + exp(1 - max(logit))) >= 0.5 AS INTEGER) AS binary_label FROM c GROUP BY 1, 2, 3""")
def logits_to_labels(spark: SparkSession, d: str) -> DataFrame:
    """Softmax and argmax over classes, ties to the lowest class; and the one-class form of the largest logit less 1."""
    logits = F.array(*[(F.col("v") + 37 * k) % 101 / 25 for k in range(3)])
    rows = image_grid(spark, d).select("img", "x", "y", logits.alias("l"))
    one = parsing.label_of(parsing.probabilities(F.array(F.array_max("l") - 1)))
    return rows.select("img", "x", "y", parsing.label_of(parsing.probabilities(F.col("l"))).alias("label"), r6(F.array_max(parsing.probabilities(F.col("l")))).alias("prob"), one.alias("binary_label"))


@query(_G + """, e AS (SELECT a.img, a.x, a.y, min(b.v) AS v """ + _AROUND.format(r=1) + """), o AS (SELECT a.img, a.x, a.y, max(b.v) AS v FROM e a JOIN e b ON a.img = b.img AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY 1, 2, 3)
SELECT img, x, y, v FROM o""")
def morphology_open(spark: SparkSession, d: str) -> DataFrame:
    return raster.morph(raster.morph(image_grid(spark, d), 1, largest=False), 1, largest=True).select("img", "x", "y", "v")


def _sizes(cells: DataFrame) -> DataFrame:
    """Sizes that differ by image, within what the images' cells cover."""
    return cells.select("img").distinct().select("img", (F.lit(WIDTH) - F.col("img")).alias("w"), F.lit(HEIGHT).alias("h"))


_PLACES = f""", spot AS (SELECT img, {WIDTH} - img AS w, {HEIGHT} AS h, x, y FROM (SELECT DISTINCT img FROM grid), (SELECT CAST(unnest(range(20)) AS INTEGER) AS x), (SELECT CAST(unnest(range(12)) AS INTEGER) AS y))"""
_BILINEAR = """, k AS (SELECT img, x, y, floor(u) + i AS sx, floor(v) + j AS sy, abs(1 - i - (u - floor(u))) * abs(1 - j - (v - floor(v))) AS f FROM uv, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j))
SELECT k.img, k.x, k.y, round(sum(f * coalesce(g.v, 0)), 6) AS v FROM k LEFT JOIN grid g ON g.img = k.img AND g.x = k.sx AND g.y = k.sy GROUP BY 1, 2, 3"""


@query(_G + _PLACES + " SELECT s.img, s.x, s.y, coalesce(g.v, 0) AS v FROM spot s LEFT JOIN grid g ON g.img = s.img AND g.x = floor(s.x * s.w / 20) AND g.y = floor(s.y * s.h / 12)")
def resize_nearest(spark: SparkSession, d: str) -> DataFrame:
    cells = image_grid(spark, d)
    return raster.resize(cells, _sizes(cells), 20, 12)


@query(_G + _PLACES + ", uv AS (SELECT img, x, y, greatest(0, least((x + 0.5) * w / 20 - 0.5, w - 1.0)) AS u, greatest(0, least((y + 0.5) * h / 12 - 0.5, h - 1.0)) AS v FROM spot)" + _BILINEAR)
def resize_bilinear(spark: SparkSession, d: str) -> DataFrame:
    cells = image_grid(spark, d)
    return raster.resize(cells, _sizes(cells), 20, 12, "bilinear").withColumn("v", r6(F.col("v")))


@query(_G + _PLACES + ", uv AS (SELECT img, x, y, x * (w - 1) / 19 AS u, y * (h - 1) / 11 AS v FROM spot)" + _BILINEAR)
def resize_bilinear_corners(spark: SparkSession, d: str) -> DataFrame:
    cells = image_grid(spark, d)
    return raster.resize(cells, _sizes(cells), 20, 12, "bilinear", align_corners=True).withColumn("v", r6(F.col("v")))


@query(_G + """, c AS (SELECT g.img, g.x, g.y, floor(x + 0.3 + 0.1 * g.img) + i AS sx, floor(y + 0.4) + j AS sy, abs(1 - i - (x + 0.3 + 0.1 * g.img - floor(x + 0.3 + 0.1 * g.img))) * abs(1 - j - 0.4) AS f FROM grid g, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)),
w AS (SELECT c.img, c.x, c.y, coalesce(b.v % 3, 0) AS cls, round(sum(f), 9) AS w FROM c LEFT JOIN grid b ON b.img = c.img AND b.x = c.sx AND b.y = c.sy GROUP BY 1, 2, 3, 4)
SELECT img, x, y, CAST(arg_max(cls, w * 1000 - cls / 1000) AS BIGINT) AS label FROM w GROUP BY 1, 2, 3""")
def label_warp_by_flow(spark: SparkSession, d: str) -> DataFrame:
    """Labels of the previous frame where each image's flow leads: each class's bilinear weight, the heaviest class wins."""
    cells = image_grid(spark, d)
    return raster.warp_labels(cells.withColumn("v", F.col("v") % 3), cells.select("img", "x", "y", (0.3 + 0.1 * F.col("img")).alias("dx"), F.lit(0.4).alias("dy")))


_PACKED = f""", dense AS (SELECT i.img, x, y, coalesce(g.v, 0) AS v FROM (SELECT DISTINCT img FROM grid) i CROSS JOIN (SELECT CAST(unnest(range({WIDTH})) AS INTEGER) AS x) a CROSS JOIN (SELECT CAST(unnest(range({HEIGHT})) AS INTEGER) AS y) b LEFT JOIN grid g USING (img, x, y))"""


@query(_G + _PACKED + f""" SELECT a.img, {HEIGHT} AS h, {WIDTH} AS w, string_agg(printf('%02X', CAST(coalesce(b.v, 0) AS INTEGER)), '' ORDER BY a.y, a.x) AS warped FROM dense a LEFT JOIN dense b ON a.img = b.img AND b.x = a.x - 3 AND b.y = a.y + 2 GROUP BY 1""")
def raster_udf_warp(spark: SparkSession, d: str) -> DataFrame:
    """The Arrow form of the warp on packed images, unpacked again."""
    packed = raster.pack(image_grid(spark, d), WIDTH, HEIGHT)
    m = (1.0, 0.0, 3.0, 0.0, 1.0, -2.0, 0.0, 0.0, 1.0)
    out = raster.warp_packed(packed.select("*", *[F.lit(v).alias(n) for v, n in zip(m, geometry.NAMES)]))
    return out.select("img", "h", "w", F.hex("warped").alias("warped"))


@query(_G + _PACKED + f""", e AS (SELECT a.*, (CASE WHEN a.x = 0 THEN r.v - a.v WHEN a.x = {WIDTH - 1} THEN a.v - l.v ELSE (r.v - l.v) / 2 END) AS gx, (CASE WHEN a.y = 0 THEN d.v - a.v WHEN a.y = {HEIGHT - 1} THEN a.v - u.v ELSE (d.v - u.v) / 2 END) AS gy FROM dense a
LEFT JOIN dense l ON l.img = a.img AND l.x = a.x - 1 AND l.y = a.y LEFT JOIN dense r ON r.img = a.img AND r.x = a.x + 1 AND r.y = a.y LEFT JOIN dense u ON u.img = a.img AND u.x = a.x AND u.y = a.y - 1 LEFT JOIN dense d ON d.img = a.img AND d.x = a.x AND d.y = a.y + 1)
SELECT img, {HEIGHT} AS h, {WIDTH} AS w, string_agg(printf('%02X', CAST(v // 64 AS INTEGER)), '' ORDER BY y, x) AS classes, 64 AS n_keypoints, round(max(sqrt(gx * gx + gy * gy)), 6) AS steepest FROM e GROUP BY img""")
def segment_stub_model(spark: SparkSession, d: str) -> DataFrame:
    """The model contract with its deterministic stub: classes of packed images and their keypoints' number."""
    packed = raster.pack(image_grid(spark, d), WIDTH, HEIGHT)
    kp = models.keypoints(packed).groupBy("img").agg(F.count("*").alias("n_keypoints"), F.round(F.max("score"), 6).alias("steepest"))
    return models.segment(packed).select("img", "h", "w", F.hex("classes").alias("classes")).join(kp, "img")


@query(_G + f""", s AS (SELECT DISTINCT img, {WIDTH} - img AS w, {HEIGHT} AS h FROM grid), e AS (SELECT *, CAST(floor(((8 - w % 8) % 8) / 2) AS INTEGER) AS l, CAST((8 - w % 8) % 8 AS INTEGER) AS more FROM s),
p AS (SELECT img, w, h, l, CAST(unnest(range(w + more)) AS INTEGER) AS x FROM e), q AS (SELECT *, CAST(unnest(range(h)) AS INTEGER) AS y FROM p)
SELECT q.img, q.x, q.y, coalesce(g.v, 0) AS v FROM q LEFT JOIN grid g ON g.img = q.img AND g.x = greatest(0, least(q.x - l, w - 1)) AND g.y = q.y""")
def replicate_padding(spark: SparkSession, d: str) -> DataFrame:
    cells = image_grid(spark, d)
    return raster.padded_image(cells, _sizes(cells))


def _patched(spark: SparkSession, d: str) -> DataFrame:
    cells = image_grid(spark, d)
    return cells.select("img", "x", "y", F.col("v").alias("canvas"), (255 - F.col("v")).alias("patch"), F.col("x").between(10, 39).alias("mask"))


_NEAR = "LEFT JOIN {t} l ON l.img = a.img AND l.x = a.x - 1 AND l.y = a.y LEFT JOIN {t} r ON r.img = a.img AND r.x = a.x + 1 AND r.y = a.y LEFT JOIN {t} u ON u.img = a.img AND u.x = a.x AND u.y = a.y - 1 LEFT JOIN {t} b ON b.img = a.img AND b.x = a.x AND b.y = a.y + 1"
_ROUND = "d{n} AS (SELECT a.img, a.x, a.y, a.c, a.p, a.m, a.i, CASE WHEN a.i THEN (coalesce(l.d, 0) + coalesce(r.d, 0) + coalesce(u.d, 0) + coalesce(b.d, 0)) / 4 ELSE a.d END AS d FROM d{k} a " + _NEAR + ")"


@query(_G + """, m AS (SELECT img, x, y, v AS c, 255 - v AS p, x BETWEEN 10 AND 39 AS m FROM grid),
i AS (SELECT a.*, a.m AND coalesce(l.m, false) AND coalesce(r.m, false) AND coalesce(u.m, false) AND coalesce(b.m, false) AS i FROM m a """ + _NEAR.format(t="m") + """),
d0 AS (SELECT *, CASE WHEN m AND NOT i THEN CAST(c - p AS DOUBLE) ELSE 0 END AS d FROM i), """ + ", ".join(_ROUND.format(n=n, k=n - 1, t=f"d{n - 1}") for n in (1, 2, 3)) + " SELECT img, x, y, round(CASE WHEN m THEN p + d ELSE c END, 6) AS v FROM d3")
def membrane_paste(spark: SparkSession, d: str) -> DataFrame:
    """A patch pasted with three Jacobi steps."""
    return raster.membrane_pasted(_patched(spark, d), 3).select("img", "x", "y", r6(F.col("v")).alias("v"))


@query(_G + """, b AS (SELECT img, 20 AS x1, 3 AS y1, 22 AS x2, 5 AS y2 FROM (SELECT DISTINCT img FROM grid)), ok AS (SELECT img, x, y FROM grid WHERE v > 5),
l AS (SELECT b.* REPLACE (coalesce((SELECT max(x) + 1 FROM (SELECT unnest(range(-1, 20)) AS x) c WHERE (SELECT count(*) FROM ok WHERE ok.img = b.img AND ok.x = c.x AND ok.y >= b.y1 AND ok.y < b.y2) < b.y2 - b.y1), 0) AS x1) FROM b),
r AS (SELECT l.* REPLACE (coalesce((SELECT min(x) FROM (SELECT unnest(range(22, 60)) AS x) c WHERE (SELECT count(*) FROM ok WHERE ok.img = l.img AND ok.x = c.x AND ok.y >= l.y1 AND ok.y < l.y2) < l.y2 - l.y1), 60) AS x2) FROM l),
u AS (SELECT r.* REPLACE (coalesce((SELECT max(y) + 1 FROM (SELECT unnest(range(-1, 3)) AS y) c WHERE (SELECT count(*) FROM ok WHERE ok.img = r.img AND ok.y = c.y AND ok.x >= r.x1 AND ok.x < r.x2) < r.x2 - r.x1), 0) AS y1) FROM r),
d AS (SELECT u.* REPLACE (coalesce((SELECT min(y) FROM (SELECT unnest(range(5, 12)) AS y) c WHERE (SELECT count(*) FROM ok WHERE ok.img = u.img AND ok.y = c.y AND ok.x >= u.x1 AND ok.x < u.x2) < u.x2 - u.x1), 12) AS y2) FROM u)
SELECT img, CAST(x1 AS BIGINT) AS x1, CAST(y1 AS BIGINT) AS y1, CAST(x2 AS BIGINT) AS x2, CAST(y2 AS BIGINT) AS y2 FROM d""")
def box_growth(spark: SparkSession, d: str) -> DataFrame:
    """One pass of growth from the middle: left, right, up, down, each seeing the edges before it."""
    return raster.grown_boxes(image_grid(spark, d), (20, 3, 22, 5), F.col("v") > 5, 1)


@query("""
WITH e AS (SELECT vec_id // 100 AS pair, vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
s AS (SELECT a.pair, a.id AS i, b.id AS j, round(list_inner_product(a.v, b.v), 6) AS score FROM e a JOIN e b ON a.pair = b.pair AND a.id % 2 = 0 AND b.id % 2 = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY pair, i ORDER BY score DESC, j) AS ri, row_number() OVER (PARTITION BY pair, j ORDER BY score DESC, i) AS rj FROM s)
SELECT pair, i, j, j % 640 AS x, j % 480 AS y, i % 640 AS u, i % 480 AS v FROM r WHERE ri = 1 AND rj = 1
""")
def matched_keypoint_places(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 100).alias("pair"), F.col("vec_id").alias("id"), F.col("embedding").alias("descriptor"), (F.col("vec_id") % 640).alias("x"), (F.col("vec_id") % 480).alias("y"))
    prev, curr = rows.where("id % 2 = 0"), rows.where("id % 2 = 1")
    return keypoints.matched_points(joins.matches(prev, curr, "pair"), prev, curr, "pair").select("pair", "i", "j", "x", "y", "u", "v")


@query("SELECT page_id, url FROM pages ORDER BY url, page_id LIMIT 20")
def sorted_paths(spark: SparkSession, d: str) -> DataFrame:
    """The first paths in order, as a numbered run over files takes them."""
    return table(spark, d, "pages").select("page_id", "url").orderBy("url", "page_id").limit(20)


@query("""
WITH p AS (SELECT doc_id, doc_id % 5 AS fold FROM documents), t AS (SELECT DISTINCT doc_id FROM labels)
SELECT fold, count(*) FILTER (t.doc_id IS NOT NULL) AS copied, count(*) FILTER (t.doc_id IS NULL) AS missing FROM p LEFT JOIN t ON t.doc_id = p.doc_id GROUP BY 1
""")
def truth_copies(spark: SparkSession, d: str) -> DataFrame:
    """Of each fold's documents, as predictions, how many have a label, as their truth."""
    path = lambda c, kind: F.concat(F.lit("x/video01/frame_"), F.col(c).cast("string"), F.lit(f"_{kind}_idx.png"))
    pred = table(spark, d, "documents").select(path("doc_id", "pred").alias("path"))
    truth = table(spark, d, "labels").select(path("doc_id", "gt").alias("path")).distinct()
    return files.copy_counts(files.matched_files(pred, truth).withColumn("fold", F.col("frame_id") % 5), "fold")
