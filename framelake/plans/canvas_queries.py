"""Canvases, crops, curved warps and balanced splits on the driver's tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions import models, parsing
from framelake.operators import geometry, joins, keypoints, raster, sequence, split, tiles
from framelake.plans.image_queries import _H, _transforms
from framelake.plans.registry import query, r6, table
from framelake.plans.tile_queries import _ALL, _CORNERS, _INVERSE, _SUMS, PHOTOS, SIDE, TALL, WIDE, _class_sums, _grid, _sql_bilinear, _sql_places, _sums, photo_cells, photo_tiles, photos
from framelake.plans.tile_queries import _transforms as _photo_transforms
from framelake.sources import files, frames
from framelake.sources.scratch import materialise, scratch_dir

_NINE = [(i, j) for i in range(3) for j in range(3)]


def _entry(a: list[list[str]], b: list[list[str]], i: int, j: int) -> str:
    return "(" + " + ".join(f"{a[i][k]} * {b[k][j]}" for k in range(3)) + ")"


def _product(a: list[list[str]], b: list[list[str]]) -> list[list[str]]:
    return [[_entry(a, b, i, j) for j in range(3)] for i in range(3)]


_M = [[f"h{i}{j}" for j in range(3)] for i in range(3)]
_TO, _BACK = [["2.0 / 639", "0.0", "-1.0"], ["0.0", "2.0 / 479", "-1.0"], ["0.0", "0.0", "1.0"]], [["319.5", "0.0", "319.5"], ["0.0", "239.5", "239.5"], ["0.0", "0.0", "1.0"]]


@query(f"WITH {_H.strip()} SELECT o_orderkey, " + ", ".join(f"round({_product(_TO, _product(_M, _BACK))[i][j]}, 6) + 0.0 AS n{i}{j}" for i, j in _NINE) + " FROM h")
def unit_homography_all(spark: SparkSession, d: str) -> DataFrame:
    """All entries of a pixel transform between coordinates from -1 to 1."""
    m = geometry.unit_transform(geometry.entries(), 640, 480, 640, 480)
    return _transforms(spark, d).select("o_orderkey", *[(r6(m[i][j]) + 0.0).alias(f"n{i}{j}") for i, j in _NINE])


_GROW, _MOVE = [["1.5", "0.0", "0.0"], ["0.0", "1.5", "0.0"], ["0.0", "0.0", "1.0"]], [["1.0", "0.0", "320.0"], ["0.0", "1.0", "240.5"], ["0.0", "0.0", "1.0"]]


@query(f"WITH {_H.strip()} SELECT o_orderkey, " + ", ".join(f"round({m[i][j]}, 6) + 0.0 AS {n}{i}{j}" for n, m in (("a", _product(_MOVE, _product(_GROW, _M))), ("b", _product(_GROW, _product(_MOVE, _M)))) for i, j in _NINE) + " FROM h")
def frame_to_canvas(spark: SparkSession, d: str) -> DataFrame:
    """Transforms into a canvas of 1.5 times the frame's resolution: grown before they are moved (a), and after (b)."""
    made = {n: geometry.to_canvas(geometry.entries(), F.lit(320.0), F.lit(240.5), F.lit(1.5), first) for n, first in (("a", True), ("b", False))}
    return _transforms(spark, d).select("o_orderkey", *[(r6(m[i][j]) + 0.0).alias(f"{n}{i}{j}") for n, m in made.items() for i, j in _NINE])


_MODES = "CASE k % 5 WHEN 0 THEN 'internal' WHEN 1 THEN 'external' WHEN 2 THEN 'first' WHEN 3 THEN 'entire' ELSE 'original' END"


@query(f"""WITH o AS (SELECT o_orderkey, o_orderkey // 8 + o_orderkey % 8 AS k FROM orders),
b AS (SELECT o_orderkey, k, {_MODES} AS mode, CASE WHEN k % 9 = 4 THEN 0 ELSE 3 + k % 5 END AS a1, CASE WHEN k % 9 = 4 THEN 0 ELSE 2 + k % 3 END AS a2, CASE WHEN k % 9 = 4 THEN 0 ELSE 30 - k % 4 END AS a3, CASE WHEN k % 9 = 4 THEN 0 ELSE 20 - k % 6 END AS a4,
    k % 14 - 2.5 AS p1, k % 11 - 1.25 AS p2, k % 14 + 4.0 + k % 13 * 2.5 AS p3, k % 11 + 3.5 + k % 7 * 2 AS p4, CASE WHEN k % 7 <> 0 THEN k % 6 + 0.5 END AS f1, CASE WHEN k % 7 <> 0 THEN k % 4 - 0.5 END AS f2, CASE WHEN k % 7 <> 0 THEN k % 6 + 20.25 END AS f3, CASE WHEN k % 7 <> 0 THEN k % 4 + 9.75 END AS f4 FROM o),
c AS (SELECT *, CASE WHEN mode = 'first' THEN coalesce(f1, p1) ELSE p1 END AS s1, CASE WHEN mode = 'first' THEN coalesce(f2, p2) ELSE p2 END AS s2, CASE WHEN mode = 'first' THEN coalesce(f3, p3) ELSE p3 END AS s3, CASE WHEN mode = 'first' THEN coalesce(f4, p4) ELSE p4 END AS s4 FROM b),
r AS (SELECT *, greatest(0, floor(s1)) AS x1, greatest(0, floor(s2)) AS y1, least(36, ceil(s3)) AS x2, least(24, ceil(s4)) AS y2 FROM c),
t AS (SELECT *, x2 <= x1 OR y2 <= y1 AS nothing, x1 >= a1 AND x2 <= a3 AND y1 >= a2 AND y2 <= a4 AND a3 > a1 AS inside FROM r),
m AS (SELECT o_orderkey, mode, CASE WHEN mode = 'entire' THEN 0 WHEN mode = 'external' AND a3 > a1 THEN 1 WHEN nothing THEN 0 WHEN mode = 'internal' AND inside THEN 1 ELSE 2 END AS pick, x1, y1, x2, y2, a1, a2, a3, a4 FROM t)
SELECT o_orderkey, mode, CAST(CASE pick WHEN 0 THEN 0 WHEN 1 THEN a1 ELSE x1 END AS INTEGER) AS cx1, CAST(CASE pick WHEN 0 THEN 0 WHEN 1 THEN a2 ELSE y1 END AS INTEGER) AS cy1,
       CAST(CASE pick WHEN 0 THEN 36 WHEN 1 THEN a3 ELSE x2 END AS INTEGER) AS cx2, CAST(CASE pick WHEN 0 THEN 24 WHEN 1 THEN a4 ELSE y2 END AS INTEGER) AS cy2 FROM m""")
def crop_modes(spark: SparkSession, d: str) -> DataFrame:
    """All crops of canvases whose painted part, projected frame and first frame vary."""
    o = table(spark, d, "orders").select("o_orderkey", (F.floor(F.col("o_orderkey") / 8) + F.col("o_orderkey") % 8).cast("int").alias("k"))

    def paint(batches):
        y, x = np.mgrid[:24, :36]
        for batch in batches:
            ks = batch.column("k").to_pylist()
            masks = [((k % 9 != 4) & (x >= 3 + k % 5) & (x < 30 - k % 4) & (y >= 2 + k % 3) & (y < 20 - k % 6)).astype("u1").tobytes() for k in ks]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(masks, pa.binary())], [*batch.schema.names, "mask"])

    k, mode = F.col("k"), F.when(F.col("k") % 5 == 0, "internal").when(F.col("k") % 5 == 1, "external").when(F.col("k") % 5 == 2, "first").when(F.col("k") % 5 == 3, "entire").otherwise("original")
    first = lambda c: F.when(k % 7 != 0, c)
    rows = o.mapInArrow(paint, "o_orderkey long, k int, mask binary").select(
        "o_orderkey", F.lit(24).alias("h"), F.lit(36).alias("w"), "mask", mode.alias("mode"),
        (k % 14 - 2.5).alias("x1"), (k % 11 - 1.25).alias("y1"), (k % 14 + 4.0 + k % 13 * 2.5).alias("x2"), (k % 11 + 3.5 + k % 7 * 2).alias("y2"),
        first(k % 6 + 0.5).alias("fx1"), first(k % 4 - 0.5).alias("fy1"), first(k % 6 + 20.25).alias("fx2"), first(k % 4 + 9.75).alias("fy2"),
    )
    return raster.cropped_boxes(rows).select("o_orderkey", "mode", "cx1", "cy1", "cx2", "cy2")


@query("""WITH p AS (SELECT event_id, event_type AS img, value AS x, CAST(user_id AS DOUBLE) AS y FROM events), s AS (SELECT img, 1 + max(x) - min(x) AS w, 1 + max(y) - min(y) AS h FROM p GROUP BY 1),
z AS (SELECT img, CASE WHEN img = 'view' THEN 640.0::DOUBLE ELSE w END AS w, CASE WHEN img = 'view' THEN 480.0::DOUBLE ELSE h END AS h FROM s)
SELECT event_id, round((x - w / 2) / (greatest(w, h) / 2), 10) + 0.0 AS nx, round((y - h / 2) / (greatest(w, h) / 2), 10) + 0.0 AS ny FROM p JOIN z USING (img)""")
def keypoints_by_range(spark: SparkSession, d: str) -> DataFrame:
    """Keypoints normalised by their image's size, or where that lacks by the range that they span."""
    p = table(spark, d, "events").select("event_id", F.col("event_type").alias("img"), F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"))
    sizes = p.select("img").distinct().where("img = 'view'").select("img", F.lit(640.0).alias("w"), F.lit(480.0).alias("h"))
    return keypoints.normalised(p, "img", sizes).select("event_id", (F.round("nx", 10) + 0.0).alias("nx"), (F.round("ny", 10) + 0.0).alias("ny"))


@query(f"""WITH {PHOTOS}, {_ALL} SELECT img, count(*) FILTER (WHERE r / 255.0::DOUBLE > 0.5 OR g / 255.0::DOUBLE > 0.5 OR (x - 20) * (x - 20) + (y - 12) * (y - 12) > 150) AS occluded, CAST(coalesce(sum(x * 31 + y) FILTER (WHERE r / 255.0::DOUBLE > 0.5 OR g / 255.0::DOUBLE > 0.5 OR (x - 20) * (x - 20) + (y - 12) * (y - 12) > 150), 0) AS BIGINT) AS places FROM whole GROUP BY 1""")
def occlusion_masks(spark: SparkSession, d: str) -> DataFrame:
    """Two models' masks and the scope's outside, joined."""
    x, y = F.col("x"), F.col("y")
    hit = raster.joined_masks(F.col("r") / 255.0, F.col("g") / 255.0, ((x - 20) * (x - 20) + (y - 12) * (y - 12) > 150).cast("int"))
    return _grid(spark, d).groupBy("img").agg(F.count_if(hit).alias("occluded"), F.coalesce(F.sum(F.when(hit, (x * 31 + y).cast("bigint"))), F.lit(0)).alias("places"))


_LAGS = "seg AS (SELECT s_suppkey AS video, s_nationkey * 3 AS start_frame, s_nationkey * 3 + 10 + s_suppkey % 50 AS end_frame, s_nationkey * 3 + s_suppkey % 7 - 2 AS startpoint FROM supplier)"


@query(f"""WITH {_LAGS}, x AS (SELECT video, startpoint, unnest(range(start_frame, end_frame + 1)) AS frame_id FROM seg)
SELECT video, CAST(frame_id AS BIGINT) AS frame_id, CAST(greatest(0, ceil((frame_id - startpoint) / 6)) AS BIGINT) AS "offset" FROM x""")
def lag_of_suppliers(spark: SparkSession, d: str) -> DataFrame:
    """Frames of each supplier's segment with their running lag."""
    n, k = F.col("s_nationkey").cast("long") * 3, F.col("s_suppkey").cast("long")
    seg = table(spark, d, "supplier").select(k.alias("video"), n.alias("start_frame"), (n + 10 + k % 50).alias("end_frame"), (n + k % 7 - 2).alias("startpoint"))
    return joins.expand_lag(seg)


@query("SELECT event_id, first_value(CASE WHEN value >= 5 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mask FROM events")
def first_mask_carried(spark: SparkSession, d: str) -> DataFrame:
    """What a video's first usable frame gives, on all frames from there on."""
    kept = sequence.first_carried(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.when(F.col("value") >= 5, F.col("event_type")), "mask")
    return kept.select("event_id", "mask")


@query("""WITH t AS (SELECT vec_id, 1 / (1 + exp(-10 * CAST(embedding[1] AS DOUBLE))) AS confidence, 1 / (1 + exp(-8 * CAST(embedding[2] AS DOUBLE))) AS matchability FROM embeddings)
SELECT vec_id, round(matchability, 9) > 0.35 OR round(confidence, 9) <= 0.8 + 0.1 * exp(-4.0 * 3 / 9) AS kept FROM t""")
def pruned_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens that a matcher's fourth layer still works on."""
    share = lambda i, by: F.round(1 / (1 + F.exp(-by * F.col("embedding")[i].cast("double"))), 9)
    return table(spark, d, "embeddings").select("vec_id", keypoints.pruned(share(0, 10), share(1, 8), 3, 9, 0.65).alias("kept"))


@query("""WITH t AS (SELECT conv_id, list(turn ORDER BY turn) AS v FROM conversations WHERE turn IS NOT NULL GROUP BY 1)
SELECT conv_id, array_to_string(list_resize(v, 5, -1), ',') AS turns FROM t""")
def fixed_length_turns(spark: SparkSession, d: str) -> DataFrame:
    """Lists cut or filled up to a length."""
    lists = table(spark, d, "conversations").where("turn is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.col("turn").cast("double"))).alias("v"))
    return lists.select("conv_id", F.array_join(F.transform(keypoints.fixed_length(F.col("v"), 5, -1.0), lambda x: x.cast("int").cast("string")), ",").alias("turns"))


@query(f"""WITH {PHOTOS}, box AS (SELECT img, img % 9 - 3 AS x0, img % 7 - 2 AS y0, img % 9 + 8 + img % 31 AS x1, img % 7 + 6 + img % 19 AS y1 FROM sizes),
cut AS (SELECT img, greatest(0, x0) AS x0, greatest(0, y0) AS y0, least({WIDE}, x1) AS x1, least({TALL}, y1) AS y1 FROM box),
hit AS (SELECT p.img, p.x - x0 AS x, p.y - y0 AS y, p.c, p.v FROM photo p JOIN cut ON cut.img = p.img AND p.x >= x0 AND p.x < x1 AND p.y >= y0 AND p.y < y1) {_SUMS}""")
def roi_crop(spark: SparkSession, d: str) -> DataFrame:
    """Three channels cut to a box of each image's own; moments from the box's corner."""
    k = F.col("l_suppkey")
    boxes = table(spark, d, "lineitem").select(k).distinct().select(k.alias("img"), (k % 9 - 3).alias("x0"), (k % 7 - 2).alias("y0"), (k % 9 + 8 + k % 31).alias("x1"), (k % 7 + 6 + k % 19).alias("y1"))
    return _sums(tiles.crop(photos(spark, d), boxes, SIDE), "u1").where("total > 0")


_P = [["1.0", "0.0", "2.0"], ["0.0", "1.0", "3.0"], ["0.0", "0.0", "1.0"]]
_P_BACK = [["1.0", "0.0", "-2.0"], ["0.0", "1.0", "-3.0"], ["0.0", "0.0", "1.0"]]
_PH = [["ha", "hb", "hc"], ["hd", "he", "hf"], ["hg", "hh", "hi"]]


def _sql_led(m: list[list[str]]) -> str:
    """hit (img, x, y, c, v): the value at the nearest place to which the matrix m of h leads; 0 outside."""
    at = [f"({m[i][0]} * p.x + {m[i][1]} * p.y + {m[i][2]})" for i in range(3)]
    return f"""spot AS (SELECT p.img, p.x, p.y, p.c, round_even({at[0]} / greatest({at[2]}, 1e-8), 0) AS u, round_even({at[1]} / greatest({at[2]}, 1e-8), 0) AS w FROM places p JOIN det ON det.img = p.img WHERE det IS NOT NULL),
    hit AS (SELECT a.img, a.x, a.y, a.c, coalesce(p.v, 0) AS v FROM spot a LEFT JOIN photo p ON p.img = a.img AND p.x = a.u AND p.y = a.w AND p.c = a.c)"""


def _canvas_matrices(spark: SparkSession, d: str) -> tuple[DataFrame, list, list]:
    h = _photo_transforms(spark, d).where("h22 <> 0")
    move = [[F.lit(float(x)) for x in row] for row in _P]
    return h, geometry.product(move, geometry.entries()), move


@query(f"WITH {PHOTOS}, {_sql_places(WIDE, TALL)}, {_INVERSE}, {_sql_led(_product(_product(_P, _PH), _P_BACK))} {_SUMS}")
def canvas_reoriented(spark: SparkSession, d: str) -> DataFrame:
    """A canvas turned so that the frame that lay under P H lies straight: each place comes from P H P^-1."""
    h, to, move = _canvas_matrices(spark, d)
    turned = geometry.product(move, geometry.inverse(to))
    m = h.select("img", *[turned[i][j].alias(f"h{i}{j}") for i, j in _NINE])
    return _sums(tiles.warp(photos(spark, d), m, WIDE, TALL, "nearest", SIDE), "u1")


@query(f"WITH {PHOTOS}, {_sql_places(30, 20)}, {_INVERSE}, {_sql_led(_product(_P, _PH))} {_SUMS}")
def canvas_in_frame(spark: SparkSession, d: str) -> DataFrame:
    """The canvas as the current frame sees it: each place of the frame comes from P H."""
    h, to, _ = _canvas_matrices(spark, d)
    inv = geometry.inverse(to)
    m = h.select("img", *[inv[i][j].alias(f"h{i}{j}") for i, j in _NINE])
    return _sums(tiles.warp(photos(spark, d), m, 30, 20, "nearest", SIDE), "u1")


_CENTRES = ((8.0, 5.0), (30.0, 7.0), (19.0, 18.0))


def _pull(side: str, x: str, y: str) -> str:
    """SQL of a coordinate under the spline of img; side: u or v."""
    r2 = [f"(({x} - {cx}) * ({x} - {cx}) + ({y} - {cy}) * ({y} - {cy}))" for cx, cy in _CENTRES]
    affine = f"{x} * 1.03 + {y} * 0.02 - 0.71 + img % 3" if side == "u" else f"{y} * 0.97 - {x} * 0.015 + 0.37 - img % 2"
    weights = ("(img % 5 - 2) / 317.0", "(img % 7 - 3) / 411.0", "(img % 4 - 1) / 523.0") if side == "u" else ("(img % 3 - 1) / 367.0", "(img % 5 - 2) / 433.0", "(img % 6 - 3) / 613.0")
    return f"({affine} + " + " + ".join(f"{w}::DOUBLE * {r} * CASE WHEN {r} > 0 THEN ln({r}) ELSE 0 END / 2" for w, r in zip(weights, r2)) + ")"


@query(f"""WITH {PHOTOS}, {_sql_places(WIDE, TALL)},
node AS (SELECT img, nx, ny, {_pull("u", "nx * 4.0::DOUBLE", "ny * 4.0::DOUBLE")} AS u, {_pull("v", "nx * 4.0::DOUBLE", "ny * 4.0::DOUBLE")} AS w FROM sizes, (SELECT unnest(range({WIDE // 4 + 2})) AS nx), (SELECT unnest(range({TALL // 4 + 2})) AS ny)),
spot AS (SELECT p.img, p.x, p.y, p.c, sum(abs(1 - i - (p.x % 4) / 4.0::DOUBLE) * abs(1 - j - (p.y % 4) / 4.0::DOUBLE) * n.u) AS u, sum(abs(1 - i - (p.x % 4) / 4.0::DOUBLE) * abs(1 - j - (p.y % 4) / 4.0::DOUBLE) * n.w) AS w
    FROM places p, {_CORNERS}, node n WHERE n.img = p.img AND n.nx = p.x // 4 + i AND n.ny = p.y // 4 + j GROUP BY 1, 2, 3, 4),
{_sql_bilinear(False)} {_SUMS}""")
def curved_warp(spark: SparkSession, d: str) -> DataFrame:
    """Three channels under a thin-plate spline for each image, computed on every fourth place."""
    k = F.col("l_suppkey")
    f = lambda *v: F.array(*[F.lit(x) if isinstance(x, float) else x.cast("double") for x in v])
    splines = table(spark, d, "lineitem").select(k).distinct().select(
        k.alias("img"), f(*[c[0] for c in _CENTRES]).alias("cx"), f(*[c[1] for c in _CENTRES]).alias("cy"),
        f((k % 5 - 2) / 317.0, (k % 7 - 3) / 411.0, (k % 4 - 1) / 523.0).alias("wx"), f((k % 3 - 1) / 367.0, (k % 5 - 2) / 433.0, (k % 6 - 3) / 613.0).alias("wy"),
        f(-0.71 + k % 3, 1.03, 0.02).alias("ax"), f(0.37 - k % 2, -0.015, 0.97).alias("ay"),
    )
    return _sums(tiles.spline_warp(photos(spark, d), splines, WIDE, TALL, "bilinear", 4, SIDE, out="f8"), "f8")


@query("""WITH RECURSIVE k AS (SELECT o_custkey % 97 AS grp, o_orderkey % 3 AS s FROM orders),
t AS (SELECT count(*) FILTER (s = 0) AS t0, count(*) FILTER (s = 1) AS t1, count(*) FILTER (s = 2) AS t2 FROM k),
g AS (SELECT grp, count(*) AS n, count(*) FILTER (s = 0) AS c0, count(*) FILTER (s = 1) AS c1, count(*) FILTER (s = 2) AS c2 FROM k GROUP BY 1),
p AS (SELECT g.*, t.*, c0 / t0::DOUBLE AS s0, c1 / t1::DOUBLE AS s1, c2 / t2::DOUBLE AS s2 FROM g, t),
o AS (SELECT *, row_number() OVER (ORDER BY -round(pow(s0 - (s0 + s1 + s2) / 3, 2) + pow(s1 - (s0 + s1 + s2) / 3, 2) + pow(s2 - (s0 + s1 + s2) / 3, 2), 12), -n, grp) AS rn FROM p),
f AS (
    SELECT 0::BIGINT AS rn, 0::BIGINT AS grp, 0::BIGINT AS n, 0 AS fold, [[0, 0, 0], [0, 0, 0], [0, 0, 0], [0, 0, 0], [0, 0, 0]]::BIGINT[][] AS held
    UNION ALL
    SELECT rn, grp, n, best, list_transform(held, lambda h, i: CASE WHEN i - 1 = best THEN [h[1] + c0, h[2] + c1, h[3] + c2] ELSE h END)
    FROM (SELECT o.rn, o.grp, o.n, o.c0, o.c1, o.c2, f.held, list_min(list_transform(f.held, lambda h, i: struct_pack(a := round(h[1] * o.c0 / (o.t0 * o.t0)::DOUBLE + h[2] * o.c1 / (o.t1 * o.t1)::DOUBLE + h[3] * o.c2 / (o.t2 * o.t2)::DOUBLE, 12), b := h[1] + h[2] + h[3], c := i - 1))).c AS best
          FROM f JOIN o ON o.rn = f.rn + 1)
) SELECT grp, n, CAST(fold AS INTEGER) AS fold FROM f WHERE rn > 0""")
def balanced_group_folds(spark: SparkSession, d: str) -> DataFrame:
    """Customers' orders dealt to five folds by group, so that their strata spread least."""
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 97).alias("grp"), (F.col("o_orderkey") % 3).alias("s"))
    return split.balanced_folds(rows, "grp", F.col("s")).select("grp", "n", "fold")


@query(f"WITH {PHOTOS}, {_ALL} SELECT 'video' || img || '/frame_0.png' AS file, CAST(sum(r) AS BIGINT) AS total, CAST(sum(r * (x + 1)) AS BIGINT) AS by_x, CAST(sum(r * (y + 1)) AS BIGINT) AS by_y FROM whole GROUP BY img")
def image_files_there_and_back(spark: SparkSession, d: str) -> DataFrame:
    """A channel of each image written as a file, and what the image source reads from it."""
    frames.register(spark)
    root = f"{scratch_dir(spark)}/images"
    plain = tiles.untiled(photo_tiles(spark, d, 1), SIDE)
    rows = plain.select(F.concat(F.lit("video"), F.col("img").cast("string")).alias("video"), F.lit(0).alias("frame_id"), "h", "w", F.col("pixels").alias("classes"))
    frames.class_files(rows).write.format("frame_files").mode("append").save(root)
    read = files.images(spark, root, "*.png").where("status = 'ok'").withColumnRenamed("path", "img")
    sums = tiles.moments(tiles.tiled(read, side=SIDE), SIDE)
    name = F.concat_ws("/", F.element_at(F.split("img", "/"), -2), F.element_at(F.split("img", "/"), -1))
    return sums.select(name.alias("file"), *[F.col(c).cast("bigint").alias(c) for c in ("total", "by_x", "by_y")])


@query("SELECT l_suppkey AS video, l_partkey % 5 AS cls, CAST(round(avg(l_quantity), 6) AS DOUBLE) AS dice FROM lineitem WHERE l_quantity > 10 GROUP BY 1, 2")
def metrics_as_csv(spark: SparkSession, d: str) -> DataFrame:
    """A metric table written as CSV, without rows that have no value, and read back."""
    out = f"{scratch_dir(spark)}/metrics"
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("video"), (F.col("l_partkey") % 5).alias("cls")).agg(r6(F.avg(F.when(F.col("l_quantity") > 10, F.col("l_quantity")))).alias("dice"))
    files.write_metrics(rows, out)
    return spark.read.schema("video long, cls long, dice double").option("header", True).csv(out)


@query("SELECT CAST(o_custkey % 5 AS INTEGER) AS fold, CASE WHEN o_orderstatus = 'F' THEN 'test' ELSE 'train' END AS part, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1, 2")
def folds_as_folders(spark: SparkSession, d: str) -> DataFrame:
    """A split written with a folder for each fold and part, and read back."""
    out = f"{scratch_dir(spark)}/folds"
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 5).alias("fold"), F.when(F.col("o_orderstatus") == "F", "test").otherwise("train").alias("part"))
    files.write_folds(rows, out)
    back = spark.read.schema("o_orderkey long, fold int, part string").option("header", True).csv(out)
    return back.groupBy("fold", "part").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("SELECT event_type, count(*) AS n, CAST(max(user_id) AS BIGINT) AS most FROM events GROUP BY 1")
def report_as_json(spark: SparkSession, d: str) -> DataFrame:
    """A report written as JSON lines and read back."""
    out = f"{scratch_dir(spark)}/report"
    files.write_report(table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max("user_id").alias("most")), out)
    return spark.read.schema("event_type string, n long, most long").json(out)


@query(f"""WITH {PHOTOS}, small AS (SELECT img, x, y, r FROM cells WHERE x < 20 AND y < 12 AND img % 3 <> 0 UNION ALL SELECT img, x, y, r FROM cells WHERE img % 3 = 0),
sizes2 AS (SELECT img, max(x) + 1 AS gw, max(y) + 1 AS gh FROM cells GROUP BY 1), sizes1 AS (SELECT img, max(x) + 1 AS pw, max(y) + 1 AS ph FROM small GROUP BY 1)
SELECT c.img, CAST(c.x AS INTEGER) AS x, CAST(c.y AS INTEGER) AS y, coalesce(s.r % 7, 0) AS pred, c.r % 5 AS gt FROM cells c JOIN sizes2 g ON g.img = c.img JOIN sizes1 p ON p.img = c.img LEFT JOIN small s ON s.img = c.img AND s.x = c.x * pw // gw AND s.y = c.y * ph // gh""")
def aligned_labels(spark: SparkSession, d: str) -> DataFrame:
    """Predictions joined to truths place by place, brought to their size where that differs."""
    cells = photo_cells(spark, d)
    gt = cells.select("img", "x", "y", (F.col("r") % 5).alias("v"))
    pred = cells.where("img % 3 = 0 or (x < 20 and y < 12)").select("img", "x", "y", (F.col("r") % 7).alias("v"))
    return joins.aligned(pred, gt).select("img", "x", "y", F.col("pred").cast("int").alias("pred"), F.col("gt").cast("int").alias("gt"))


@query(f"WITH {PHOTOS}, {_ALL} SELECT img, CAST(sum(CASE WHEN r > 128 THEN 255 ELSE 0 END) AS BIGINT) AS mask, CAST(sum(CASE WHEN r > 128 THEN 0 ELSE 255 END) AS BIGINT) AS rest FROM whole GROUP BY 1")
def mask_complement(spark: SparkSession, d: str) -> DataFrame:
    """Masks and what they leave."""
    mask = F.when(parsing.mask_set(F.col("r") / 256.0), 255).otherwise(0)
    return _grid(spark, d).select("img", mask.alias("m")).groupBy("img").agg(F.sum("m").alias("mask"), F.sum(raster.complement(F.col("m"))).cast("bigint").alias("rest"))


@query(f"""WITH {PHOTOS}, {_sql_places(30, 20)}, {_INVERSE}, box AS (SELECT img, img % 9 + 2 AS x0, img % 7 + 1 AS y0, img % 9 + 14 + img % 15 AS x1, img % 7 + 9 + img % 8 AS y1 FROM sizes),
led AS (SELECT p.img, p.x, p.y, ({_product(_P, _PH)[0][0]} * p.x + {_product(_P, _PH)[0][1]} * p.y + {_product(_P, _PH)[0][2]}) / greatest({_product(_P, _PH)[2][0]} * p.x + {_product(_P, _PH)[2][1]} * p.y + {_product(_P, _PH)[2][2]}, 1e-8) AS u,
    ({_product(_P, _PH)[1][0]} * p.x + {_product(_P, _PH)[1][1]} * p.y + {_product(_P, _PH)[1][2]}) / greatest({_product(_P, _PH)[2][0]} * p.x + {_product(_P, _PH)[2][1]} * p.y + {_product(_P, _PH)[2][2]}, 1e-8) AS w FROM places p JOIN det ON det.img = p.img WHERE det IS NOT NULL AND p.c = 0)
SELECT l.img, CAST(coalesce(c.r, 0) // 64 AS INTEGER) AS cls, count(*) AS n, CAST(sum(l.x * 31 + l.y) AS BIGINT) AS places FROM led l JOIN box b ON b.img = l.img
LEFT JOIN cells c ON c.img = l.img AND c.x = round_even(l.u, 0) AND c.y = round_even(l.w, 0) AND c.x >= b.x0 AND c.x < b.x1 AND c.y >= b.y0 AND c.y < b.y1 GROUP BY 1, 2""")
def model_on_crops(spark: SparkSession, d: str) -> DataFrame:
    """Crops of canvases given to a model, its classes placed in the canvas and led back to the frame."""
    k = F.col("l_suppkey")
    boxes = table(spark, d, "lineitem").select(k).distinct().select(k.alias("img"), (k % 9 + 2).alias("x0"), (k % 7 + 1).alias("y0"), (k % 9 + 14 + k % 15).alias("x1"), (k % 7 + 9 + k % 8).alias("y1"))
    canvas = materialise(photo_tiles(spark, d, 1), "canvas")
    classes = models.segment(tiles.untiled(tiles.crop(canvas, boxes, SIDE), SIDE).select("img", "h", "w", "pixels")).withColumnRenamed("classes", "pixels")
    placed = materialise(tiles.place(materialise(tiles.tiled(classes, side=SIDE), "classes"), boxes, WIDE, TALL, SIDE), "placed")
    h, to, _ = _canvas_matrices(spark, d)
    inv = geometry.inverse(to)
    return _class_sums(tiles.warp(placed, h.select("img", *[inv[i][j].alias(f"h{i}{j}") for i, j in _NINE]), 30, 20, "nearest", SIDE))
