"""Tiles against whole images: conversions, warps, resizes, and what is moved for them."""

import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framelake.operators import geometry, raster, tiles
from framelake.sources import files


def photos(spark, shapes, n=3):
    rng = np.random.default_rng(2)
    made = {k: rng.integers(0, 256, (*shape, n), "u1") for k, shape in enumerate(shapes)}
    rows = [(k, a.shape[0], a.shape[1], bytearray(a.tobytes())) for k, a in made.items()]
    return made, spark.createDataFrame(rows + [(None, 1, 1, bytearray(n)), (99, 1, 1, None)], "img int, h int, w int, pixels binary")


def back(df, kind="u1", side=16):
    return {r["img"]: np.frombuffer(bytes(r["pixels"]), kind).reshape(r["h"], r["w"], r["n"]) for r in tiles.untiled(df, side, kind).collect()}


def test_tiles_there_and_back(spark):
    made, df = photos(spark, [(40, 50), (16, 16), (1, 33)])
    got = back(tiles.tiled(df, 3, 16))
    assert set(got) == set(made) and all((got[k] == made[k]).all() for k in made)
    cells = tiles.to_cells(tiles.tiled(df, 3, 16), 16).groupBy("img", "x", "y").pivot("c", [0, 1, 2]).agg(F.first("v")).select("img", "x", "y", F.col("0").alias("r"), F.col("1").alias("g"), F.col("2").alias("b"))
    sizes = df.where("pixels is not null and img is not null").select("img", F.col("w").alias("iw"), F.col("h").alias("ih"))
    again = back(tiles.from_cells(cells, sizes, ("r", "g", "b"), 16))
    assert all((again[k] == made[k]).all() for k in made)
    few = back(tiles.from_cells(cells.where("x = 3"), sizes, ("r",), 16))
    assert all((few[k][:, 3, 0] == made[k][:, 3, 0]).all() and few[k].sum() == few[k][:, 3].sum() for k in made)
    assert tiles.untiled(tiles.tiled(df.limit(0), 3)).count() == 0


@pytest.mark.parametrize("mode", ["nearest", "bilinear"])
def test_warps_equal_whole_images(spark, mode):
    made, df = photos(spark, [(40, 50), (33, 21), (20, 20), (30, 40)])
    h = {0: [[1.1, 0.2, -7.3], [-0.1, 0.9, 5.1], [1e-3, -2e-3, 1]], 1: [[1, 0, 4], [0, 1, -3], [0, 0, 1]], 2: [[1, 2, 3], [2, 4, 6], [0, 0, 1]], 3: [[0.5123, 0, 0.31], [0, 0.5077, 0.17], [-0.02, 0.01, 1]]}
    m = spark.createDataFrame([(k, *map(float, np.ravel(v))) for k, v in h.items()], "img int, " + ", ".join(f"{n} double" for n in geometry.NAMES))
    got = back(tiles.warp(tiles.tiled(df, 3, 16), m, 61, 37, mode, 16, out="f8"), "f8")
    assert set(got) == set(made)
    for k, a in made.items():
        want = np.stack([np.zeros((37, 61)) if (w := raster.warped(a[:, :, c], np.array(h[k], float), 61, 37, mode)) is None else w for c in range(3)], axis=2)
        assert np.allclose(got[k], want, atol=1e-6)
    cut = back(tiles.warp(tiles.tiled(df, 3, 16), m, 61, 37, mode, 16))
    assert all((cut[k] == np.trunc(got[k] + 1e-9).astype("u1")).mean() > 0.999 for k in made)


@pytest.mark.parametrize(("mode", "aligned"), [("nearest", False), ("bilinear", False), ("bilinear", True)])
@pytest.mark.parametrize("size", [(7, 5), (90, 80), (1, 1)])
def test_resizes_equal_those_of_cells(spark, mode, aligned, size):
    made, df = photos(spark, [(40, 50), (1, 33), (17, 1)], 1)
    got = back(tiles.resize(tiles.tiled(df, 1, 16), *size, mode, aligned, 16, out="f8"), "f8")
    for k, a in made.items():
        h, w = a.shape[:2]
        y, x = np.mgrid[: size[1], : size[0]].astype(float)
        at = lambda p, old, new: np.floor(p * old / new) if mode == "nearest" else p * (old - 1) / max(1, new - 1) if aligned else np.clip((p + 0.5) * old / new - 0.5, 0, old - 1)
        want = tiles.values_at(a, 0, 0, w, h, at(x, w, size[0]), at(y, h, size[1]), mode)
        assert np.allclose(got[k], want)


def test_files_are_loaded_and_resized(spark, tmp_path):
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (70, 90), "u1")
    (tmp_path / "a.png").write_bytes(files.encode_gray(image))
    (tmp_path / "b.png").write_bytes(b"no image")
    read = files.images(spark, str(tmp_path), "*.png", "rgb").withColumnRenamed("path", "img")
    got = tiles.untiled(tiles.resize(tiles.tiled(read, 3), 45, 35, "nearest")).collect()
    assert len(got) == 1 and got[0]["img"].endswith("a.png")
    assert (np.frombuffer(bytes(got[0]["pixels"]), "u1").reshape(35, 45, 3) == image[::2, ::2, None]).all()


def test_a_warp_moves_little_more_than_the_image(spark):
    """Bytes written to exchanges, for an image of 3 MB under a turn: at most three times its own."""
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (1000, 1000, 3), "u1")
    df = spark.createDataFrame([(1, 1000, 1000, bytearray(a.tobytes()))], "img int, h int, w int, pixels binary")
    m = spark.createDataFrame([(1, 0.99, -0.05, 10.3, 0.05, 0.99, -7.1, 0.0, 0.0, 1.0)], "img int, " + ", ".join(f"{n} double" for n in geometry.NAMES))
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(old, ("false", "-1")):
            spark.conf.set(k, v)
        out = tiles.warp(tiles.tiled(df, 3), m, 1000, 1000)
        out.write.format("noop").mode("overwrite").save()
        out.collect()
        plan = out._jdf.queryExecution().executedPlan()
        moved, todo = 0, [plan]
        while todo:
            node = todo.pop()
            if "ShuffleExchange" in node.getClass().getSimpleName():
                moved += node.metrics().apply("dataSize").value()
            todo += [node.children().apply(i) for i in range(node.children().size())]
        assert a.nbytes < moved <= 3 * a.nbytes
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_points_and_patches(spark):
    made, df = photos(spark, [(40, 50)], 2)
    points = [(0, i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (10.25, 17.5), (49.0, 39.0), (49.5, 39.5), (-0.5, 3.0), (60.0, 3.0), (15.9, 15.9), (-3.0, -3.0)])]
    pts = spark.createDataFrame(points, "img int, id int, px double, py double")
    got = {r["id"]: r["values"] for r in tiles.at_points(tiles.tiled(df, 2, 16), pts, 16).collect()}
    for _, i, x, y in points:
        assert np.allclose(got[i], tiles.values_at(made[0], 0, 0, 50, 40, np.array([x]), np.array([y]))[0])
    cut = {r["id"]: r for r in tiles.patches(tiles.tiled(df, 2, 16), pts, 5, 16).collect()}
    for _, i, x, y in points:
        left, top = int(np.clip(np.floor(x) - 2, 0, 45)), int(np.clip(np.floor(y) - 2, 0, 35))
        assert (cut[i]["left"], cut[i]["top"]) == (left, top) and bytes(cut[i]["patch"]) == made[0][top : top + 5, left : left + 5].tobytes()
    assert json.dumps(sorted(got)) == json.dumps(list(range(8)))


def test_cells_fill_tiles_over_batches_of_any_size(spark):
    rng = np.random.default_rng(4)
    cells = [(k, int(x), int(y), int(rng.integers(256)), int(rng.integers(256))) for k in (1, 2, None) for x in range(-2, 40) for y in range(-1, 21) if rng.random() < 0.8]
    sizes = spark.createDataFrame([(1, 37, 18), (2, 5, 30), (3, 17, 17)], "img long, iw int, ih int")
    df = spark.createDataFrame(cells, "img long, x int, y int, r int, g int")
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {k: np.full((h, w, 2), 9, "u1") for k, w, h in ((1, 37, 18), (2, 5, 30), (3, 17, 17))}
    for k, x, y, *v in cells:
        if k and 0 <= x < want[k].shape[1] and 0 <= y < want[k].shape[0]:
            want[k][y, x] = v
    try:
        for rows in (7, 10000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            made = tiles.from_cells(df, sizes, ("r", "g"), 16, empty=9)
            got = {r["img"]: np.frombuffer(r["pixels"], "u1").reshape(r["h"], r["w"], r["n"]) for r in tiles.untiled(made, 16).collect()}
            assert got.keys() == want.keys() and all((got[k] == want[k]).all() for k in want)
            sums = {(r["img"], r["c"]): (r["total"], r["by_x"], r["by_y"]) for r in tiles.moments(made, 16).collect()}
            for k, a in want.items():
                y, x = np.mgrid[: a.shape[0], : a.shape[1]]
                assert all(sums[k, c] == (a[..., c].sum(), (a[..., c] * (x + 1.0)).sum(), (a[..., c] * (y + 1.0)).sum()) for c in (0, 1))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)


def test_classes_of_tiles_are_counted_with_their_places(spark):
    made = tiles.computed(spark.createDataFrame([(5, 35, 20)], "img long, iw int, ih int"), lambda img, x, y: ((x * 3 + y + img) % 4)[..., None], 1, 16)
    y, x = np.mgrid[:20, :35]
    a = (x * 3 + y + 5) % 4
    got = {r["cls"]: (r["n"], r["sum_x"], r["sum_y"]) for r in tiles.class_places(made, 16).collect()}
    assert got == {k: ((a == k).sum(), x[a == k].sum(), y[a == k].sum()) for k in range(4)}


def test_many_groups_are_served_by_one_call(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        for k in held:
            spark.conf.set(k, "1" if "partitions" in k else "false")
        made = tiles.computed(spark.range(500).select(F.col("id").alias("img"), F.lit(20).alias("iw"), F.lit(16).alias("ih")), lambda img, x, y: ((x + y + img) % 251)[..., None], 1, 16)
        boxes = made.select("img", F.col("tx").alias("gx"), F.col("ty").alias("gy"), "n", F.lit(3).alias("x0"), F.lit(2).alias("y0"), F.lit(18).alias("x1"), F.lit(9).alias("y1"))

        def sums(rows, group, patches):
            total = np.bincount(np.repeat(np.arange(len(group)), (patches.wide * patches.high)[group]), weights=patches.values)
            calls = np.where(np.arange(len(group)) == 0, 1, 0)
            return pa.RecordBatch.from_arrays([rows.column("img"), pa.array(calls), pa.array(total)], ["img", "calls", "total"])

        got = tiles.gathered(made, boxes, sums, "img long, calls long, total double", 16).collect()
        y, x = np.mgrid[2:9, 3:18]
        assert len(got) == 1000 and all(r["total"] == ((x + y + r["img"]) % 251).sum() for r in got)
        assert sum(r["calls"] for r in got) <= 10
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_images_of_other_channels_and_without_a_box_share_a_batch(spark):
    (one, a), (three, b) = photos(spark, [(20, 30)] * 3, 1), photos(spark, [(35, 18)] * 3, 3)
    shifted = b.withColumn("img", F.col("img") + 10)
    both = tiles.tiled(a, 1, 16).unionByName(tiles.tiled(shifted, 3, 16)).where("img < 20")
    want = one | {k + 10: v for k, v in three.items()}
    flat = dict.fromkeys(geometry.NAMES, 0.0)
    rows = [(k, *({**flat, "h00": 1.0, "h11": 1.0, "h22": 1.0, "h02": 2.0} if k % 10 else flat).values()) for k in want]
    m = spark.createDataFrame(rows, "img int, " + ", ".join(f"{n} double" for n in geometry.NAMES))
    got = back(tiles.warp(both, m, 18, 20, "nearest", 16))
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert (got[k] == (np.pad(v, ((0, 0), (2, 0), (0, 0)))[:20, :18] if k % 10 else 0)).all()
    cut = back(tiles.crop(both, m.select("img", F.lit(5).alias("x0"), F.lit(4).alias("y0"), F.lit(18).alias("x1"), F.lit(19).alias("y1")), 16))
    assert cut.keys() == want.keys() and all((cut[k] == v[4:19, 5:18]).all() for k, v in want.items())
    points = m.select("img", F.lit(1).alias("id"), F.when(F.col("img") % 10 == 0, -9.0).otherwise(7.5).alias("px"), F.lit(17.0).alias("py"))
    near = {r["img"]: r["values"] for r in tiles.at_points(both, points, 16).collect()}
    assert all(np.allclose(near[k], (v[17, 7].astype(float) + v[17, 8]) / 2 if k % 10 else np.zeros(v.shape[2])) for k, v in want.items())


def test_rows_of_a_place_are_added_up_as_tiles_are_filled(spark):
    rows = [(i % 3, i % 11, i % 7, None if i % 13 == 0 else i * 37) for i in range(900)] + [(1, 40, 2, 5), (None, 0, 0, 9), (7, 1, 1, 3)]
    cells = spark.createDataFrame(rows, "img long, x int, y int, v long").repartition(4)
    sizes = spark.createDataFrame([(i, 9, 6) for i in range(4)], "img long, iw int, ih int")
    made = tiles.from_cells(cells, sizes, ("v",), 4, summed=lambda t, x, y: [t % 251, (t + x * 3 + y) % 256])
    assert "HashAggregate" not in made._jdf.queryExecution().executedPlan().toString()
    totals = {}
    for img, x, y, v in rows:
        if v is not None:
            totals[img, x, y] = totals.get((img, x, y), 0) + v
    want = {(i, x, y, c): (([t % 251, (t + x * 3 + y) % 256][c]) if (t := totals.get((i, x, y))) is not None else 0) for i in range(4) for x in range(9) for y in range(6) for c in (0, 1)}
    assert {(r["img"], r["x"], r["y"], r["c"]): int(r["v"]) for r in tiles.to_cells(made, 4).collect()} == want
