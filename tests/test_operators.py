"""Closed forms, traps and properties of the operators."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions import models, parsing
from framelake.operators import geometry, joins, keypoints, metrics, profiling, raster, sequence, split
from framelake.sources import files
from framelake.streaming import steps


def values(df):
    return [tuple(r) for r in df.collect()]


def pixels(spark, pred, gt):
    return spark.createDataFrame([(p, g) for p, g in zip(pred, gt)], "pred int, gt int")


def dice_of(spark, pred, gt, ignore=()):
    c = metrics.class_counts(metrics.pairs(pixels(spark, pred, gt), F.col("pred"), F.col("gt"), ignore=ignore), range(4))
    return {r["cls"]: r["d"] for r in c.withColumn("d", metrics.dice(F.col("inter"), F.col("pred_sum"), F.col("gt_sum"))).collect()}


def test_dice_perfect_disjoint_ignored(spark):
    assert dice_of(spark, [1, 1, 2, 2], [1, 1, 2, 2]) == {1: pytest.approx(1, abs=1e-5), 2: pytest.approx(1, abs=1e-5)}
    assert dice_of(spark, [1, 1], [2, 2]) == {1: 0, 2: 0}
    assert dice_of(spark, [1, 2], [0, 3], ignore=(0, 3)) == {}
    a, b = [0, 1, 1, 2, 3], [0, 1, 2, 2, 2]
    assert dice_of(spark, a, b) == dice_of(spark, b, a)


def test_dice_of_nothing_is_null(spark):
    got = spark.range(1).select(metrics.dice(F.lit(0), F.lit(0), F.lit(0)).alias("d"), metrics.iou(F.lit(0), F.lit(0), F.lit(0)).alias("i")).first()
    assert got["d"] is None and got["i"] is None


def test_size_bin_edges_and_classes_missing_in_truth(spark):
    rows = [(i, 1, 1) for i, n in ((1, 3), (2, 4), (3, 9)) for _ in range(n)] + [(1, 2, 1)]
    got = metrics.size_bins(spark.createDataFrame(rows, "image int, pred int, gt int"), ["image"], 5, 9)
    assert {(r["cls"], r["bin"]): r["gt_sum"] for r in got.collect()} == {(1, 0): 8, (1, 2): 9}


def test_distance_bin_edges(spark):
    d = spark.createDataFrame([(0.0,), (0.33,), (0.66,), (1.0,)], "d double")
    assert [r[0] for r in d.select(metrics.bin_of(F.col("d"), (0, 0.33, 0.66, 1.01))).collect()] == [0, 1, 2, 2]


def test_medians_lower_and_interpolated(spark):
    d = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double")
    row = d.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY v)").alias("low"), F.percentile("v", F.lit(0.5)).alias("mid")).first()
    assert (row["low"], row["mid"]) == (2.0, 2.5)
    got = metrics.latency_summary(d.withColumn("k", F.lit(1)), "v", "k").first()
    assert got["p50"] == 2.5 and got["std"] == round(np.std([1, 2, 3, 10]), 3)
    zero = metrics.latency_summary(spark.createDataFrame([(1, 0.0)], "k int, v double"), "v", "k").first()
    assert zero["fps_mean"] == 0 and zero["fps_p95"] == 0


def test_lag_closed_form_equals_expansion_and_merge(spark):
    seg = spark.createDataFrame([("a", 0, 30, 2), ("a", 40, 60, 45), ("b", 5, 20, 1)], "video string, start_frame long, end_frame long, startpoint long")
    frames = spark.range(70).select(F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("video"), F.col("id").alias("frame_id"))
    near = joins.correct_lag(frames, seg).select("video", "frame_id", "offset")
    assert sorted(values(near)) == sorted(values(joins.correct_lag(frames, seg, bound=0).select("video", "frame_id", "offset")))
    inside = {(v, f): o for v, f, o in values(near)}
    assert all(inside[v, f] == o for v, f, o in values(joins.expand_lag(seg)))
    assert [inside["a", f] for f in (0, 2, 3, 8, 9)] == [0, 0, 1, 1, 2] and inside["c", 9] == 0


def test_mutual_best_is_symmetric_and_breaks_ties_low(spark):
    s = spark.createDataFrame([(0, 1, 1, 0.9), (0, 1, 2, 0.9), (0, 2, 1, 0.5), (0, 2, 2, 0.8), (0, 3, 3, 0.05)], "pair int, i int, j int, score double")
    assert sorted(values(joins.mutual_best(s, "pair", 0.1))) == [(0, 1, 1, 0.9)]
    swapped = s.select("pair", F.col("j").alias("i"), F.col("i").alias("j"), "score")
    assert sorted((p, j, i, x) for p, i, j, x in values(joins.mutual_best(swapped, "pair", 0.1))) == [(0, 1, 1, 0.9)]


def test_priority_join_and_continuity(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "z")], "k int, s string")
    got = joins.by_priority(rows, "k", spark.createDataFrame([(1, 5)], "k int, value int"), "s", spark.createDataFrame([("a", 7)], "s string, value int"))
    assert sorted(values(got.select("k", "value", "status"))) == [(1, 5, "direct"), (2, 7, "fallback"), (3, None, "missing")]
    f = spark.createDataFrame([("v", 0), ("v", 1), ("v", 3)], "video string, f int")
    assert [r["continuous"] for r in joins.consecutive(f, "video", "f").orderBy("f").collect()] == [False, True, False]


def test_gap_islands_at_the_edge(spark):
    e = spark.createDataFrame([("a", 0, 10), ("a", 100_010, 5), ("a", 200_016, 1)], "k string, ts long, dur long")
    got = sequence.islands(e, "k", ["ts"], F.col("ts"), F.col("ts") + F.col("dur"), 100_000).orderBy("ts")
    assert [r["island"] for r in got.collect()] == [0, 0, 1]


def test_runs_products_epochs_carries(spark):
    e = spark.createDataFrame([("a", i, v) for i, v in enumerate([2.0, -3.0, 0.5, 0.0, 4.0])], "k string, i int, v double")
    assert values(sequence.run_length(e, "k", ["i"], F.col("v") != 0)) == [("a", 3)]
    assert [round(r["p"], 9) for r in sequence.running_product(e, "k", ["i"], F.col("v"), "p").orderBy("i").collect()] == [2, -6, -3, 0, 0]
    assert [r["epoch"] for r in sequence.epochs(e, "k", ["i"], F.col("v") < 1).orderBy("i").collect()] == [0, 1, 2, 3, 3]
    assert [r["c"] for r in sequence.carry(e, "k", ["i"], F.col("i"), F.col("v") >= 1, "c").orderBy("i").collect()] == [0, 0, 0, 0, 4]


def test_box_smoothing():
    assert sequence.smooth_box((0, 0, 100, 100), (50, 50, 60, 60)) == (6, 6, 94, 94)
    assert sequence.smooth_box((0, 0, 100, 100), (0, 0, 100, 100)) == (0, 0, 100, 100)
    assert sequence.smooth_box((0, 0, 10, 10), (9, 9, 10, 10), most=20, share=1.0) == (0, 0, 10, 10)


def test_suppression_keeps_plateaus_and_is_stable(spark):
    c = spark.createDataFrame([(0, x, y, float(v)) for (x, y), v in np.ndenumerate(np.array([[1, 5, 5, 1], [1, 1, 1, 1], [9, 1, 1, 2]]))], "img int, x int, y int, s double")
    kept = {(r["x"], r["y"]) for r in keypoints.suppress(c, 1).where("kept").collect()}
    assert {(0, 1), (0, 2), (2, 0), (2, 3)} <= kept


def test_soft_argmax_of_a_lone_peak(spark):
    c = spark.createDataFrame([(0, x, y, 1.0 if (x, y) == (2, 2) else 0.0) for x in range(5) for y in range(5)], "img int, x int, y int, s double")
    r = keypoints.soft_argmax(c, 1).where("x = 2 and y = 2").first()
    assert abs(r["ox"]) < 1e-12 and abs(r["oy"]) < 1e-12 and r["spread"] < 0.01


def test_root_normalised_has_length_one(spark):
    r = spark.createDataFrame([([1.0, 3.0, 0.0],)], "d array<double>").select(keypoints.root_normalised(F.col("d")).alias("r")).first()["r"]
    assert np.linalg.norm(r) == pytest.approx(1) and r[1] / r[0] == pytest.approx(3**0.5)


def test_threshold_falls_back_to_the_mean(spark):
    s = spark.createDataFrame([("a", 1.0), ("a", 9.0), ("b", 1.0), ("b", 3.0)], "k string, s double")
    assert sorted(values(keypoints.threshold_or_mean(s, "k", "s", 5.0))) == [("a", 9.0), ("b", 3.0)]
    got = spark.range(1).select(keypoints.stop_threshold(F.lit(0), 9).alias("a"), keypoints.stop_threshold(F.lit(9), 9).alias("b")).first()
    assert got["a"] == pytest.approx(0.9) and got["b"] == pytest.approx(0.8 + 0.1 * np.exp(-4))


def rotation(deg, s=1.0):
    a = np.radians(deg)
    return [s * np.cos(a), -s * np.sin(a), 0, s * np.sin(a), s * np.cos(a), 0, 0, 0, 1]


@pytest.mark.parametrize(("m", "reset"), [(np.eye(3).ravel(), False), (rotation(14.9), False), (rotation(15.1), True), (rotation(0, 1.99), False), (rotation(0, 2.01), True), (rotation(0, 1 / 2.01), True), ([1, 2, 0, 0, 1, 0, 0, 0, 1], True), ([1, 0, 3, 0, 1, -2, 0, 0, 1], False), ([1, 0, 0, 0, 1, 0, 0, 0, 0], False)])
def test_reset(spark, m, reset):
    df = spark.createDataFrame([tuple(map(float, m))], ", ".join(f"{n} double" for n in geometry.NAMES))
    assert df.select(geometry.needs_reset(*geometry.decompose(geometry.entries()))).first()[0] is reset


def test_inverse_and_singular(spark):
    cols = ", ".join(f"{n} double" for n in geometry.NAMES)
    m = np.array([[1, 0.2, 3], [0.1, 1.1, -2], [1e-3, 0, 1]])
    inv = geometry.inverse(geometry.entries())
    df = spark.createDataFrame([tuple(m.ravel().tolist())], cols).select(*[c for row in inv for c in row])
    assert np.allclose(np.array(df.first(), float).reshape(3, 3) @ m, np.eye(3))
    singular = spark.createDataFrame([(1.0, 2.0, 3.0, 2.0, 4.0, 6.0, 0.0, 0.0, 1.0)], cols).select(*[c for row in inv for c in row]).first()
    assert all(v is None for v in singular)


def test_homography_is_recovered_and_too_few_is_null(spark):
    h = np.array([[1.1, 0.05, 4], [-0.02, 0.95, -3], [1e-4, -2e-4, 1]])
    pts = [(x, y) for x in (0, 200, 400) for y in (0, 150, 300)]
    rows = []
    for x, y in pts:
        u, v, w = h @ (x, y, 1)
        rows.append(("a", float(x), float(y), float(u / w), float(v / w), 1.0))
    rows += [("b", *r[1:]) for r in rows[:3]]
    got = {r["k"]: r for r in geometry.solve_homographies(spark.createDataFrame(rows, "k string, x double, y double, u double, v double, w double"), "k").collect()}
    assert np.allclose([got["a"][n] for n in geometry.NAMES], h.ravel(), atol=1e-2)
    assert got["b"]["h00"] is None


def test_spline(spark):
    rng = np.random.default_rng(1)
    rows = [("a", float(x), float(y), float(x) + 5, float(y) - 2) for x, y in rng.uniform(0, 100, (12, 2))] + [("b", 1.0, 1.0, 2.0, 2.0)]
    got = geometry.splines(spark.createDataFrame(rows, "k string, x double, y double, u double, v double"), "k", [(50.0, 50.0)]).collect()
    by = {r["k"]: r for r in got}
    assert by["a"]["u"] == pytest.approx(55, abs=1e-3) and by["a"]["v"] == pytest.approx(48, abs=1e-3) and by["b"]["u"] is None


def test_flat_image_blur_only_at_the_border(spark):
    c = spark.createDataFrame([(0, x, y, 7) for x in range(5) for y in range(5)], "img int, x int, y int, v long")
    lap = np.zeros((5, 5))
    lap[0] -= 7
    lap[-1] -= 7
    lap[:, 0] -= 7
    lap[:, -1] -= 7
    assert raster.laplacian_variance(c).first()["blur"] == pytest.approx(lap.var())


def test_warp_there_and_back(spark):
    c = spark.createDataFrame([(0, x, y, 10 * x + y) for x in range(6) for y in range(6)], "img int, x int, y int, v long")
    back = raster.warp_nearest(raster.warp_nearest(c, 2, 1, 6, 6), -2, -1, 6, 6)
    got = {(r["x"], r["y"]): r["v"] for r in back.collect()}
    assert all(got[x, y] == 10 * x + y for x in range(4) for y in range(5))


def test_packed_warp_equals_the_gather(spark):
    c = spark.createDataFrame([(0, x, y, 10 * x + y) for x in range(6) for y in range(6)], "img int, x int, y int, v long")
    m = [F.lit(float(v)).alias(n) for v, n in zip((1, 0, 2, 0, 1, 1, 0, 0, 1), geometry.NAMES)]
    image = np.frombuffer(raster.warp_packed(raster.pack(c, 6, 6).select("*", *m)).first()["warped"], "u1").reshape(6, 6)
    assert all(image[r["y"], r["x"]] == r["v"] for r in raster.warp_nearest(c, 2, 1, 6, 6).collect())
    singular = [F.lit(0.0).alias(n) for n in geometry.NAMES]
    assert raster.warp_packed(raster.pack(c, 6, 6).select("*", *singular)).first()["warped"] is None


def test_ramp_and_override_modes(spark):
    d = spark.createDataFrame([(0,), (1,), (2,), (5,), (6,), (None,)], "d int")
    assert [round(r[0], 6) for r in d.select(raster.ramp(F.col("d"), 5)).collect()] == [1, 1, 0.8, 0.2, 0, 0]
    c = spark.createDataFrame([(2.0, 1, 1), (2.0, 2, 1), (2.0, 0, None)], "l double, k int, m int")
    got = [values(c.select(raster.overridden(F.col("l"), F.col("k"), F.col("m"), mode))) for mode in ("logits", "sigmoid", "softmax")]
    assert got == [[(255.0,), (0.0,), (2.0,)], [(1.0,), (2.0,), (2.0,)], [(1.0,), (0.0,), (2.0,)]]


def test_components_and_membrane(spark):
    c = spark.createDataFrame([(0, x, y) for x, y in ((0, 0), (1, 1), (2, 2), (5, 5), (5, 6))], "img int, x int, y int")
    assert len({r["component"] for r in raster.components(c).collect()}) == 2
    snake = [(0, x, y) for x in range(0, 12, 2) for y in range(30)] + [(0, x, 29 if x % 4 == 1 else 0) for x in range(1, 11, 2)] + [(1, 0, 0)]
    got = raster.components(spark.createDataFrame(snake, "img int, x int, y int")).collect()
    assert len({r["component"] for r in got}) == 2 and len(got) == len(snake)
    canvas, patch, mask = np.full((9, 9), 10.0), np.full((9, 9), 30.0), np.zeros((9, 9))
    mask[2:7, 2:7] = 1
    out = raster.membrane(canvas, patch, mask, 200)
    assert np.allclose(out, 10, atol=0.5)


def test_half_even_rounding(spark):
    d = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "v double")
    assert [r[0] for r in d.select(F.rint("v")).collect()] == [0, 2, 2]


def test_parsing(spark):
    path = "x/video01/video01_16585/frame_16611_endo_watershed_mask.png"
    d = spark.createDataFrame([(path,), ("frame_.png",)], "p string")
    v, s = parsing.video_and_start(F.col("p"))
    got = values(d.select(parsing.frame_id(F.col("p")), v, s, parsing.path_part(F.col("p"), 2)))
    assert got == [(16611, "video01", 16585, "video01_16585"), (None, None, None, None)]
    raw = spark.createDataFrame([(0,), (50,), (255,), (33,), (7,)], "r int")
    assert [r[0] for r in raw.select(parsing.raw_to_class(F.col("r"))).collect()] == [0, 0, 0, 12, 0]
    names = spark.createDataFrame([("fold12", "module.a.b"), ("x", "_orig_mod.c")], "n string, k string")
    assert values(names.select(parsing.fold_id(F.col("n")), parsing.parameter_key(F.col("k")))) == [(12, "a.b"), (0, "c")]
    sizes = spark.createDataFrame([(5,), (2048,), (3 << 20,)], "n long")
    assert [r[0] for r in sizes.select(parsing.size_text(F.col("n"))).collect()] == ["5 B", "2.00 KB", "3.00 MB"]


def test_event_kinds_and_folds(spark):
    e = spark.createDataFrame([("Session", "x"), ("Node", "a_kernel_time"), ("Node", "a_fence_before"), ("Api", "b")], "cat string, name string")
    assert [r[0] for r in e.select(profiling.event_kind(F.col("cat"), F.col("name"))).collect()] == ["session", "kernel", "fence_before", "other"]
    g = spark.createDataFrame([(f"g{i}", i % 2) for i in range(20) for _ in range(i % 5 + 1)], "g string, s int")
    folds = split.group_folds(g, "g", F.col("s"), 5)
    assert {r["fold"]: r["count"] for r in folds.groupBy("fold").count().collect()} == dict.fromkeys(range(5), 4)
    assert split.in_fold(g, folds, "g").select("g", "fold").distinct().count() == 20


def png(image):
    """A colour PNG without filters."""
    import struct
    import zlib

    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = b"".join(b"\0" + line.tobytes() for line in image)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_image_files(spark, tmp_path):
    image = np.arange(30, dtype="u1").reshape(5, 6)
    colours = np.random.default_rng(3).integers(0, 256, (4, 7, 3), "u1")
    folder = tmp_path / "video01"
    folder.mkdir()
    (folder / "frame_000003_pred_idx.png").write_bytes(files.encode_gray(image))
    (folder / "frame_000004_pred_idx.png").write_bytes(b"broken")
    (folder / "frame_000005_rgb.png").write_bytes(png(colours))
    got = {r["path"][-23:-4]: r for r in files.images(spark, str(tmp_path), "frame_*_pred_idx.png").collect()}
    ok = [r for r in got.values() if r["status"] == "ok"]
    assert len(got) == 2 and len(ok) == 1 and bytes(ok[0]["pixels"]) == image.tobytes()
    rgb = files.images(spark, str(tmp_path), "*_rgb.png", "rgb").first()
    assert (rgb["h"], rgb["w"]) == (4, 7) and bytes(rgb["pixels"]) == colours.tobytes()
    gray = files.images(spark, str(tmp_path), "*_rgb.png").first()
    assert np.abs(np.frombuffer(gray["pixels"], "u1").reshape(4, 7) - colours @ np.array([0.299, 0.587, 0.114])).max() <= 0.5
    paths = files.image_files(spark, str(tmp_path), "frame_*_pred_idx.png").select("path")
    truths = spark.createDataFrame([("/gt/video01/frame_000003_gt_idx.png",)], "path string")
    found = files.matched_files(paths, truths)
    assert {r["frame_id"]: r["status"] for r in found.collect()} == {3: "ok", 4: "missing_gt"}
    assert values(files.copy_counts(found, "video")) == [("video01", 1, 1)]


def test_frame_source_and_models(spark):
    spark.dataSource.register(files.FrameSource)
    f = spark.read.format("frames").option("videos", 2).option("frames", 6).option("start", 2).option("end", 5).load()
    assert f.count() == 6 and f.agg(F.min("frame_id")).first()[0] == 2
    images = f.select(F.concat("video", F.col("frame_id").cast("string")).alias("img"), "h", "w", "pixels")
    assert models.segment(images).count() == 6
    assert models.keypoints(images, 3).count() == 18
    first = images.limit(1)
    assert models.segment_resized(first).select("h", "w", F.length("classes")).first() == (8, 8, 64)
    assert models.segment_resized(first, side=16).first()["classes"] == models.segment(first).first()["classes"]
    a = np.random.default_rng(1).integers(0, 255, (12, 20), "u1")
    pair = spark.createDataFrame([(0, 12, 20, bytearray(a.tobytes()), bytearray(np.roll(a, (1, -1), (0, 1)).tobytes()))], "img int, h int, w int, pixels binary, before binary")
    moved = models.flow(pair).first()
    assert set(np.frombuffer(moved["dx"], "<f4")) == {-1.0} and set(np.frombuffer(moved["dy"], "<f4")) == {1.0}


def test_sinks(spark, tmp_path):
    m = spark.createDataFrame([(1, 0.5), (2, None)], "cls int, dice double")
    files.write_metrics(m, str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).count() == 1
    files.write_report(m, str(tmp_path / "r"))
    files.write_folds(spark.createDataFrame([(0, "train", "a"), (1, "test", "b")], "fold int, part string, v string"), str(tmp_path / "f"))
    assert (tmp_path / "f" / "fold=1" / "part=test").is_dir()
    (tmp_path / "p.json").write_text('[{"cat": "Node", "name": "a_kernel_time", "ts": 1, "dur": 2, "args": {"op_name": "Conv"}}]')
    assert files.profile(spark, str(tmp_path / "p.json")).first()["args"]["op_name"] == "Conv"
    (tmp_path / "s.csv").write_text("video,start_frame,end_frame,startpoint\nv,0,9,2\n")
    assert files.segments(spark, str(tmp_path / "s.csv")).first()["startpoint"] == 2


class Row:
    def __init__(self, h=(1, 0, 1, 0, 1, 0, 0, 0, 1), **k):
        self.__dict__.update({"blur": 99.0, "h": 4, "w": 4} | k | dict(zip(geometry.NAMES, h or [None] * 9)))


def folded(config, *rows):
    state, outs = None, []
    for r in rows:
        state, out = steps.step(state, r, config)
        outs.append(dict(zip(steps._OUT, out)))
    return outs


@pytest.mark.parametrize(("policy", "want"), [("restart", (0, 1, False)), ("keep", (1, 0, False)), ("flag", (0, 0, True))])
def test_failure_policies(policy, want):
    last = folded(steps.StepConfig(on_failure=policy), Row(), Row(), Row(h=None))[-1]
    assert (last["h02"], last["epoch"], last["needs_reset"]) == want


def test_shape_change_and_blur():
    a, b, c, d = folded(steps.StepConfig(), Row(), Row(w=5), Row(w=5, blur=1.0, h=rotation(20)), Row(w=5, h=rotation(1)))
    assert (b["epoch"], b["h02"]) == (1, 0)
    assert c["rotation"] == pytest.approx(20) and not c["reoriented"] and not c["in_canvas"]  # none while blurred
    assert d["rotation"] == pytest.approx(21) and d["reoriented"]


@pytest.mark.parametrize(("m", "far"), [(rotation(14.9), False), (rotation(15.1), True), (rotation(-15.1), True), (rotation(0, 1.99), False), (rotation(0, 2.01), True), (rotation(0, 1 / 2.01), True)])
def test_orientation_reset(m, far):
    _, a, b = folded(steps.StepConfig(), Row(), Row(h=m), Row(h=(1, 0, 3, 0, 1, 0, 0, 0, 1)))
    assert a["reoriented"] is far and (b["h02"] == 3 and b["rotation"] == 0 and b["scale"] == pytest.approx(1)) is far
    _, a, b = folded(steps.TRACKER, Row(), Row(), Row())
    assert a["reoriented"] and b["h02"] == 1
    assert not folded(steps.PREDICTIONS, Row(), Row(h=m))[1]["reoriented"]


def test_fold_of_null_keys(spark):
    rows = [(None, i) for i in range(4)] + [(2**53 + 1, i) for i in range(3)] + [(2**53 + 2, i) for i in range(2)]
    df = spark.createDataFrame(rows, "k long, i int")
    out = sequence.fold(df, "k", ["i"], lambda s, r: ((s or 0) + 1, ((s or 0) + 1,)), ["n"], "n int")
    assert sorted(values(out), key=str) == sorted([(k, i, i + 1) for k, i in rows], key=str)


def still(video, n, image, h=(1, 0, 2, 0, 1, 1, 0, 0, 1), **more):
    return [(video, i, *image.shape, 99.0, *(map(float, h)), bytearray(image.tobytes())) for i in range(n)]


FRAMES = "video string, frame_id long, h int, w int, blur double, " + ", ".join(f"{n} double" for n in geometry.NAMES) + ", pixels binary"


def test_canvas_holds_frames_where_they_belong(spark):
    image = np.arange(1, 25, dtype="u1").reshape(4, 6) * 10 % 251
    df = spark.createDataFrame([*still("a", 3, image), *still("b", 1, image)], FRAMES)
    got = steps.canvases(df)
    by = {(r["video"], r["frame_id"]): r for r in got.collect()}
    last = by["a", 2]
    canvas, painted = (np.frombuffer(last[c], "u1").reshape(12, 18) for c in ("canvas", "painted"))
    want, seen = np.zeros((12, 18)), np.zeros((12, 18), bool)
    for i in range(3):  # each frame lies 2 to the right of and 1 below the one before
        at = np.s_[4 + i : 8 + i, 6 + 2 * i : 12 + 2 * i]
        want[at] = np.where(seen[at], 0.5 * want[at] + 0.5 * image, image)
        seen[at] = True
    assert (painted == seen * 255).all() and np.abs(canvas - want).max() <= 0.5
    back = {(r["video"], r["frame_id"]): np.frombuffer(r["seen"], "u1").reshape(4, 6) for r in steps.reprojected(got).collect()}
    assert (back["b", 0] == image).all() and (back["a", 2] == canvas[6:10, 10:16]).all()
    classes = {(r["video"], r["frame_id"]): np.frombuffer(r["classes"], "u1").reshape(4, 6) for r in steps.model_on_canvas(got, "entire").collect()}
    assert classes["b", 0].shape == (4, 6) and set(np.unique(classes["b", 0])) <= {0, 1, 2, 3}


def test_canvas_of_blurred_and_turned_frames(spark):
    image = np.full((6, 6), 200, "u1")
    rows = still("a", 2, image, h=(1, 0, 3, 0, 1, 0, 0, 0, 1))
    rows[1] = (*rows[1][:4], 1.0, *rows[1][5:])  # blurred: stays out of the base canvas, but in its own
    third = still("a", 3, image, h=rotation(90))[2]
    by = {r["frame_id"]: r for r in steps.canvases(spark.createDataFrame([*rows, third], FRAMES)).collect()}
    count = lambda i: int((np.frombuffer(by[i]["painted"], "u1") > 0).sum())
    assert count(0) == 36 and count(1) == 54 and not by[1]["in_canvas"]
    assert by[2]["reoriented"] and by[2]["rotation"] == pytest.approx(90)


def test_transforms_from_keypoints(spark):
    rng = np.random.default_rng(4)
    points, descriptors = rng.uniform(0, 300, (30, 2)), rng.normal(size=(30, 16))
    descriptors /= np.linalg.norm(descriptors, axis=1, keepdims=True)
    kp = lambda shift: [("v", 1, i, float(x + shift[0]), float(y + shift[1]), d.tolist()) for i, ((x, y), d) in enumerate(zip(points, descriptors))]
    schema = "video string, frame_id long, id int, x double, y double, descriptor array<double>"
    frames = spark.createDataFrame([("v", 0, 480, 640, 50.0), ("v", 1, 480, 640, 50.0)], "video string, frame_id long, h int, w int, blur double")
    found = steps.transforms_of(frames, spark.createDataFrame(kp((7, -4)), schema), spark.createDataFrame(kp((0, 0)), schema), 0.5)
    by = {r["frame_id"]: r for r in steps.batch_steps(found).collect()}
    assert by[1]["h02"] == pytest.approx(7, abs=0.05) and by[1]["h12"] == pytest.approx(-4, abs=0.05) and not by[1]["needs_reset"]


def test_late_rows_are_marked(spark, tmp_path):
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    image = np.zeros((2, 2), "u1")
    rows = still("a", 4, image)
    for part in ([rows[0], rows[2]], [rows[1], rows[3]]):
        spark.createDataFrame(part, FRAMES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = own.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = steps.stream_steps(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    got = {r["frame_id"]: (r["late"], r["h02"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {0: (False, 0.0), 2: (False, 2.0), 1: (True, None), 3: (False, 4.0)} or got == {1: (False, 0.0), 3: (False, 2.0), 0: (True, None), 2: (True, None)}


def test_samples_find_a_transform_among_outliers(spark):
    rng = np.random.default_rng(2)
    src = rng.uniform(0, 400, (40, 2))
    dst = src + (5, -3)
    dst[:12] = rng.uniform(0, 400, (12, 2))
    rows = [("a", *map(float, p), *map(float, q), 1.0) for p, q in zip(src, dst)] + [("line", float(i), 0.0, float(i), 0.0, 1.0) for i in range(6)]
    df = spark.createDataFrame(rows, "k string, x double, y double, u double, v double, w double")
    got = {r["k"]: r for r in geometry.sampled_homographies(df, "k").collect()}
    assert got["a"]["h02"] == pytest.approx(5, abs=1e-6) and got["a"]["h12"] == pytest.approx(-3, abs=1e-6) and got["line"]["h00"] is None


def test_images_stay_apart(spark):
    a = [(i, x, y, 10 * i + x + y) for i in range(3) for x in range(4) for y in range(3)]
    cells = spark.createDataFrame(a, "img int, x int, y int, v long")
    got = joins.gather(cells.select("img", "x", "y"), cells, F.col("x"), F.col("y"))
    assert sorted(values(got.select("img", "x", "y", "v"))) == sorted(a)
    pred = cells.where("x < 2").withColumn("v", F.col("img").cast("long"))
    pairs = joins.aligned(pred, cells)
    assert pairs.count() == len(a) and pairs.where("pred != img").count() == 0


@pytest.mark.parametrize("radius", [1, 2, 5])
def test_windows_equal_brute_force(radius):
    from framelake.operators import images

    rng = np.random.default_rng(radius)
    a, there = rng.integers(0, 50, (7, 9)).astype(float), rng.random((7, 9)) > 0.2
    v = np.where(there, a, -np.inf)
    brute = np.array([[v[max(0, y - radius) : y + radius + 1, max(0, x - radius) : x + radius + 1].max() for x in range(9)] for y in range(7)])
    assert (images.spread(v, radius) == brute).all()
    ground = np.argwhere(~there)
    far = images.plain_distance(~there)
    assert all(far[y, x] == pytest.approx(np.hypot(*(ground - (y, x)).T).min()) for y in range(7) for x in range(9))
    d = images.square_distance(~there, radius)
    want = np.array([[np.abs(ground - (y, x)).max(axis=1).min() for x in range(9)] for y in range(7)])
    assert (np.nan_to_num(d, nan=99) == np.where(want <= radius, want, 99)).all()


def test_scope_of_a_disc_with_specks(spark):
    y, x = np.mgrid[:60, :70]
    v = np.where(np.hypot(x - 33, y - 30) <= 20, 100, 0)
    v[2, 2:5] = 200
    v[30, 30] = 0
    cells = spark.createDataFrame([(i, int(a), int(b), int(v[b, a]) if i == 0 else 0) for i in range(2) for b in range(60) for a in range(70)], "img int, x int, y int, v int")
    got = {r["img"]: r for r in raster.scope_circle(cells).collect()}
    assert list(got) == [0] and got[0]["cx"] == pytest.approx(33, abs=0.3) and got[0]["cy"] == pytest.approx(30, abs=0.3) and got[0]["r"] == pytest.approx(16, abs=0.8)


def test_padding_there_and_back(spark):
    cells = spark.createDataFrame([(i, x, y, 10 * i + x + y) for i in range(2) for x in range(5 + i) for y in range(3)], "img int, x int, y int, v long")
    sizes = spark.createDataFrame([(0, 5, 3), (1, 6, 3)], "img int, w int, h int")
    out = raster.padded_image(cells, sizes, 4)
    assert out.groupBy("img").agg(F.max("x"), F.max("y"), F.count("*")).count() == 2 and out.count() == 2 * 8 * 4
    assert sorted(values(raster.unpadded_image(out, sizes, 4).select("img", "x", "y", "v"))) == sorted(values(cells))


def test_small_pieces(spark):
    one = spark.range(1)
    got = one.select(keypoints.fixed_length(F.array(F.lit(1.0), F.lit(2.0)), 4, -2.0), keypoints.fixed_length(F.array(F.lit(1.0), F.lit(2.0)), 1, -2.0), keypoints.pruned(F.lit(0.5), F.lit(0.0), 0, 9), keypoints.pruned(F.lit(0.99), F.lit(0.0), 0, 9), keypoints.pruned(F.lit(None).cast("double"), F.lit(0.9), 0, 9)).first()
    assert list(got) == [[1.0, 2.0, -2.0, -2.0], [1.0], True, False, True]
    p = one.select(parsing.probabilities(F.array(F.lit(0.0), F.lit(0.0))), parsing.label_of(F.array(F.lit(0.5))), parsing.label_of(F.array(F.lit(0.2), F.lit(0.4), F.lit(0.4))), parsing.mask_set(F.lit(0.5)), raster.complement(F.lit(0)), raster.complement(F.lit(9))).first()
    assert list(p) == [[0.5, 0.5], 1, 1, False, 255, 0]


def test_spline_of_many_matches_on_a_straight_map(spark):
    x, y = (F.col("id") % 13).cast("double"), F.floor(F.col("id") / 13).cast("double")
    rows = spark.range(100_000).select(F.lit("a").alias("k"), x.alias("x"), y.alias("y"), (x * 1.1 + y * 0.25 + 2).alias("u"), (y * 0.9 - 1).alias("v"))
    got = geometry.splines(rows, "k", [(6.0, 5.0), (0.5, 7000.0)]).collect()
    assert [(r["x"], r["y"], round(r["u"], 6), round(r["v"], 6)) for r in sorted(got, key=lambda r: -r["x"])] == [(6.0, 5.0, 9.85, 3.5), (0.5, 7000.0, 1752.55, 6299.0)]


def test_spline_of_bent_and_collinear_matches(spark):
    rng = np.random.default_rng(2)
    src = rng.uniform(0, 100, (20, 2))
    dst = src + np.sin(src / 20)
    bent = [("bent", *map(float, (*a, *b))) for a, b in zip(src, dst)]
    rows = spark.createDataFrame([*bent, *[("line", float(i), 2.0 * i, float(i), float(i)) for i in range(12)]], "k string, x double, y double, u double, v double")
    got = {r["k"]: (r["u"], r["v"]) for r in geometry.splines(rows.where("k = 'bent'"), "k", [(40.0, 60.0)]).collect()}
    want = geometry.apply_spline(geometry.fit_spline(src, dst), src, np.array([(40.0, 60.0)]))[0]
    assert got["bent"] == pytest.approx(tuple(want), abs=1e-9)
    assert len(geometry.splines(rows, "k", [(40.0, 60.0)]).collect()) == 2


def test_points_equal_in_a_cell_leave_no_tie_open(spark):
    rows = [(i, "a", 1.25, 2.0, 5, 7 if i % 2 else -7) for i in (9, 4, 8, 3, 6)]
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        points = spark.createDataFrame(order, "id long, img string, x double, y double, score int, ori int").coalesce(1)
        assert [r["id"] for r in keypoints.one_per_cell(points).collect()] == [3]


def test_root_normalised_sums_once_for_a_row(spark):
    began = time.time()
    rows = spark.range(2000).select(F.transform(F.sequence(F.lit(1), F.lit(256)), lambda i: (i + F.col("id")).cast("double")).alias("d"))
    got = rows.select(keypoints.root_normalised(F.col("d")).alias("r")).select(F.aggregate("r", F.lit(0.0), lambda s, v: s + v * v).alias("n")).agg(F.min("n"), F.max("n")).first()
    assert got[0] == pytest.approx(1) and got[1] == pytest.approx(1) and time.time() - began < 30


def test_size_bins_deal_an_images_counts_once(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(40), rng.choice([0, 1, 2, 7, None]), rng.choice([0, 1, 2, 7, None])) for _ in range(600)]
    got = metrics.size_bins(spark.createDataFrame(rows, "image int, pred int, gt int"), ["image"], 3, 5, (0, 1, 2))
    want: dict = {}
    for image in range(40):
        for cls in (0, 1, 2):
            own = [(p, g) for i, p, g in rows if i == image]
            n = (sum(p == g == cls for p, g in own), sum(p == cls for p, g in own), sum(g == cls for p, g in own))
            if n[2]:
                key = (cls, 0 if n[2] < 3 else 1 if n[2] < 5 else 2)
                want[key] = tuple(map(sum, zip(want.get(key, (0, 0, 0)), n)))
    assert {(r["cls"], r["bin"]): (r["inter"], r["pred_sum"], r["gt_sum"]) for r in got.collect()} == want
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("partial_count") == 3 and plan.count("HashAggregate") == 4  # two of them, each before and after it is dealt
