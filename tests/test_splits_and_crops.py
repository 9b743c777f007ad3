"""Balanced folds against exhaustive search, crops and curved warps against their definitions, and bounded streams."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.operators import geometry, raster, split, tiles
from framelake.streaming import steps


def spread(counts, folds, assigned):
    totals = counts.sum(axis=0)
    held = np.array([counts[np.array(assigned) == f].sum(axis=0) for f in range(folds)])
    return float((((held / totals) - 1 / folds) ** 2).sum())


@pytest.mark.parametrize("seed", range(4))
def test_balanced_folds_are_near_the_best(spark, seed):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 12, (7, 3)) + np.eye(7, 3, dtype=int)
    rows = [(f"g{g}", s) for g in range(7) for s in range(3) for _ in range(counts[g, s])] + [("g0", None), (None, 1)]
    df = spark.createDataFrame(rows, "g string, s int")
    got = {r["g"]: r["fold"] for r in split.balanced_folds(df, "g", F.col("s"), 3).collect()}
    assert set(got) == {None, *(f"g{g}" for g in range(7))} and set(got.values()) <= {0, 1, 2}
    every = np.vstack((counts, [[0, 1, 0]]))
    own = spread(every, 3, [got[f"g{g}"] for g in range(7)] + [got[None]])
    all_of = sorted(spread(every, 3, a) for a in product(range(3), repeat=8))
    assert own <= all_of[len(all_of) // 10]  # among the best tenth of 6561
    again = {r["g"]: r["fold"] for r in split.balanced_folds(df.repartition(5), "g", F.col("s"), 3).collect()}
    assert again == got
    assert split.balanced_folds(df.limit(0), "g", F.col("s"), 3).count() == 0


def test_crops_grow_only_from_painted_boxes(spark):
    mask = np.zeros((20, 30), "u1")
    mask[4:15, 5:25] = 1
    mask[4:9, 25:28] = 1
    hole = mask.copy()
    hole[8, 10] = 0
    rows = [
        (1, mask, "internal", (8.2, 6.1, 12.5, 11.0), None, (5, 4, 25, 15)),
        (2, hole, "internal", (8.2, 6.1, 12.5, 11.0), None, (8, 6, 13, 11)),
        (3, hole, "external", (0.0, 0.0, 4.0, 4.0), None, (5, 4, 28, 15)),
        (4, mask * 0, "external", (-3.0, 2.0, 4.5, 99.0), None, (0, 2, 5, 20)),
        (5, mask, "first", (0.0, 0.0, 4.0, 4.0), (2.5, 3.5, 9.5, 8.5), (2, 3, 10, 9)),
        (6, mask, "first", (0.0, 0.0, 4.0, 4.0), None, (0, 0, 4, 4)),
        (7, mask, "original", (40.0, 0.0, 50.0, 4.0), None, (0, 0, 30, 20)),
        (8, None, "internal", (1.0, 1.0, 3.0, 3.0), None, (1, 1, 3, 3)),
        (9, mask, "entire", None, None, (0, 0, 30, 20)),
        (10, mask, "original", None, None, (None,) * 4),
        (11, mask, "internal", (6.0, 5.0, 24.0, 8.0), None, (5, 4, 28, 9)),
    ]
    none = (None,) * 4
    df = spark.createDataFrame([(i, 20, 30, None if m is None else bytearray(m.tobytes()), mode, *(box or none), *(first or none)) for i, m, mode, box, first, _ in rows], "img int, h int, w int, mask binary, mode string, " + ", ".join(f"{c} double" for c in ("x1", "y1", "x2", "y2", "fx1", "fy1", "fx2", "fy2")))
    got = {r["img"]: (r["cx1"], r["cy1"], r["cx2"], r["cy2"]) for r in raster.cropped_boxes(df).collect()}
    # the eleventh grows to the left, then to the right as far as its rows are painted, then up and down
    assert got == {i: want for i, *_, want in rows}


def test_spline_grid_is_near_the_spline(spark):
    rng = np.random.default_rng(1)
    src = rng.uniform(0, 100, (14, 2))
    dst = src + 3 * np.sin(src[:, ::-1] / 20)
    w = geometry.fit_spline(src, dst)
    image = rng.integers(0, 256, (100, 100), "u1")
    df = spark.createDataFrame([(1, 100, 100, bytearray(image.tobytes()))], "img int, h int, w int, pixels binary")
    one = spark.createDataFrame([(1, src[:, 0].tolist(), src[:, 1].tolist(), w[:-3, 0].tolist(), w[:-3, 1].tolist(), w[-3:, 0].tolist(), w[-3:, 1].tolist())], "img int, " + ", ".join(f"{c} array<double>" for c in ("cx", "cy", "wx", "wy", "ax", "ay")))
    y, x = np.mgrid[:100, :100].astype(float)
    at = geometry.apply_spline(w, src, np.c_[x.ravel(), y.ravel()])
    want = tiles.values_at(image[:, :, None], 0, 0, 100, 100, at[:, 0].reshape(100, 100), at[:, 1].reshape(100, 100))[:, :, 0]
    for step, most in ((1, 1e-6), (8, 40)):
        got = tiles.untiled(tiles.spline_warp(tiles.tiled(df), one, 100, 100, "bilinear", step, out="f8"), kind="f8").first()
        assert np.percentile(np.abs(np.frombuffer(bytes(got["pixels"]), "f8").reshape(100, 100) - want), 99) <= most
    with pytest.raises(ValueError):
        tiles.spline_warp(tiles.tiled(df), one, 10, 10, step=7)


def test_steps_of_a_large_micro_batch_wait_in_the_state(spark, tmp_path):
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = np.random.default_rng(2)
    rows = [(f"v{k}", int(i), 4, 6, float(rng.uniform(0, 60)), *([None] * 9 if rng.random() < 0.1 else [1.0, float(rng.normal() / 50), float(rng.normal()), 0.0, 1.0, 0.5, 0.0, 0.0, 1.0])) for k in range(2) for i in rng.permutation(60)]
    schema = "video string, frame_id long, h int, w int, blur double, " + ", ".join(f"{n} double" for n in geometry.NAMES)
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = steps.stream_steps(own.readStream.schema(df.schema).parquet(str(tmp_path / "in")), held=7)
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    seen = spark.read.parquet(str(tmp_path / "out"))
    assert seen.where("late").count() == 0
    key = lambda r: (r["video"], r["frame_id"])
    got, want = ({key(r): tuple(r[c] for c in steps._OUT) for r in d.collect()} for d in (seen, steps.batch_steps(df)))
    assert got == want and len(got) == 120


def test_scratch_tables_are_forgotten(spark):
    from framelake.sources import scratch

    kept, gone = (scratch.materialise(spark.range(10)) for _ in range(2))
    dealt = scratch.bucketed(spark.range(20), 3, "id")
    for table in (gone, dealt):
        scratch.forget(table)
    assert kept.count() == 10
    for table in (gone, dealt):
        with pytest.raises(Exception, match="exist|NOT_FOUND|not found"):
            table.count()
    before = list(scratch._made)
    scratch.forget(spark.range(3))
    assert scratch._made == before
