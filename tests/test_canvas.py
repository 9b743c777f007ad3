"""The canvas of tiles against a whole one, in a batch and in a stream that is stopped, restarted and out of order."""

import datetime

import numpy as np
import pytest

from framelake.operators import geometry, images, paste
from framelake.streaming import canvas, steps

COLUMNS = "video string, frame_id long, ts timestamp, h int, w int, blur double, " + ", ".join(f"{n} double" for n in geometry.NAMES) + ", pixels binary, occluded binary"
T0 = datetime.datetime(2024, 1, 1)


def video(name, n, seed, h=70, w=90, far=False):
    rng, out = np.random.default_rng(seed), []
    for i in range(n):
        angle = np.radians(rng.uniform(-1, 1) * (12 if far else 2))
        m = [np.cos(angle), -np.sin(angle), rng.uniform(-9, 9), np.sin(angle), np.cos(angle), rng.uniform(-9, 9), rng.uniform(-1, 1) * 1e-4, rng.uniform(-1, 1) * 1e-4, 1.0]
        if i % 7 == 5:
            m = [None] * 9
        occluded = np.zeros((h, w), "u1")
        occluded[10 : 10 + i, 20:40] = 255
        image = rng.integers(1, 256, (h, w), "u1")
        out.append((name, i, T0 + datetime.timedelta(seconds=10 * i), h, w, 10.0 if i % 5 == 3 else 80.0, *[None if v is None else float(v) for v in m], bytearray(image.tobytes()), bytearray(occluded.tobytes()) if i % 2 else None))
    return out


def whole_canvas(rows, config):
    """Base and own canvases of a video's frames, on whole arrays that each turn warps."""
    state, base, out = None, None, {}
    for r in rows:
        row = canvas._Row((*r[3:6], *r[6:15], bytes(r[15]), None if r[16] is None else bytes(r[16])))
        new, values = steps.step(state, row, config)
        if base is None or new[1] != state[1]:
            base = steps.Canvas(row.h, row.w, config.canvas_scale)
        image = np.frombuffer(row.pixels, "u1").reshape(row.h, row.w)
        h = np.array(values[:9]).reshape(3, 3)
        own = base.pasted(image, h, steps.occlusion(row, row.h, row.w), not values[13], config)
        out[r[1]] = (base.values.copy(), base.painted.copy(), own.values.copy(), own.painted.copy())
        if values[14]:
            base.turn(h)
        state = new
    return out


@pytest.mark.parametrize(("config", "generations"), [(steps.StepConfig(feather=40, trim=3), 8), (steps.StepConfig(feather=40, trim=3, reorient="always"), 2), (steps.STITCHER, 8), (steps.PREDICTIONS, 8)])
def test_tiles_equal_the_whole_canvas(spark, monkeypatch, config, generations):
    monkeypatch.setattr(canvas, "GENERATIONS", generations)
    monkeypatch.setattr(canvas, "SIDE", 32)
    rows = video("a", 12, 1, far=True)
    want = whole_canvas(rows, config)
    state, held = None, None
    for r in rows:
        row = canvas._Row((*r[3:6], *r[6:15], bytes(r[15]), None if r[16] is None else bytes(r[16])))
        state, held, values, tiles = canvas.advance(state, held, row, config, dict)
        assert tiles and len(tiles) < 60
        for tx, ty, *planes in tiles:
            h, w = held._shape(tx, ty)
            at = np.s_[ty * 32 : ty * 32 + h, tx * 32 : tx * 32 + w]
            got = [np.frombuffer(p, "u1").reshape(h, w) for p in planes]
            for k in (0, 2):
                assert ((got[k + 1] > 0) == want[r[1]][k + 1][at]).mean() > 0.999
                assert (np.abs(got[k] - want[r[1]][k][at]) <= 1).mean() > 0.999
        assert len(held.turns) <= generations
    if config.reorient == "always":
        assert held.oldest > 0 and all(g >= held.oldest for g, *_ in held.store)


def plain(df):
    tile = lambda t: (t["tx"], t["ty"], *(bytes(t[c]) for c in ("values", "painted", "own", "own_painted")))
    return {(r["video"], r["frame_id"]): (*(r[c] for c in steps._OUT), tuple(sorted(map(tile, r["tiles"])))) for r in df.collect()}


@pytest.mark.parametrize("config", [steps.StepConfig(feather=40, trim=3), steps.StepConfig(on_failure="restart", feather=40, reorient="always")])
def test_stream_equals_batch_in_any_order_and_after_a_restart(spark, tmp_path, config):
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = video("a", 9, 1) + video("b", 6, 2, h=40, w=50)
    end = [("z", 0, T0 + datetime.timedelta(days=1), 2, 2, 80.0, *[None] * 9, bytearray(4), None)]
    shuffled = sorted(rows, key=lambda r: r[2] + datetime.timedelta(seconds=int(np.random.default_rng(r[1] + 50).integers(-25, 25))))
    source = str(tmp_path / "in")

    def run(part):
        spark.createDataFrame(part, COLUMNS).coalesce(1).write.mode("append").parquet(source)
        stream = own.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)
        out = canvas.stream_canvases(stream, "60 seconds", config)
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    for part in (shuffled[:5], shuffled[5:11], shuffled[11:] + end, [(*rows[0][:1], 77, *rows[0][2:])]):
        run(part)
    seen = spark.read.parquet(str(tmp_path / "out"))
    want = plain(canvas.batch_canvases(spark.createDataFrame(rows, COLUMNS), config))
    got = plain(seen.where("video <> 'z'"))  # without 77, which came a day late
    assert set(got) == set(want)
    for k in want:
        assert got[k] == want[k], k


def test_only_touched_tiles_are_written():
    rows = video("a", 4, 1)
    config, state, held, writes = steps.StepConfig(feather=40), None, None, []

    class Counting(dict):
        def __setitem__(self, key, tile):
            writes.append(key)
            super().__setitem__(key, tile)

    for r in rows:
        row = canvas._Row((*r[3:6], *r[6:15], bytes(r[15]), None))
        before = len(writes)
        state, held, _, tiles = canvas.advance(state, held, row, config, Counting)
        assert len(writes) - before == (len(tiles) if row.blur >= config.blur else 0)


def test_ramp_by_dilations_and_parts():
    rng = np.random.default_rng(3)
    mask = np.ones((83, 102), bool)
    mask[20:70, 10:95] = False
    mask[40:44, 50:60] = True
    steps_, by = 6, 4
    grid = paste.reduced(mask, by)
    total, now = np.zeros(grid.shape), grid
    for _ in range(steps_):
        now = images.spread(now, 1, np.logical_or)
        total += now
    want = np.clip(paste.enlarged(total / steps_, mask.shape), 0, 1)
    got = paste.ramp(mask, steps_ * by, by)
    assert np.allclose(got, want) and rng is not None
    part = paste.weight(~mask[8:80, 0:100], 24, by, (8, 0), mask.shape)
    assert np.allclose(part[8:60, 8:92], paste.weight(~mask, 24, by)[16:68, 8:92])
    assert paste.ramp(np.zeros((3, 3), bool)).sum() == 0
    assert not paste.trimmed((20, 30), 12).any() and paste.trimmed((30, 40), 12).sum() == 6 * 16


def test_first_frame_blur_and_occlusion():
    new, region = np.full((8, 8), 9.0), np.zeros((8, 8), bool)
    region[2:6, 2:6] = True
    none = np.zeros((8, 8), bool)
    base, known, own, seen = paste.pasted(np.zeros((8, 8)), none, new, region, region, False, 0.5, True)
    assert (base == own).all() and (known == seen).all() and base.sum() == 9 * 16
    base, known, own, seen = paste.pasted(np.zeros((8, 8)), none, new, region, region, True, 0.5, True)
    assert base.sum() == 0 and not known.any() and own.sum() == 9 * 16 and seen.sum() == 16
    painted = np.zeros((8, 8), bool)
    painted[:4] = True
    base, known, own, _ = paste.pasted(np.where(painted, 1.0, 0.0), painted, new, region, region, False, 0.5, False)
    assert base[2, 2] == 5 and base[5, 5] == 9 and own[2, 2] == 9 and known.sum() == 32 + 8
    occluded = np.zeros((30, 30), bool)
    occluded[5:10] = True
    whole, framed = paste.regions(occluded, np.eye(3), 30, 30, 2)
    assert not whole[5:10].any() and not whole[:2].any() and framed[0].all() and not framed[5:10].any()


def test_a_tracker_between_steps_and_frames(spark):
    from pyspark.sql import functions as F

    frames = spark.createDataFrame([(r[0], r[1], *r[3:6], *r[6:15]) for r in video("a", 5, 1)], "video string, frame_id long, h int, w int, blur double, " + ", ".join(f"{n} double" for n in geometry.NAMES))
    done = steps.batch_steps(frames)
    middle = lambda rows: rows.select("video", "frame_id", (F.col("h02") / F.col("h22") + 90).alias("px"), F.when(F.col("frame_id") != 3, F.col("h12") / F.col("h22") + 70).alias("py")).unionByName(spark.createDataFrame([("b", 1, 1.0, 1.0)], "video string, frame_id long, px double, py double"))
    back = steps.points_in_frame(steps.tracked(done, middle), done, F.lit(90), F.lit(70)).collect()
    assert sorted(r["frame_id"] for r in back) == [0, 1, 2, 4]
    assert all(abs(r["fx"]) < 1e-6 and abs(r["fy"]) < 1e-6 for r in back)
    with pytest.raises(ValueError, match="lack"):
        steps.tracked(done, lambda rows: rows.select("video"))
