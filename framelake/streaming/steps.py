"""The step of one frame, as a stateful stream per video and as the same fold over a batch.

A frame brings its transform to the one before (h00..h22, null where the matches give none), its blur score and shape.
The accumulated transform leads from the frame to its canvas. It starts anew, as the identity, with a video's first frame
and where the shape changes. A policy says what a missing transform does: restart begins a new epoch with this frame,
keep leaves the accumulated one, flag takes the identity and marks needs_reset. Where shear, rotation or scale have gone
too far the canvas is turned so that this frame lies straight in it, and the next frame counts from the identity; never
while a frame is blurred. With reorient "always" that is done after each frame, with "never" not at all (as for canvases
of classes).

transforms_of() makes the transforms from matches, for all frames at once; only the accumulation is sequential, nine
numbers a row. canvases() also keeps the canvas: the base one, which blurred frames leave as it is, and for each frame one
that has this frame in it. reprojected() and model_on_canvas() lead back to the frame.
"""

from __future__ import annotations

import math
from collections import namedtuple
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from framelake.functions.models import Model, stub_segmenter
from framelake.operators import geometry, joins, keypoints, paste
from framelake.operators.raster import warped
from framelake.operators.sequence import fold

NAMES = geometry.NAMES
INPUT = ("video", "frame_id", "h", "w", "blur", *NAMES)
OUTPUT = ", ".join(f"{n} double" for n in NAMES) + ", shear double, rotation double, scale double, epoch long, in_canvas boolean, reoriented boolean, needs_reset boolean"
_OUT = [c.split(" ")[0] for c in OUTPUT.split(", ")]
UNITY = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)


@dataclass(frozen=True)
class StepConfig:
    """Defaults of the step: blur below which a frame stays out of the base canvas, bounds of the transform, policies.

    feather is the length of the pasted frame's ramp in pixels, None for a constant alpha; trim the rim that the base canvas
    doesn't take.
    """

    blur: float = 30.0
    most_shear: float = 15.0
    most_rotation: float = 15.0
    most_scale: float = 2.0
    on_failure: str = "flag"
    reorient: str = "drift"
    canvas_scale: int = 3
    alpha: float = 0.5
    feather: int | None = None
    trim: int = 0


#: The whole-canvas step, its tracking form, its exported form, and the one over class maps, which doesn't blend.
STITCHER = StepConfig(on_failure="restart", feather=paste.RADIUS, trim=paste.TRIM)
TRACKER = StepConfig(on_failure="keep", reorient="always", feather=paste.RADIUS, trim=paste.TRIM)
EXPORTED = StepConfig(feather=paste.RADIUS, trim=paste.TRIM)
PREDICTIONS = StepConfig(on_failure="restart", reorient="never", alpha=1.0)


def decomposed(h: tuple) -> tuple[float, float, float]:
    """Shear, rotation and scale of a transform, as geometry.decompose() gives them."""
    rotation = math.degrees(math.atan2(h[3], h[0]))
    if abs(h[8]) < 1e-8:
        return 0.0, rotation, 1.0
    a, b, c, e = (h[i] / h[8] for i in (0, 1, 3, 4))
    r00 = math.sqrt(a * a + c * c + 1e-8)
    r01 = (a * b + c * e) / r00
    r11 = math.sqrt(max(b * b + e * e - r01 * r01, 1e-8))
    trace, det = a * a + b * b + c * c + e * e, a * e - b * c
    root = math.sqrt(max(trace * trace - 4 * det * det, 0.0))
    most, least = math.sqrt((trace + root) / 2), math.sqrt(max((trace - root) / 2, 1e-16))
    return math.degrees(abs(math.atan(r01 / (r11 + 1e-8)))), rotation, max(most, 1 / least)


def _transform(row) -> tuple | None:
    h = tuple(getattr(row, n) for n in NAMES)
    return None if any(v is None or not math.isfinite(v) for v in h) else tuple(map(float, h))


def step(state: tuple | None, row, config: StepConfig = StepConfig()) -> tuple[tuple, tuple]:
    """(state, values of OUTPUT) after a frame; state is the transform before the next frame, epoch and shape."""
    sharp, shape, found, needs = bool(row.blur >= config.blur), (int(row.h), int(row.w)), _transform(row), False
    begins = state is None or state[2:] != shape or found is None and config.on_failure == "restart"
    epoch = 0 if state is None else state[1] + begins
    if begins:
        h = UNITY
    elif found is None:
        needs = config.on_failure == "flag"
        h = UNITY if needs else state[0]
    else:
        h = tuple(sum(state[0][3 * i + k] * found[3 * k + j] for k in range(3)) for i in range(3) for j in range(3))
    shear, rotation, scale = decomposed(h)
    far = shear > config.most_shear or abs(rotation) > config.most_rotation or scale > config.most_scale
    turned = sharp and not begins and (config.reorient == "always" or config.reorient == "drift" and far)
    return (UNITY if turned else h, epoch, *shape), (*h, shear, rotation, scale, epoch, sharp, turned, needs)


def transforms_of(frames: DataFrame, prev: DataFrame, curr: DataFrame, least_score: float | None = None) -> DataFrame:
    """frames (video, frame_id, ...) with h00..h22, from each to the one before: matched keypoints, then a weighted fit.

    prev and curr (video, frame_id, id, x, y, descriptor): a frame's keypoints as those before and as its own.
    """
    pair = F.struct("video", "frame_id").alias("pair")
    a, b = (side.select(pair, "id", "x", "y", "descriptor") for side in (prev, curr))
    points = keypoints.matched_points(joins.matches(a, b, "pair", least_score), a, b, "pair").withColumnRenamed("score", "w")
    found = geometry.solve_homographies(points.select("pair.*", "x", "y", "u", "v", "w"), ["video", "frame_id"])
    return frames.join(found, ["video", "frame_id"], "left")


def batch_steps(frames: DataFrame, config: StepConfig = StepConfig()) -> DataFrame:
    """frames (INPUT): video and frame_id with the columns of OUTPUT."""
    rows = frames.select(*INPUT, *[F.col(n).alias(f"_{n}") for n in NAMES]).drop(*NAMES)
    rows = rows.select("video", "frame_id", "h", "w", "blur", *[f"_{n}" for n in NAMES])
    return fold(rows, "video", ["frame_id"], lambda s, r: step(s, _Named(r), config), _OUT, OUTPUT).select("video", "frame_id", *_OUT)


class _Named:
    """A row of a fold whose transform goes by underscored names, since the result has the plain ones."""

    def __init__(self, row) -> None:
        self.h, self.w, self.blur = row.h, row.w, row.blur
        for n, v in zip(NAMES, row[5:14]):
            setattr(self, n, v)


class Canvas:
    """A canvas some times as large as its frames, which lie in its middle, and where it has been painted."""

    def __init__(self, h: int, w: int, scale: int, held: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        self.h, self.w, self.scale = h, w, scale
        ch, cw = h * scale, w * scale
        self.place = np.array([[1, 0, (cw - w) // 2], [0, 1, (ch - h) // 2], [0, 0, 1]], float)
        self.values, self.painted = held or (np.zeros((ch, cw)), np.zeros((ch, cw), bool))

    def copy(self) -> Canvas:
        return Canvas(self.h, self.w, self.scale, (self.values.copy(), self.painted.copy()))

    def pasted(self, image: np.ndarray, h: np.ndarray, occluded: np.ndarray, blurred: bool, config: StepConfig) -> Canvas:
        """Pastes the frame under h, and returns the canvas with all of the frame in it, rim included, as its model sees it."""
        m, (ch, cw) = self.place @ h, self.values.shape
        covered = paste.regions(occluded, m, cw, ch, config.trim)
        if covered is None:
            return self.copy()
        new = warped(np.where(occluded, 0, image).astype(float), m, cw, ch)
        alpha = config.alpha if config.feather is None else paste.weight(covered[0], config.feather)
        if config.feather is None:  # the frame's own canvas blends as well
            known = self.painted
            mixed = np.where(covered[1], paste.feathered(self.values, known, new, covered[1] if not blurred else covered[1] & ~known, alpha), self.values)
            own = Canvas(self.h, self.w, self.scale, (mixed, known | covered[1]))
            if not blurred:
                self.values, self.painted = paste.feathered(self.values, known, new, covered[0], alpha), known | covered[0]
            return own
        base, known, shown, seen = paste.pasted(self.values, self.painted, new, *covered, blurred, alpha, not self.painted.any())
        self.values, self.painted = base, known
        return Canvas(self.h, self.w, self.scale, (shown.copy(), seen.copy()))

    def turn(self, h: np.ndarray) -> None:
        """Moves what is painted so that a frame that lay under h lies in the middle, straight."""
        ch, cw = self.values.shape
        m = self.place @ h
        if abs(np.linalg.det(m)) >= 1e-12:
            m = self.place @ np.linalg.inv(m)
            self.values, self.painted = warped(self.values, m, cw, ch), warped(self.painted.astype(float), m, cw, ch) > 0


def occlusion(row, h: int, w: int) -> np.ndarray:
    """A row's column occluded, h x w bytes, as a mask; nothing is occluded without it."""
    data = getattr(row, "occluded", None)
    return np.zeros((h, w), bool) if data is None else np.frombuffer(data, "u1").reshape(h, w) > 0


def canvases(frames: DataFrame, config: StepConfig = StepConfig()) -> DataFrame:
    """frames (INPUT, pixels and maybe occluded, h x w bytes) with OUTPUT, canvas_h, canvas_w, canvas and painted, a byte a place each.

    The canvas of a row has its frame in it, and the coordinates that its transform leads to; occluded places of a frame are
    never pasted.
    """
    names = [*_OUT, "canvas_h", "canvas_w", "canvas", "painted"]
    masked = ["occluded"] if "occluded" in frames.columns else []
    rows = frames.select("video", "frame_id", "h", "w", "blur", *[F.col(n).alias(f"_{n}") for n in NAMES], "pixels", *masked)

    def run(state: tuple | None, row) -> tuple[tuple, tuple]:
        held, base = state or (None, None)
        new, out = step(held, _Named(row), config)
        h, sharp, turned = np.array(out[:9]).reshape(3, 3), out[13], out[14]
        if base is None or new[1] != held[1]:
            base = Canvas(int(row.h), int(row.w), config.canvas_scale)
        image = np.frombuffer(row.pixels, "u1").reshape(int(row.h), int(row.w))
        own = base.pasted(image, h, occlusion(row, *image.shape), not sharp, config)
        packed = (*own.values.shape, np.rint(own.values).clip(0, 255).astype("u1").tobytes(), (own.painted * np.uint8(255)).tobytes())
        if turned:
            base.turn(h)
        return (new, base), (*out, *packed)

    return fold(rows, "video", ["frame_id"], run, names, f"{OUTPUT}, canvas_h int, canvas_w int, canvas binary, painted binary").select("video", "frame_id", "h", "w", *names)


def _per_row(rows: DataFrame, name: str, f: Callable[..., np.ndarray | None]) -> DataFrame:
    """(video, frame_id, h, w, name): f(canvas, transform to it, row) as bytes."""
    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("video", "frame_id", "h", "w")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                canvas = Canvas(r.h, r.w, r.canvas_h // r.h, (np.frombuffer(r.canvas, "u1").reshape(r.canvas_h, r.canvas_w), np.frombuffer(r.painted, "u1").reshape(r.canvas_h, r.canvas_w) > 0))
                image = f(canvas, canvas.place @ np.array([getattr(r, n) for n in NAMES], float).reshape(3, 3), r)
                out.append(None if image is None else np.rint(image).clip(0, 255).astype("u1").tobytes())
            yield pdf[["video", "frame_id", "h", "w"]].assign(**{name: out})

    return rows.mapInPandas(run, f"{', '.join(kinds)}, {name} binary")


def reprojected(rows: DataFrame) -> DataFrame:
    """(video, frame_id, h, w, seen) of canvases() rows: each canvas as its frame sees it."""
    return _per_row(rows, "seen", lambda canvas, m, r: None if abs(np.linalg.det(m)) < 1e-12 else warped(canvas.values, np.linalg.inv(m), r.w, r.h))


def model_on_canvas(rows: DataFrame, crop: str = "original", loader: Callable[[], Model] = stub_segmenter) -> DataFrame:
    """(video, frame_id, h, w, classes) of canvases() rows: the model's classes of a crop of the canvas, led back to the frame.

    crop: original, the frame's corners in the canvas; valid, all that is painted; entire, the canvas. The crop is brought
    to the frame's size for the model and its classes back.
    """

    def run(canvas: Canvas, m: np.ndarray, r) -> np.ndarray | None:
        ch, cw = canvas.values.shape
        x1, y1, x2, y2 = 0, 0, cw, ch
        if crop == "original":
            corners = m @ np.array([(x, y, 1) for x in (0, r.w - 1) for y in (0, r.h - 1)], float).T
            u, v = corners[:2] / np.maximum(corners[2], 1e-6)
            box = (max(0, int(np.floor(u.min()))), max(0, int(np.floor(v.min()))), min(cw, int(np.ceil(u.max()))), min(ch, int(np.ceil(v.max()))))
            x1, y1, x2, y2 = box if box[2] > box[0] and box[3] > box[1] else (0, 0, cw, ch)
        elif crop == "valid" and canvas.painted.any():
            ys, xs = np.nonzero(canvas.painted)
            x1, y1, x2, y2 = xs.min(), ys.min(), xs.max() + 1, ys.max() + 1
        to = np.array([[r.w / (x2 - x1), 0, -x1 * r.w / (x2 - x1)], [0, r.h / (y2 - y1), -y1 * r.h / (y2 - y1)], [0, 0, 1]])
        classes = loader()(warped(canvas.values, to, r.w, r.h).astype("u1")[None])[0]
        if abs(np.linalg.det(m)) < 1e-12:
            return None
        return warped(classes, np.linalg.inv(m) @ np.linalg.inv(to), r.w, r.h)

    return _per_row(rows, "classes", run)


def tracked(done: DataFrame, track: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(video, frame_id, px, py, ...): a tracker's points of the canvas, made of batch_steps() or canvases() rows.

    track may be any plan over these rows; its points go on to points_in_frame(). Points of frames that done lacks, or without
    a place, are left out.
    """
    points = track(done)
    if lacking := {"video", "frame_id", "px", "py"} - set(points.columns):
        raise ValueError(f"a tracker's points lack {sorted(lacking)}")
    return points.where("px is not null and py is not null").join(done.select("video", "frame_id").distinct(), ["video", "frame_id"], "left_semi")


def points_in_frame(points: DataFrame, done: DataFrame, offset_x: Column, offset_y: Column) -> DataFrame:
    """points (video, frame_id, px, py, ...) of the canvas with fx, fy, their places in the frame that done (OUTPUT) leads there."""
    inv = geometry.inverse(geometry.entries())
    fx, fy = geometry.apply(inv, F.col("px") - offset_x, F.col("py") - offset_y)
    rows = points.join(done.select("video", "frame_id", *NAMES), ["video", "frame_id"])
    return rows.withColumn("fx", fx).withColumn("fy", fy).drop(*NAMES)


#: Rows of a video's micro-batch that are sorted in memory, and rows of results that leave together.
HELD = 50_000
_ONE = namedtuple("_ONE", INPUT[1:])


class StepProcessor(StatefulProcessor):
    """step() per video in a stream; a micro-batch's rows of a video are sorted, those up to the last frame seen are late.

    More than HELD rows wait in a map state, by frame, instead of memory.
    """

    def __init__(self, config: StepConfig = StepConfig(), held: int = HELD) -> None:
        self.config, self.held = config, held

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("step", ", ".join(f"{n} double" for n in NAMES) + ", epoch long, h int, w int, frame_id long")
        self.waiting = handle.getMapState("waiting", "frame_id long, place long", "h int, w int, blur double, " + ", ".join(f"{n} double" for n in NAMES))

    def _in_order(self, rows: Iterator[pd.DataFrame]) -> Iterator:
        held, n, place, spilled = [], 0, 0, False

        def spill() -> None:
            nonlocal place
            for pdf in held:
                for row in pdf.itertuples(index=False):
                    values = [None if pd.isna(getattr(row, c)) else getattr(row, c) for c in INPUT[2:]]
                    self.waiting.updateValue((int(row.frame_id), place), (int(values[0]), int(values[1]), *values[2:]))
                    place += 1
            held.clear()

        for pdf in rows:
            held.append(pdf)
            n += len(pdf)
            if n > self.held:
                spill()
                n, spilled = 0, True
        if not spilled:
            yield from pd.concat(held).sort_values("frame_id", kind="stable").itertuples(index=False)
            return
        spill()
        for key in sorted(tuple(map(int, k)) for k in self.waiting.keys()):  # noqa: SIM118
            yield _ONE(key[0], *(math.nan if v is None else v for v in self.waiting.getValue(key)))
            self.waiting.removeKey(key)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: ARG002, N802
        held = self.state.get() if self.state.exists() else None
        state, last = ((tuple(held[:9]), *held[9:12]), held[12]) if held else (None, None)
        out, columns = [], ["video", "frame_id", *_OUT, "late"]
        for row in self._in_order(rows):
            late = last is not None and row.frame_id <= last
            values: tuple = (None,) * len(_OUT)
            if not late:
                state, values = step(state, row, self.config)
                last = row.frame_id
            out.append((key[0], row.frame_id, *values, late))
            if len(out) >= HELD:
                yield pd.DataFrame(out, columns=columns)
                out = []
        if state is not None:
            self.state.update((*state[0], *state[1:], int(last)))
        yield pd.DataFrame(out, columns=columns)

    def close(self) -> None:
        pass


def stream_steps(frames: DataFrame, config: StepConfig = StepConfig(), held: int = HELD) -> DataFrame:
    """The stream's steps, and late: rows that came after a later frame, or again, which have no step. Needs the RocksDB state store.

    streaming.canvas has the step for rows that come out of order by event time.
    """
    kind = frames.schema["video"].dataType.simpleString()
    return frames.select(*INPUT).groupBy("video").transformWithStateInPandas(StepProcessor(config, held), f"video {kind}, frame_id long, {OUTPUT}, late boolean", "Append", "None")
