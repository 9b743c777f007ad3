"""The step with its canvas as tiles: the same fold over a batch and over a stream whose rows come in any order.

The base canvas is a table of tiles, float values and what is painted, of which a frame reads and writes those under it and
under its feather. Turning the canvas writes nothing: it opens a generation, whose tiles are made of the one before where
they are asked for, as a nearest warp of the whole would have made them. After GENERATIONS turns the oldest are written out
and forgotten, so that what is kept doesn't grow with the number of turns.

In a stream the tiles are a map state for each video, and rows wait in another until the watermark says that none before
them can come: event time and a stated lateness. Their order, not that of their arrival, makes the result, which is the
batch's. Spark drops rows that come later than that, and those without an event time are left out. A row whose transform is
null is taken as the step takes it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, MutableMapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from framelake.operators import paste
from framelake.operators.raster import warped
from framelake.operators.sequence import fold
from framelake.streaming import steps

SIDE, GENERATIONS = 64, 8
Tile = tuple[np.ndarray, np.ndarray]
TILES = "array<struct<tx: int, ty: int, values: binary, painted: binary, own: binary, own_painted: binary>>"


class TileCanvas:
    """A canvas some times as large as its frames, which lie in its middle, in tiles that store keeps by (generation, tx, ty)."""

    def __init__(self, h: int, w: int, scale: int, store: MutableMapping[tuple[int, int, int], Tile], turns: list[list[float]], oldest: int = 0, empty: bool = True) -> None:
        self.h, self.w, self.ch, self.cw = h, w, h * scale, w * scale
        self.place = np.array([[1, 0, (self.cw - w) // 2], [0, 1, (self.ch - h) // 2], [0, 0, 1]], float)
        #: turns[i] leads from a place of generation oldest + i + 1 to one of the generation before.
        self.store, self.turns, self.oldest, self.empty = store, turns, oldest, empty
        self.made: dict[tuple[int, int, int], Tile] = {}

    def _shape(self, tx: int, ty: int) -> tuple[int, int]:
        return min(SIDE, self.ch - ty * SIDE), min(SIDE, self.cw - tx * SIDE)

    def tile(self, g: int, tx: int, ty: int) -> Tile:
        """A tile of generation g: stored, made of the generation before, or empty."""
        key = (g, tx, ty)
        if key in self.made:
            return self.made[key]
        held = self.store.get(key)
        if held is None and g > self.oldest:
            held = self._led(g, tx, ty)
        if held is None:
            shape = self._shape(tx, ty)
            held = np.zeros(shape, "f4"), np.zeros(shape, bool)
        self.made[key] = held
        return held

    def _led(self, g: int, tx: int, ty: int) -> Tile:
        m = np.array(self.turns[g - 1 - self.oldest]).reshape(3, 3)
        h, w = self._shape(tx, ty)
        y, x = np.mgrid[ty * SIDE : ty * SIDE + h, tx * SIDE : tx * SIDE + w].astype(float)
        depth = np.maximum(m[2, 0] * x + m[2, 1] * y + m[2, 2], 1e-8)
        u, v = (np.rint((m[i, 0] * x + m[i, 1] * y + m[i, 2]) / depth) for i in (0, 1))
        there = (u >= 0) & (u < self.cw) & (v >= 0) & (v < self.ch)
        u, v = (np.where(there, a, 0).astype("int64") for a in (u, v))
        values, painted = np.zeros((h, w), "f4"), np.zeros((h, w), bool)
        for key in np.unique(np.stack((u[there] // SIDE, v[there] // SIDE), axis=1), axis=0).tolist():
            own = there & (u // SIDE == key[0]) & (v // SIDE == key[1])
            old_values, old_painted = self.tile(g - 1, *key)
            values[own] = old_values[v[own] % SIDE, u[own] % SIDE]
            painted[own] = old_painted[v[own] % SIDE, u[own] % SIDE]
        return values, painted

    def part(self, x0: int, y0: int, x1: int, y1: int) -> Tile:
        """Values and painted places of whole tiles from (x0, y0) to (x1, y1)."""
        g = self.oldest + len(self.turns)
        rows = [[self.tile(g, tx, ty) for tx in range(x0 // SIDE, -(-x1 // SIDE))] for ty in range(y0 // SIDE, -(-y1 // SIDE))]
        return tuple(np.block([[tile[i] for tile in row] for row in rows]) for i in (0, 1))

    def put(self, x0: int, y0: int, values: np.ndarray, painted: np.ndarray, touched: list[tuple[int, int]]) -> None:
        g = self.oldest + len(self.turns)
        for tx, ty in touched:
            h, w = self._shape(tx, ty)
            at = np.s_[ty * SIDE - y0 : ty * SIDE - y0 + h, tx * SIDE - x0 : tx * SIDE - x0 + w]
            self.made[g, tx, ty] = self.store[g, tx, ty] = values[at].astype("f4"), painted[at].copy()

    def paste(self, image: np.ndarray, h: np.ndarray, occluded: np.ndarray, blurred: bool, config: steps.StepConfig) -> list[tuple]:
        """Pastes a frame under h; the tiles that it covers, as TILES has them: the base canvas' and the frame's own."""
        m = self.place @ h
        corners = m @ np.array([(x, y, 1) for x in (-1, self.w) for y in (-1, self.h)], float).T
        if abs(np.linalg.det(m)) < 1e-12 or (corners[2] <= 1e-6).any():
            return []
        u, v = corners[:2] / corners[2]
        margin = 2 * paste.REDUCED
        x0, y0 = (max(0, int(np.floor(p.min())) - margin) // SIDE * SIDE for p in (u, v))
        x1, y1 = (min(most, -(-min(most, int(np.ceil(p.max())) + margin + 1) // SIDE) * SIDE) for p, most in ((u, self.cw), (v, self.ch)))
        if x1 <= x0 or y1 <= y0:
            return []
        near = np.array([[1, 0, -x0], [0, 1, -y0], [0, 0, 1]], float) @ m
        base_region, frame_region = paste.regions(occluded, near, x1 - x0, y1 - y0, config.trim)
        new = warped(np.where(occluded, 0, image).astype(float), near, x1 - x0, y1 - y0)
        values, painted = self.part(x0, y0, x1, y1)
        alpha = config.alpha if config.feather is None else paste.weight(base_region, config.feather, paste.REDUCED, (y0, x0), (self.ch, self.cw))
        base, known, own, seen = paste.pasted(values.astype(float), painted, new, base_region, frame_region, blurred, alpha, self.empty)
        covered = frame_region | base_region
        touched = [(tx, ty) for ty in range(y0 // SIDE, -(-y1 // SIDE)) for tx in range(x0 // SIDE, -(-x1 // SIDE)) if covered[ty * SIDE - y0 : (ty + 1) * SIDE - y0, tx * SIDE - x0 : (tx + 1) * SIDE - x0].any()]
        if not blurred:
            self.put(x0, y0, base, known, touched)
            self.empty = self.empty and not known.any()
        byte = lambda a: np.rint(a).clip(0, 255).astype("u1").tobytes()
        out = []
        for tx, ty in touched:
            h_, w_ = self._shape(tx, ty)
            at = np.s_[ty * SIDE - y0 : ty * SIDE - y0 + h_, tx * SIDE - x0 : tx * SIDE - x0 + w_]
            out.append((tx, ty, byte(base[at]), (known[at] * np.uint8(255)).tobytes(), byte(own[at]), (seen[at] * np.uint8(255)).tobytes()))
        return out

    def turn(self, h: np.ndarray) -> None:
        """Opens a generation in which a frame that lay under h lies in the middle, straight."""
        m = self.place @ h
        if abs(np.linalg.det(m)) < 1e-12:
            return
        self.turns.append(np.linalg.inv(self.place @ np.linalg.inv(m)).ravel().tolist())
        if len(self.turns) > GENERATIONS:
            self._settle()

    def _settle(self) -> None:
        """Writes the generation after the oldest out, as far as something is painted in it, and forgets the oldest."""
        for ty in range(-(-self.ch // SIDE)):
            for tx in range(-(-self.cw // SIDE)):
                values, painted = self.tile(self.oldest + 1, tx, ty)
                if painted.any() and self.store.get((self.oldest + 1, tx, ty)) is None:
                    self.store[self.oldest + 1, tx, ty] = values, painted
        for key in [k for k in self.store if k[0] == self.oldest]:
            del self.store[key]
        self.oldest += 1
        self.turns.pop(0)
        self.made = {k: v for k, v in self.made.items() if k[0] >= self.oldest}


def advance(held: tuple | None, canvas: TileCanvas | None, row, config: steps.StepConfig, store: Callable[[], MutableMapping]) -> tuple[tuple, TileCanvas, tuple, list[tuple]]:
    """(state, canvas, values of OUTPUT, tiles) after a frame; store makes an empty store for a canvas that begins."""
    state, out = steps.step(held, row, config)
    if canvas is None or state[1] != held[1]:
        canvas = TileCanvas(int(row.h), int(row.w), config.canvas_scale, store(), [])
    image = np.frombuffer(row.pixels, "u1").reshape(int(row.h), int(row.w))
    h = np.array(out[:9]).reshape(3, 3)
    canvas.made.clear()
    tiles = canvas.paste(image, h, steps.occlusion(row, *image.shape), not out[13], config)
    if out[14]:
        canvas.turn(h)
    return state, canvas, out, tiles


def _columns(frames: DataFrame) -> list:
    extra = [F.col("occluded") if "occluded" in frames.columns else F.lit(None).cast("binary").alias("occluded")]
    return ["video", "frame_id", "h", "w", "blur", *steps.NAMES, "pixels", *extra]


def batch_canvases(frames: DataFrame, config: steps.StepConfig = steps.EXPORTED) -> DataFrame:
    """frames (INPUT, pixels and maybe occluded): video and frame_id with OUTPUT and tiles, those that the frame covers."""
    rows = frames.select(*_columns(frames)).select("video", "frame_id", "h", "w", "blur", *[F.col(n).alias(f"_{n}") for n in steps.NAMES], "pixels", "occluded")

    def run(state: tuple | None, row) -> tuple[tuple, tuple]:
        named = steps._Named(row)
        named.pixels, named.occluded = row.pixels, row.occluded
        held, canvas = state or (None, None)
        new, canvas, out, tiles = advance(held, canvas, named, config, dict)
        return (new, canvas), (*out, tiles)

    return fold(rows, "video", ["frame_id"], run, [*steps._OUT, "tiles"], f"{steps.OUTPUT}, tiles {TILES}").select("video", "frame_id", *steps._OUT, "tiles")


class _Stored(MutableMapping):
    """Tiles in a map state; keys are read as they are asked for, and only what is put is written."""

    def __init__(self, state, shape: Callable[[int, int], tuple[int, int]]) -> None:
        self.state, self.shape, self.reads, self.writes = state, shape, 0, 0

    def __getitem__(self, key: tuple[int, int, int]) -> Tile:
        if not self.state.containsKey(key):
            raise KeyError(key)
        self.reads += 1
        values, painted = self.state.getValue(key)
        shape = self.shape(*key[1:])
        return np.frombuffer(bytes(values), "f4").reshape(shape), np.frombuffer(bytes(painted), "u1").reshape(shape) > 0

    def __setitem__(self, key: tuple[int, int, int], tile: Tile) -> None:
        self.writes += 1
        self.state.updateValue(key, (np.ascontiguousarray(tile[0], "f4").tobytes(), tile[1].astype("u1").tobytes()))

    def __delitem__(self, key: tuple[int, int, int]) -> None:
        self.state.removeKey(key)

    def __iter__(self) -> Iterator[tuple[int, int, int]]:
        return iter([tuple(map(int, k)) for k in self.state.keys()])  # noqa: SIM118

    def __len__(self) -> int:
        return sum(1 for _ in self.state.keys())  # noqa: SIM118


_ROW = "h int, w int, blur double, " + ", ".join(f"{n} double" for n in steps.NAMES) + ", pixels binary, occluded binary"
_FIELDS = ("h", "w", "blur", *steps.NAMES, "pixels", "occluded")


class _Row:
    def __init__(self, values: tuple) -> None:
        for name, v in zip(_FIELDS, values):
            setattr(self, name, bytes(v) if name in ("pixels", "occluded") and v is not None else v)


class CanvasProcessor(StatefulProcessor):
    """A video's frames in event-time order, its step, and its canvas' tiles."""

    def __init__(self, config: steps.StepConfig) -> None:
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.step = handle.getValueState("step", ", ".join(f"{n} double" for n in steps.NAMES) + ", epoch long, h int, w int, turns array<double>, oldest int, empty boolean")
        self.tiles = handle.getMapState("tiles", "g int, tx int, ty int", "values binary, painted binary")
        self.waiting = handle.getMapState("waiting", "ts long, frame_id long", _ROW)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ARG002, N802, N803
        timers = set()
        for pdf in rows:
            for row in pdf.itertuples(index=False):
                ms = int(row.ts.value // 1_000_000)
                clean = [None if n not in ("pixels", "occluded") and pd.isna(v) else v for n, v in ((n, getattr(row, n)) for n in _FIELDS)]
                clean[0], clean[1] = int(clean[0]), int(clean[1])
                self.waiting.updateValue((ms, int(row.frame_id)), tuple(clean))
                timers.add(ms)
        for ms in timers:
            self.handle.registerTimer(ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ARG002, N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        due = sorted(k for k in (tuple(map(int, k)) for k in self.waiting.keys()) if k[0] <= mark)  # noqa: SIM118
        if not due:
            return
        held, canvas = self._held()
        for place in due:
            row = _Row(self.waiting.getValue(place))
            held, canvas, out, tiles = advance(held, canvas, row, self.config, self._empty)
            if not isinstance(canvas.store, _Stored):
                canvas.store = _Stored(self.tiles, canvas._shape)
            self.waiting.removeKey(place)
            yield _frame([(key[0], place[1], *out, tiles)])
        self.step.update((*held[0], *held[1:], [x for t in canvas.turns for x in t], canvas.oldest, canvas.empty))

    def _empty(self) -> MutableMapping:
        """The map state without any tile, once it is known how large the canvas is."""
        for k in list(self.tiles.keys()):
            self.tiles.removeKey(tuple(k))
        return _Late(self.tiles)

    def _held(self) -> tuple[tuple | None, TileCanvas | None]:
        if not self.step.exists():
            return None, None
        s = self.step.get()
        h, w, turns = int(s[10]), int(s[11]), list(s[12])
        canvas = TileCanvas(h, w, self.config.canvas_scale, {}, [turns[i : i + 9] for i in range(0, len(turns), 9)], int(s[13]), bool(s[14]))
        canvas.store = _Stored(self.tiles, canvas._shape)
        return (tuple(s[:9]), int(s[9]), h, w), canvas

    def close(self) -> None:
        pass


class _Late(dict):
    """Tiles of a canvas that begins, written through to its map state."""

    def __init__(self, state) -> None:
        super().__init__()
        self.state = state

    def __setitem__(self, key: tuple[int, int, int], tile: Tile) -> None:
        super().__setitem__(key, tile)
        self.state.updateValue(key, (np.ascontiguousarray(tile[0], "f4").tobytes(), tile[1].astype("u1").tobytes()))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["video", "frame_id", *steps._OUT, "tiles"])
    names = ("tx", "ty", "values", "painted", "own", "own_painted")
    out["tiles"] = [[dict(zip(names, t)) for t in x] for x in out["tiles"]]
    return out


def stream_canvases(frames: DataFrame, lateness: str, config: steps.StepConfig = steps.EXPORTED) -> DataFrame:
    """batch_canvases() of a stream with event times ts, whose rows come at most lateness after later ones.

    The frames of a video have growing ts. Needs the RocksDB state store; a row comes out when the watermark has passed it.
    Spark leaves out rows that come later still and counts them (numRowsDroppedByWatermark).
    """
    kind = frames.schema["video"].dataType.simpleString()
    rows = frames.where("ts is not null").select("ts", *_columns(frames)).withWatermark("ts", lateness)
    schema = f"video {kind}, frame_id long, {steps.OUTPUT}, tiles {TILES}"
    return rows.groupBy("video").transformWithStateInPandas(CanvasProcessor(config), schema, "Append", "EventTime")
