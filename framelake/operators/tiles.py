"""Images with channels as tables of tiles: what an operator moves are bytes of tiles, never a row for each pixel.

A tile row (img, tx, ty, iw, ih, n, data) holds the bytes of SIDE x SIDE places with n interleaved channels, fewer at an
image's right and lower edge; iw and ih are the image's sides. Operators say for each tile of their result which box of the
source it needs. One join by tile brings the boxes to the source, where they are cut out, and one exchange brings what was
cut to the tiles of the result: some two times the images' bytes, whatever the operator. An image of any size is spread over
many tasks. `kind` is the NumPy type of a value.

Images without tiles give nothing; null images' rows take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.operators import geometry

SIDE = 64
_TILE = [("tx", pa.int32()), ("ty", pa.int32()), ("iw", pa.int32()), ("ih", pa.int32()), ("n", pa.int32()), ("data", pa.binary())]
_KEY = ("img", "gx", "gy")
_BOX = ("x0", "y0", "x1", "y1")


def _sql(df: DataFrame, column: str = "img") -> str:
    return df.schema[column].dataType.simpleString()


def _tile_schema(df: DataFrame) -> str:
    return f"img {_sql(df)}, tx int, ty int, iw int, ih int, n int, data binary"


def _batch(imgs: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    """Tile rows (place of the image in imgs, tx, ty, iw, ih, n, bytes)."""
    columns = [imgs.take(pa.array([r[0] for r in rows], pa.int64()))] + [pa.array([r[i + 1] for r in rows], t) for i, (_, t) in enumerate(_TILE)]
    return pa.RecordBatch.from_arrays(columns, ["img", *(c for c, _ in _TILE)])


#: Values that are computed or moved together.
_VALUES = 1 << 18
_PLACE = ("img", "tx", "ty")


def _together(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _runs(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each run, length of them, one run after another."""
    ends = np.cumsum(length)
    return np.repeat(begin - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)


def _blocks(begin: np.ndarray, high: np.ndarray, wide: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Where blocks' values lie: high rows of wide values each, from begin on and step from row to row."""
    own = np.repeat(np.arange(len(high)), high)
    return _runs(begin[own] + _runs(np.zeros(len(high), "int64"), high) * step[own], wide[own])


def _values(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of all rows of bytes, one after another, and each row's end among them, from 0 on."""
    large = pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, "i8" if large else "i4")[column.offset : column.offset + len(column) + 1].astype("int64")
    flat = np.frombuffer(b"" if data is None else data, "u1")[ends[0] : ends[-1]].view(kind)
    return flat, (ends - ends[0]) // np.dtype(kind).itemsize


def _bytes(values: np.ndarray, length: np.ndarray) -> pa.Array:
    """Rows of bytes, length values each, of values one after another."""
    ends = np.concatenate(([0], np.cumsum(length))).astype("int64") * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(ends.astype("i4")), pa.py_buffer(np.ascontiguousarray(values))])


def _parts(size: np.ndarray) -> list[tuple[int, int]]:
    """Stretches (from, to) of rows of some size, of some _VALUES each, or of one row."""
    if not len(size):
        return []
    part = (np.cumsum(size) - size) // _VALUES
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(size)]
    return list(zip(cuts, cuts[1:]))


def _ints(rows: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [rows.column(c).to_numpy(zero_copy_only=False).astype("int64") for c in names]


def _made_tiles(imgs: pa.Array, tx: np.ndarray, ty: np.ndarray, iw: np.ndarray, ih: np.ndarray, n: np.ndarray, data: pa.Array) -> pa.RecordBatch:
    ints = [pa.array(np.broadcast_to(a, len(imgs)).astype("int32")) for a in (tx, ty, iw, ih, n)]
    return pa.RecordBatch.from_arrays([imgs, *ints, data], ["img", *(c for c, _ in _TILE)])


def _changes(column: pa.Array) -> np.ndarray:
    """Which rows but the first differ from the row before."""
    if pa.types.is_struct(column.type):
        return np.logical_or.reduce([_changes(c) for c in column.flatten()])
    values = column.to_numpy(zero_copy_only=False)
    return values[1:] != values[:-1]


def _starts(rows: pa.RecordBatch, keys: tuple[str, ...]) -> np.ndarray:
    """The rows at which keys change, the first included."""
    return np.flatnonzero(np.concatenate(([True], np.logical_or.reduce([_changes(rows.column(c)) for c in keys]))))


def _whole(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Sorted batches' rows in batches that end where keys change."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        # rows from the last change of key on wait for the next batch, and a batch without one joins those that wait
        joined = _together([held[-1].slice(held[-1].num_rows - 1), batch]) if held else batch
        changes = _starts(joined, keys)[1:] - bool(held)
        if len(changes):
            cut = int(changes[-1])
            if held or cut:
                yield _together([*held, batch.slice(0, cut)])
            held = []
            batch = batch.slice(cut)
        held.append(batch)
    if held:
        yield _together(held)


def in_groups(left: DataFrame, right: DataFrame, keys: tuple[str, ...], run: Callable[[pa.RecordBatch, np.ndarray, pa.RecordBatch, np.ndarray], Iterator[pa.RecordBatch]], made: str) -> DataFrame:
    """run(left's rows, their groups, right's rows, their groups): rows of many keys at once, each key's whole, groups ascending from 0.

    Keys aren't null. A partition's rows go to Python in one stream, sorted, since a call for each of many small groups costs
    more than their work.
    """
    none = lambda df: F.lit(None).cast(df.select(F.struct(*df.columns).alias("s")).schema["s"].dataType)
    a = left.select(*keys, F.lit(0).alias("_side"), F.struct(*left.columns).alias("_l"), none(right).alias("_r"))
    b = right.select(*keys, F.lit(1).alias("_side"), none(left).alias("_l"), F.struct(*right.columns).alias("_r"))
    rows = a.union(b).repartition(*keys).sortWithinPartitions(*keys, "_side")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole(batches, keys):
            starts = _starts(rows, keys)
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, rows.num_rows)))
            sides = rows.column("_side").to_numpy()
            both = []
            for side, column in enumerate(("_l", "_r")):
                on = np.flatnonzero(sides == side)
                own = rows.column(column).take(pa.array(on))
                both += [pa.RecordBatch.from_arrays(own.flatten(), schema=pa.schema(list(own.type))), group[on]]
            yield from run(*both)

    return rows.mapInArrow(stream, made)


def tiled(images: DataFrame, channels: int = 1, side: int = SIDE, kind: str = "u1") -> DataFrame:
    """Tiles of packed images (img, h, w, pixels): h x w x channels values, row by row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                h, w, data = (batch.column(c)[i].as_py() for c in ("h", "w", "pixels"))
                a = np.frombuffer(data, kind).reshape(h, w, channels)
                rows = [(i, x // side, y // side, w, h, channels, a[y : y + side, x : x + side].tobytes()) for y in range(0, h, side) for x in range(0, w, side)]
                if rows:
                    yield _batch(batch.column("img"), rows)

    rows = images.where("img is not null and pixels is not null").select("img", "h", "w", "pixels")
    return rows.mapInArrow(cut, _tile_schema(images))


def untiled(tiles: DataFrame, side: int = SIDE, kind: str = "u1") -> DataFrame:
    """Packed images (img, h, w, n, pixels) of tiles; places without a tile are 0."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole(batches, ("img",)):
            starts = _starts(rows, ("img",))
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, rows.num_rows)))
            heads = rows.take(pa.array(starts))
            iw, ih, n = _ints(heads, "iw", "ih", "n")
            size = iw * ih * n
            for first, last in _parts(size):
                on = slice(starts[first], starts[last] if last < len(starts) else rows.num_rows)
                part = rows.slice(on.start, on.stop - on.start)
                g, (tx, ty) = group[on], _ints(part, "tx", "ty")
                begin = (np.cumsum(size[first:last]) - size[first:last])[g - first]
                out = np.zeros(int(size[first:last].sum()), kind)
                high, wide = np.minimum(side, ih[g] - ty * side), np.minimum(side, iw[g] - tx * side)
                out[_blocks(begin + (ty * side * iw[g] + tx * side) * n[g], high, wide * n[g], iw[g] * n[g])] = _values(part.column("data"), kind)[0]
                some = heads.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("img", "ih", "iw", "n")), _bytes(out, size[first:last])], ["img", "h", "w", "n", "pixels"])

    rows = tiles.where("img is not null").select("img", *(c for c, _ in _TILE)).repartition("img").sortWithinPartitions("img")
    return rows.mapInArrow(join, f"img {_sql(tiles)}, h int, w int, n int, pixels binary")


def _every_tile(sizes: DataFrame, side: int) -> DataFrame:
    """(img, tx, ty, iw, ih) of all tiles of images of the sizes (img, iw, ih)."""
    last = lambda c: F.sequence(F.lit(0), F.floor((F.col(c) - 1) / side).cast("int"))
    every = sizes.where("img is not null and iw > 0 and ih > 0").select("img", F.col("iw").cast("int").alias("iw"), F.col("ih").cast("int").alias("ih"), F.explode(last("iw")).alias("tx"))
    return every.select("img", "tx", F.explode(last("ih")).alias("ty"), "iw", "ih")


def from_cells(cells: DataFrame, sizes: DataFrame, values: tuple[str, ...] = ("v",), side: int = SIDE, kind: str = "u1", empty: float = 0, summed: Callable[[np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]] | None = None) -> DataFrame:
    """Tiles of cells (img, x, y, a column for each channel), of images of the sizes (img, iw, ih); other places are empty.

    With summed, a place may have many rows, whose one value, a whole number, is added up as the tiles are filled;
    summed(totals, x, y) gives the channels of the places that have a value. The rows then need no aggregation before.

    Cells and tiles are dealt once, by tile, a tile's own row before its cells; the tiles of a batch are filled together.
    """
    names = [f"v{i}" for i in range(len(values))]
    channels = len(summed(*np.zeros((3, 0), "int64"))) if summed else len(values)
    cells = cells.where(F.col(values[0]).isNotNull()) if summed else cells
    kinds = {n: _sql(cells, c) for n, c in zip(names, values)} | {c: _sql(cells, c) for c in ("x", "y")}
    null = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    every = _every_tile(sizes, side).select("img", "tx", "ty", F.lit(0).alias("_side"), "iw", "ih", null("x"), null("y"), *map(null, names))
    own = [F.floor(F.col(c) / side).cast("int").alias(t) for c, t in (("x", "tx"), ("y", "ty"))]
    none = [F.lit(None).cast("int").alias(c) for c in ("iw", "ih")]
    inside = cells.where("x >= 0 and y >= 0").select(F.col("img").alias("img"), *own, F.lit(1).alias("_side"), *none, "x", "y", *[F.col(c).alias(n) for c, n in zip(values, names)])
    rows = every.union(inside).repartition("img", "tx", "ty").sortWithinPartitions("img", "tx", "ty", "_side")

    def fill(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """The tiles of complete groups of rows; groups without a tile's row are cells outside their image."""
        starts = _starts(rows, _PLACE)
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, rows.num_rows)))
        sides = rows.column("_side").to_numpy()
        real = sides[starts] == 0
        heads = rows.take(pa.array(starts[real]))
        number = np.where(real, np.cumsum(real) - 1, -1)[group]
        tx, ty, iw, ih = _ints(heads, "tx", "ty", "iw", "ih")
        cell = np.flatnonzero((sides == 1) & (number >= 0))
        own, (x, y) = number[cell], _ints(rows.take(pa.array(cell)), "x", "y")
        there = (x < iw[own]) & (y < ih[own])
        cell, own, x, y = (a[there] for a in (cell, own, x, y))
        wide, high, n = np.minimum(side, iw - tx * side), np.minimum(side, ih - ty * side), channels
        size = wide * high * n
        for first, last in _parts(size):
            begin = np.cumsum(size[first:last]) - size[first:last]
            out = np.full(int(size[first:last].sum()), empty, kind)
            on = slice(*np.searchsorted(own, (first, last)))
            k = own[on]
            at = begin[k - first] + ((y[on] - ty[k] * side) * wide[k] + x[on] - tx[k] * side) * n
            found = rows.take(pa.array(cell[on]))
            if summed:
                place = at // n
                totals, px, py = (np.zeros(len(out) // n, "int64") for _ in range(3))
                np.add.at(totals, place, found.column("v0").to_numpy(zero_copy_only=False).astype("int64"))
                px[place], py[place] = x[on], y[on]
                there = np.unique(place)
                found = dict(enumerate(summed(totals[there], px[there], py[there])))
                at = there * n
            for i in range(n):
                out[at + i] = found[i] if summed else found.column(names[i]).to_numpy(zero_copy_only=False)
            part = heads.slice(first, last - first)
            yield _made_tiles(part.column("img"), *(a[first:last] for a in (tx, ty, iw, ih)), n, _bytes(out, size[first:last]))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole(batches, _PLACE):
            yield from fill(rows)

    return rows.mapInArrow(stream, _tile_schema(sizes))


def computed(sizes: DataFrame, f: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], channels: int, side: int = SIDE, kind: str = "u1") -> DataFrame:
    """Tiles of images of the sizes (img, iw, ih) whose values are f(img, x, y), height x width x channels, made in the tasks."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, (img, tx, ty, iw, ih) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("img", "tx", "ty", "iw", "ih")))):
                y, x = np.mgrid[ty * side : min(ih, (ty + 1) * side), tx * side : min(iw, (tx + 1) * side)]
                rows.append((i, tx, ty, iw, ih, channels, np.ascontiguousarray(f(img, x, y), kind).tobytes()))
            if rows:
                yield _batch(batch.column("img"), rows)

    return _every_tile(sizes, side).mapInArrow(make, _tile_schema(sizes))


def to_cells(tiles: DataFrame, side: int = SIDE, kind: str = "u1") -> DataFrame:
    """(img, x, y, c, v) of all places and channels of tiles."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tx, ty, iw, ih, n, data = (batch.column(c)[i].as_py() for c, _ in _TILE)
                h, w = min(side, ih - ty * side), min(side, iw - tx * side)
                y, x, c = (a.ravel() for a in np.mgrid[:h, :w, :n])
                v = np.frombuffer(data, kind).astype("float64")
                img = batch.column("img").take(pa.array(np.full(len(v), i)))
                yield pa.RecordBatch.from_arrays([img, pa.array((x + tx * side).astype("int32")), pa.array((y + ty * side).astype("int32")), pa.array(c.astype("int32")), pa.array(v)], ["img", "x", "y", "c", "v"])

    return tiles.mapInArrow(spread, f"img {_sql(tiles)}, x int, y int, c int, v double")


def moments(tiles: DataFrame, side: int = SIDE, kind: str = "u1") -> DataFrame:
    """(img, c, total, by_x, by_y): each channel's sums of its values, plain and times x + 1 and y + 1; sums leave the tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ty, tx, iw, ih, n = _ints(batch, "ty", "tx", "iw", "ih", "n")
            wide, high = np.minimum(side, iw - tx * side), np.minimum(side, ih - ty * side)
            for first, last in _parts(wide * high * n):
                w, h, k, x0, y0 = (a[first:last] for a in (wide, high, n, tx, ty))
                v = _values(batch.column("data").slice(first, last - first), kind)[0].astype("float64")
                at = np.repeat(np.arange(last - first), w * h * k)
                place = _runs(np.zeros(last - first, "int64"), w * h * k)
                c, place = place % k[at], place // k[at]
                most = int(k.max(initial=1))
                add_up = lambda weights, to=at * most + c, n=(last - first) * most: np.bincount(to, weights=weights, minlength=n)
                sums = [add_up(v), add_up(v * (place % w[at] + (x0 * side)[at] + 1)), add_up(v * (place // w[at] + (y0 * side)[at] + 1))]
                there = _runs(np.arange(last - first) * most, k)
                imgs = batch.column("img").slice(first, last - first).take(pa.array(there // most))
                yield pa.RecordBatch.from_arrays([imgs, pa.array((there % most).astype("int32")), *(pa.array(a[there]) for a in sums)], ["img", "c", "total", "by_x", "by_y"])

    found = tiles.mapInArrow(add, f"img {_sql(tiles)}, c int, total double, by_x double, by_y double")
    return found.groupBy("img", "c").agg(*[F.sum(c).alias(c) for c in ("total", "by_x", "by_y")])


def class_places(tiles: DataFrame, side: int = SIDE, kind: str = "u1") -> DataFrame:
    """(img, cls, n, sum_x, sum_y): how many places of one-channel tiles hold a class, and the sums of their x and y."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ty, tx, iw, ih = _ints(batch, "ty", "tx", "iw", "ih")
            wide, high = np.minimum(side, iw - tx * side), np.minimum(side, ih - ty * side)
            for first, last in _parts(wide * high):
                w, h, x0, y0 = (a[first:last] for a in (wide, high, tx, ty))
                cls = _values(batch.column("data").slice(first, last - first), kind)[0].astype("int64")
                at = np.repeat(np.arange(last - first), w * h)
                place = _runs(np.zeros(last - first, "int64"), w * h)
                x, y = place % w[at] + (x0 * side)[at], place // w[at] + (y0 * side)[at]
                order = np.lexsort((cls, at))
                at, cls, x, y = (a[order] for a in (at, cls, x, y))
                starts = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (cls[1:] != cls[:-1]))))
                hits = np.diff(np.append(starts, len(at)))
                imgs = batch.column("img").slice(first, last - first).take(pa.array(at[starts]))
                sums = [pa.array(np.add.reduceat(a, starts)) for a in (x, y)]
                yield pa.RecordBatch.from_arrays([imgs, pa.array(cls[starts]), pa.array(hits), *sums], ["img", "cls", "n", "sum_x", "sum_y"])

    found = tiles.mapInArrow(count, f"img {_sql(tiles)}, cls long, n long, sum_x long, sum_y long")
    return found.groupBy("img", "cls").agg(*[F.sum(c).alias(c) for c in ("n", "sum_x", "sum_y")])


def sizes_of(tiles: DataFrame) -> DataFrame:
    """(img, iw, ih, n) of the images that tiles make up."""
    return tiles.where("tx = 0 and ty = 0").select("img", "iw", "ih", "n")


class Patches(NamedTuple):
    """Parts of images, one after another in values: each of wide x high places of n channels, from (x0, y0) on."""

    values: np.ndarray
    n: int
    begin: np.ndarray
    x0: np.ndarray
    y0: np.ndarray
    wide: np.ndarray
    high: np.ndarray


def gathered(tiles: DataFrame, requests: DataFrame, f: Callable[[pa.RecordBatch, np.ndarray, Patches], pa.RecordBatch], made: str, side: int = SIDE, kind: str = "u1") -> DataFrame:
    """f(rows, group, patches) for the (img, gx, gy) of requests (img, gx, gy, n, x0, y0, x1, y1, ...), many at once.

    rows are the groups' requests, group says for each which of patches is its own: the source's values over the smallest box
    that holds all of the group's boxes, which end before x1 and y1, lie in the image, and may be empty; patches that are
    empty come in calls of their own. All requests of a call agree in n, and all patches in their channels.
    """
    boxes = requests.where("x1 > x0 and y1 > y0").groupBy(*_KEY).agg(*[(F.min if c.endswith("0") else F.max)(c).alias(c) for c in _BOX])
    tile = lambda c: F.floor(F.col(c) / side).cast("int")
    needs = boxes.select("*", F.explode(F.sequence(tile("x0"), F.floor((F.col("x1") - 1) / side).cast("int"))).alias("tx"))
    needs = needs.select("*", F.explode(F.sequence(tile("y0"), F.floor((F.col("y1") - 1) / side).cast("int"))).alias("ty"))
    places = ("gx", "gy", *_BOX)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tx, ty, iw, ih, n, x0, y0, x1, y1 = _ints(batch, "tx", "ty", "iw", "ih", "n", *_BOX)
            w, h = np.minimum(side, iw - tx * side), np.minimum(side, ih - ty * side)
            left, top = np.maximum(x0 - tx * side, 0), np.maximum(y0 - ty * side, 0)
            wide, high = np.minimum(x1 - tx * side, w) - left, np.minimum(y1 - ty * side, h) - top
            for first, last in _parts(w * h * n):
                on = slice(first, last)
                rows = batch.slice(first, last - first)
                values, ends = _values(rows.column("data"), kind)
                at = _blocks(ends[:-1] + (top[on] * w[on] + left[on]) * n[on], high[on], wide[on] * n[on], w[on] * n[on])
                made = [pa.array(a.astype("int32")) for a in ((left + tx * side)[on], (top + ty * side)[on], wide[on])]
                columns = [*(rows.column(c) for c in ("img", *places, "n")), *made, _bytes(values[at], (wide * high * n)[on])]
                yield pa.RecordBatch.from_arrays(columns, ["img", *places, "n", "left", "top", "wide", "piece"])

    img = _sql(tiles)
    kinds = dict(requests.dtypes)
    cut_schema = f"img {img}, " + ", ".join(f"{c} {kinds[c]}" for c in places) + ", n int, left int, top int, wide int, piece binary"
    pieces = needs.join(tiles, ["img", "tx", "ty"]).select("img", *places, "tx", "ty", "iw", "ih", "n", "data").mapInArrow(cut, cut_schema)

    def run(rows: pa.RecordBatch, group: np.ndarray, own: pa.RecordBatch, owner: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not rows.num_rows:
            return
        groups = int(max(group[-1], owner[-1] if len(owner) else 0)) + 1
        x0, y0, x1, y1, asked, cut_n = np.zeros((6, groups), "int64")
        for a, c in zip((x0, y0, x1, y1, cut_n), (*_BOX, "n")):
            (a[owner],) = (_ints(own, c),)
        asked[group] = _ints(rows, "n")[0]
        size = (x1 - x0) * (y1 - y0) * cut_n
        # a group weighs what its patch and its requests' results may take
        weight = size + np.bincount(group, minlength=groups) * side
        number = np.unique(np.stack((asked, cut_n)), axis=1, return_inverse=True)[1].ravel()
        for kind_of in range(number.max() + 1):
            of = np.flatnonzero(number == kind_of)
            for first, last in _parts(weight[of] + side * side):
                part = of[first:last]
                new = np.full(groups, -1)
                new[part] = np.arange(len(part))
                asking, held = np.flatnonzero(new[group] >= 0), np.flatnonzero(new[owner] >= 0)
                if not len(asking):
                    continue
                n, begin = int(cut_n[part[0]]), np.cumsum(size[part]) - size[part]
                patches = Patches(np.zeros(int(size[part].sum()), kind), n, begin, x0[part], y0[part], (x1 - x0)[part], (y1 - y0)[part])
                if len(held):
                    cut_out, g = own.take(pa.array(held)), new[owner[held]]
                    left, top, wide = _ints(cut_out, "left", "top", "wide")
                    values, ends = _values(cut_out.column("piece"), kind)
                    high = np.diff(ends) // np.maximum(wide * n, 1)
                    at = begin[g] + ((top - patches.y0[g]) * patches.wide[g] + left - patches.x0[g]) * n
                    patches.values[_blocks(at, high, wide * n, patches.wide[g] * n)] = values
                yield f(rows.take(pa.array(asking)), new[group[asking]], patches)

    return in_groups(requests.drop(*_BOX), pieces, _KEY, run, made)


def values_at(patch: np.ndarray, x0: int, y0: int, iw: int, ih: int, u: np.ndarray, v: np.ndarray, mode: str = "bilinear", edge: bool = False) -> np.ndarray:
    """An image's values (... x channels) at places (u, v), patch being its part from (x0, y0) on.

    nearest rounds half to even; bilinear weighs the four places around, and those outside the image count as 0, so that
    the weight of a border place fades over the last step; with edge, places outside are moved to the edge first.
    """
    one = lambda v: np.array([v], "int64")
    held = Patches(np.ravel(patch), patch.shape[2], one(0), one(x0), one(y0), one(patch.shape[1]), one(patch.shape[0]))
    return values_in(held, np.zeros(u.size, "int64"), iw, ih, u.ravel(), v.ravel(), mode, edge).reshape(*u.shape, patch.shape[2])


def values_in(patches: Patches, own: np.ndarray, iw: np.ndarray, ih: np.ndarray, u: np.ndarray, v: np.ndarray, mode: str = "bilinear", edge: bool = False) -> np.ndarray:
    """values_at() (places x channels) of places in many patches, own being the place's patch and iw, ih its image's sides."""
    if not patches.values.size:
        return np.zeros((len(u), patches.n))
    if edge:
        u, v = np.clip(u, 0, iw - 1), np.clip(v, 0, ih - 1)
    begin, x0, y0, wide, high = (a[own] for a in patches[2:])
    channels = np.arange(patches.n)

    def at(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        there = (x >= 0) & (x < iw) & (y >= 0) & (y < ih)
        x, y = (np.clip(np.where(there, a, 0).astype("int64") - o, 0, n - 1) for a, o, n in ((x, x0, wide), (y, y0, high)))
        return np.where(there[:, None], patches.values[(begin + (y * wide + x) * patches.n)[:, None] + channels], 0)

    if mode == "nearest":
        return at(np.rint(u), np.rint(v)).astype("float64")
    bu, bv = np.floor(u), np.floor(v)
    weight = lambda i, j: (np.abs(1 - i - (u - bu)) * np.abs(1 - j - (v - bv)))[:, None]
    return sum(weight(i, j) * at(bu + i, bv + j) for i in (0, 1) for j in (0, 1))


def _stored(values: np.ndarray, kind: str) -> np.ndarray:
    """Values in kind: whole numbers are cut off and kept within their range."""
    if np.issubdtype(np.dtype(kind), np.integer):
        bounds = np.iinfo(kind)
        values = np.trunc(values).clip(bounds.min, bounds.max)
    return np.ascontiguousarray(values.astype(kind))


def _resampled(tiles: DataFrame, requests: DataFrame, places: Callable, width: int, height: int, mode: str, edge: bool, side: int, kind: str, out: str) -> DataFrame:
    """Tiles of width x height images; places(rows, own, x, y) gives where in the source places lie, own being a place's request in rows."""

    def sample(rows: pa.RecordBatch, group: np.ndarray, patches: Patches) -> pa.RecordBatch:
        gx, gy, iw, ih, channels = _ints(rows, "gx", "gy", "iw", "ih", "n")
        n = int(channels[0])
        wide, high = np.minimum(side, width - gx * side), np.minimum(side, height - gy * side)
        own = np.repeat(np.arange(len(gx)), wide * high)
        if patches.values.size:
            place = _runs(np.zeros(len(gx), "int64"), wide * high)
            x, y = (place % wide[own] + (gx * side)[own]).astype("float64"), (place // wide[own] + (gy * side)[own]).astype("float64")
            values = values_in(patches, group[own], iw[own], ih[own], *places(rows, own, x, y), mode, edge)
        else:
            values = np.zeros((len(own), n))
        return _made_tiles(rows.column("img"), gx, gy, width, height, n, _bytes(_stored(values, out), wide * high * n))

    return gathered(tiles, requests, sample, _tile_schema(tiles), side, kind)


def _inverse_places(rows: pa.RecordBatch, own: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the inverse transform (i00..i22) sends places; the denominator is kept above 1e-8."""
    i = [rows.column(f"i{a}{b}").to_numpy(zero_copy_only=False)[own] for a in range(3) for b in range(3)]
    w = np.maximum(i[6] * x + i[7] * y + i[8], 1e-8)
    return (i[0] * x + i[1] * y + i[2]) / w, (i[3] * x + i[4] * y + i[5]) / w


def warp(tiles: DataFrame, transforms: DataFrame, width: int, height: int, mode: str = "bilinear", side: int = SIDE, kind: str = "u1", out: str | None = None) -> DataFrame:
    """Tiles of each image under its transform (img, h00..h22), on width x height places, in the type out (kind).

    A place takes the value from where the inverse sends it, 0 outside the image; a singular transform gives zeros. The
    corners of a tile under the inverse bound the box that it needs, as long as the denominator stays positive on it; else
    it needs the whole image.
    """
    inv = geometry.inverse(geometry.entries())
    names = [f"i{a}{b}" for a in range(3) for b in range(3)]
    rows = sizes_of(tiles).join(transforms.select("img", *[inv[a][b].cast("double").alias(f"i{a}{b}") for a in range(3) for b in range(3)]), "img")
    last = lambda n: (n - 1) // side
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(last(height)))).alias("gy")).select("*", F.explode(F.sequence(F.lit(0), F.lit(last(width)))).alias("gx"))
    corners = [(x, y) for x in (F.col("gx") * side, F.least((F.col("gx") + 1) * side, F.lit(width)) - 1) for y in (F.col("gy") * side, F.least((F.col("gy") + 1) * side, F.lit(height)) - 1)]
    depth = [F.col("i20") * x + F.col("i21") * y + F.col("i22") for x, y in corners]
    safe = F.least(*depth) > 1e-6
    ends = {}
    for c, top, size in (("x", "i0", "iw"), ("y", "i1", "ih")):
        places = [(F.col(f"{top}0") * x + F.col(f"{top}1") * y + F.col(f"{top}2")) / w for (x, y), w in zip(corners, depth)]
        low, high = F.floor(F.least(*places)) - 1, F.ceil(F.greatest(*places)) + 2
        ends[f"{c}0"] = F.when(safe, F.greatest(F.lit(0), F.least(low, F.col(size)))).otherwise(0)
        ends[f"{c}1"] = F.when(safe, F.greatest(F.lit(0), F.least(high, F.col(size)))).otherwise(F.col(size))
    singular = F.col("i00").isNull()
    boxes = [F.when(singular, 0).otherwise(ends[c]).cast("int").alias(c) for c in _BOX]
    requests = rows.select("img", "gx", "gy", "iw", "ih", "n", *names, *boxes)
    return _resampled(tiles, requests, _inverse_places, width, height, mode, False, side, kind, out or kind)


def resize(tiles: DataFrame, width: int, height: int, mode: str = "bilinear", align_corners: bool = False, side: int = SIDE, kind: str = "u1", out: str | None = None) -> DataFrame:
    """Tiles of each image on width x height places, as raster.resize() says it for cells."""

    def at(p: np.ndarray, old: int, new: int) -> np.ndarray:
        if mode == "nearest":
            return np.floor(p * old / new)
        return p * (old - 1) / max(1, new - 1) if align_corners else (p + 0.5) * old / new - 0.5

    def places(rows: pa.RecordBatch, own: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        iw, ih = (a[own] for a in _ints(rows, "iw", "ih"))
        return at(x, iw, width), at(y, ih, height)

    last = lambda n: (n - 1) // side
    rows = sizes_of(tiles).select("*", F.explode(F.sequence(F.lit(0), F.lit(last(height)))).alias("gy")).select("*", F.explode(F.sequence(F.lit(0), F.lit(last(width)))).alias("gx"))
    ends = []
    for c, g, old, new in (("x", "gx", "iw", width), ("y", "gy", "ih", height)):
        step = (F.col(old) - 1) / F.lit(max(1, new - 1)) if align_corners else F.col(old) / F.lit(new)
        low, high = F.floor(F.col(g) * side * step) - 2, F.ceil(F.least((F.col(g) + 1) * side, F.lit(new)) * step) + 2
        ends += [F.greatest(F.lit(0), F.least(low, F.col(old) - 1)).cast("int").alias(f"{c}0"), F.least(high, F.col(old)).cast("int").alias(f"{c}1")]
    return _resampled(tiles, rows.select("img", "gx", "gy", "iw", "ih", "n", *ends), places, width, height, mode, True, side, kind, out or kind)


def warp_labels(labels: DataFrame, flow: DataFrame, side: int = SIDE, kind: str = "u1", flow_kind: str = "f4") -> DataFrame:
    """Tiles of the labels before at the places to which flow leads: tiles of channels dx and dy, of the same images.

    Of the classes (the labels' first channel) of the four places around, the one of the largest bilinear weight wins, ties
    to the smallest; negative labels and places outside the image are class 0. A third channel of flow says where there is any; elsewhere the
    result is -1, which kind must hold.
    """

    def places(rows: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """Of all places of rows of one number of channels: row, u, v and the third channel, if any, and each row's places."""
        tx, ty, ih, n = _ints(rows, "gx", "gy", "ih", "n")
        a = _values(rows.column("flow"), flow_kind)
        size = np.diff(a[1]) // n
        a, own = a[0].reshape(-1, n[0]).astype("float64"), np.repeat(np.arange(len(size)), size)
        wide = size // np.maximum(np.minimum(side, ih - ty * side), 1)
        place = _runs(np.zeros(len(size), "int64"), size)
        return own, place % wide[own] + (tx * side)[own] + a[:, 0], place // wide[own] + (ty * side)[own] + a[:, 1], a[:, 2] > 0 if n[0] > 2 else None, size

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = _ints(batch, "n")[0]
            for one in np.unique(n):
                whole = batch.take(pa.array(np.flatnonzero(n == one)))
                for first, last in _parts(np.diff(_values(whole.column("flow"), flow_kind)[1])):
                    rows = whole.slice(first, last - first)
                    _, u, v, _, size = places(rows)
                    starts, ends = np.cumsum(size) - size, {}
                    for c, p, most in zip("xy", (u, v), _ints(rows, "iw", "ih")):
                        ends[f"{c}0"] = np.clip(np.floor(np.minimum.reduceat(p, starts)), 0, most)
                        ends[f"{c}1"] = np.clip(np.floor(np.maximum.reduceat(p, starts) + 2), 0, most)
                    yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(ends[c].astype("int32")) for c in _BOX)], [*rows.schema.names, *_BOX])

    rows = flow.select("img", F.col("tx").alias("gx"), F.col("ty").alias("gy"), "iw", "ih", "n", F.col("data").alias("flow"))
    requests = rows.mapInArrow(boxes, f"img {_sql(flow)}, gx int, gy int, iw int, ih int, n int, flow binary, x0 int, y0 int, x1 int, y1 int")

    def vote(rows: pa.RecordBatch, group: np.ndarray, patches: Patches) -> pa.RecordBatch:
        own, u, v, there, size = places(rows)
        iw, ih = (a[own] for a in _ints(rows, "iw", "ih"))
        bu, bv = np.floor(u), np.floor(v)
        cls, weight = [], []
        for i in (0, 1):
            for j in (0, 1):
                found = values_in(patches, group[own], iw, ih, bu + i, bv + j, "nearest")
                cls.append(np.maximum(found[:, 0], 0) if found.shape[1] else np.zeros(len(own)))
                weight.append(np.abs(1 - i - (u - bu)) * np.abs(1 - j - (v - bv)))
        cls, weight = np.array(cls), np.array(weight)
        total = np.round((weight[None] * (cls[:, None] == cls[None])).sum(axis=1), 9)
        best = np.where(total == total.max(axis=0), cls, np.inf).min(axis=0)
        best = best if there is None else np.where(there, best, -1)
        tx, ty, iw, ih = _ints(rows, "gx", "gy", "iw", "ih")
        return _made_tiles(rows.column("img"), tx, ty, iw, ih, 1, _bytes(best.astype(kind), size))

    return gathered(labels, requests, vote, _tile_schema(labels), side, kind)


def confusion(a: DataFrame, b: DataFrame, side: int = SIDE, kind: str = "i4") -> DataFrame:
    """(img, pred, gt, n): how often a class of a meets a class of b in one place of an image; negative ones don't count.

    a and b are tiles of one channel; counts leave the tasks, not places. Tiles of one image are of one size in both.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], [[], [], []]
            for i in range(batch.num_rows):
                p, g = (np.frombuffer(batch.column(c)[i].as_buffer(), kind).astype("int64") for c in ("data", "_data"))
                ok = (p >= 0) & (g >= 0)
                pairs, n = np.unique(np.stack((p[ok], g[ok])), axis=1, return_counts=True)
                at += [i] * len(n)
                for column, values in zip(out, (pairs[0], pairs[1], n)):
                    column += values.tolist()
            yield pa.RecordBatch.from_arrays([batch.column("img").take(pa.array(at, pa.int64())), *(pa.array(c, pa.int64()) for c in out)], ["img", "pred", "gt", "n"])

    both = a.select("img", "tx", "ty", "data").join(b.select(F.col("img").alias("img"), "tx", "ty", F.col("data").alias("_data")), ["img", "tx", "ty"])
    return both.select("img", "data", "_data").mapInArrow(count, f"img {_sql(a)}, pred long, gt long, n long").groupBy("img", "pred", "gt").agg(F.sum("n").alias("n"))


def _point_requests(points: DataFrame, tiles: DataFrame, before: int, after: int, side: int) -> DataFrame:
    """points (img, id, px, py) with their image's sides, their tile, and the box from before to after around the place."""
    rows = points.select("img", "id", F.col("px").cast("double").alias("px"), F.col("py").cast("double").alias("py")).join(sizes_of(tiles), "img")
    for c, size in (("x", "iw"), ("y", "ih")):
        base = F.floor(F.col(f"p{c}"))
        inside = lambda e, most=size: F.greatest(F.lit(0), F.least(e, F.col(most))).cast("int")
        rows = rows.withColumns({f"{c}0": inside(base - before), f"{c}1": inside(base + after + 1), f"g{c}": F.floor(F.greatest(F.lit(0), F.least(base, F.col(size) - 1)) / side).cast("int")})
    return rows


def at_points(tiles: DataFrame, points: DataFrame, side: int = SIDE, kind: str = "u1") -> DataFrame:
    """(img, id, values): an array of the channels' bilinear values at points (img, id, px, py)."""

    def look(rows: pa.RecordBatch, group: np.ndarray, patches: Patches) -> pa.RecordBatch:
        iw, ih, channels = _ints(rows, "iw", "ih", "n")
        n = int(channels[0])
        px, py = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("px", "py"))
        values = values_in(patches, group, iw, ih, px, py) if patches.values.size else np.zeros((len(px), n))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * n, pa.int32()), pa.array(values.ravel()))
        return pa.RecordBatch.from_arrays([rows.column("img"), rows.column("id"), lists], ["img", "id", "values"])

    requests = _point_requests(points, tiles, 0, 1, side)
    return gathered(tiles, requests, look, f"img {_sql(tiles)}, id {_sql(points, 'id')}, values array<double>", side, kind)


def patches(tiles: DataFrame, points: DataFrame, size: int, side: int = SIDE, kind: str = "u1") -> DataFrame:
    """(img, id, left, top, patch): size x size x channels values around points, moved so that they lie inside the image.

    The patch of a point begins size // 2 before the whole number it rounds down to, or further in at an edge.
    """

    def cut(rows: pa.RecordBatch, group: np.ndarray, patches: Patches) -> pa.RecordBatch:
        place = lambda p, most: np.maximum(0, np.minimum(np.floor(rows.column(p).to_numpy(zero_copy_only=False)) - size // 2, _ints(rows, most)[0] - size)).astype("int64")
        left, top = place("px", "iw"), place("py", "ih")
        begin, x0, y0, wide, high = (a[group] for a in patches[2:])
        # an image smaller than a patch gives what it has
        w, h = (np.clip(a, 0, size) for a in (x0 + wide - left, y0 + high - top))
        made = []
        for first, last in _parts(w * h * patches.n):
            on = slice(first, last)
            at = _blocks((begin + ((top - y0) * wide + left - x0) * patches.n)[on], h[on], w[on] * patches.n, wide[on] * patches.n)
            made.append(_bytes(patches.values[at], (w * h * patches.n)[on]))
        return pa.RecordBatch.from_arrays([rows.column("img"), rows.column("id"), *(pa.array(a.astype("int32")) for a in (left, top)), pa.concat_arrays(made)], ["img", "id", "left", "top", "patch"])

    rows = _point_requests(points, tiles, 0, 0, side)
    for c, most in (("x", "iw"), ("y", "ih")):
        start = F.greatest(F.lit(0), F.least(F.floor(F.col(f"p{c}")) - size // 2, F.col(most) - size)).cast("int")
        rows = rows.withColumn(f"{c}0", start).withColumn(f"{c}1", F.least(F.col(f"{c}0") + size, F.col(most)).cast("int"))
    return gathered(tiles, rows, cut, f"img {_sql(tiles)}, id {_sql(points, 'id')}, left int, top int, patch binary", side, kind)


def crop(tiles: DataFrame, boxes: DataFrame, side: int = SIDE, kind: str = "u1") -> DataFrame:
    """Tiles of the part of each image in its box (img, x0, y0, x1, y1), cut to the image; an empty box gives nothing."""
    low = lambda c, most: F.greatest(F.lit(0), F.least(F.col(c), F.col(most))).cast("int")
    rows = sizes_of(tiles).join(boxes.select("img", *[F.col(c).alias(f"_{c}") for c in _BOX]), "img")
    rows = rows.select("img", "n", *[low(f"_{c}", "iw" if c[0] == "x" else "ih").alias(f"_{c}") for c in _BOX]).where("_x1 > _x0 and _y1 > _y0")
    steps = lambda a, b: F.sequence(F.lit(0), F.floor((F.col(b) - F.col(a) - 1) / side).cast("int"))
    rows = rows.select("*", F.explode(steps("_x0", "_x1")).alias("gx")).select("*", F.explode(steps("_y0", "_y1")).alias("gy"))
    ends = [(F.col(f"_{a}0") + F.col(f"g{a}") * side).alias(f"{a}0") for a in "xy"] + [F.least(F.col(f"_{a}0") + (F.col(f"g{a}") + 1) * side, F.col(f"_{a}1")).alias(f"{a}1") for a in "xy"]
    requests = rows.select("img", "gx", "gy", "n", (F.col("_x1") - F.col("_x0")).alias("w"), (F.col("_y1") - F.col("_y0")).alias("h"), *ends)

    def cut(rows: pa.RecordBatch, group: np.ndarray, patches: Patches) -> pa.RecordBatch:
        size = patches.wide * patches.high * patches.n
        at = _runs(patches.begin[group], size[group])
        return _made_tiles(rows.column("img"), *_ints(rows, "gx", "gy", "w", "h", "n"), _bytes(patches.values[at], size[group]))

    return gathered(tiles, requests, cut, _tile_schema(tiles), side, kind)


def place(tiles: DataFrame, corners: DataFrame, width: int, height: int, side: int = SIDE, kind: str = "u1") -> DataFrame:
    """Tiles of width x height images that hold each image from its corner (img, x0, y0) on, 0 elsewhere."""
    last = lambda n: (n - 1) // side
    rows = sizes_of(tiles).join(corners.select("img", F.col("x0").alias("ox"), F.col("y0").alias("oy")), "img")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(last(height)))).alias("gy")).select("*", F.explode(F.sequence(F.lit(0), F.lit(last(width)))).alias("gx"))
    within = lambda e, most: F.greatest(F.lit(0), F.least(e, F.col(most))).cast("int")
    ends = [within((F.col(f"g{c}") + k) * side - F.col(f"o{c}"), f"i{n}").alias(f"{c}{k}") for c, n in (("x", "w"), ("y", "h")) for k in (0, 1)]
    requests = rows.select("img", "gx", "gy", "iw", "ih", "n", "ox", "oy", *ends)
    return _resampled(tiles, requests, lambda rows, own, x, y: tuple(p - a[own] for p, a in zip((x, y), _ints(rows, "ox", "oy"))), width, height, "nearest", False, side, kind, kind)


def _padded(column: pa.Array) -> np.ndarray:
    """Lists of numbers as rows as long as the longest, 0 after their end."""
    lists = [column.value_lengths().to_numpy(zero_copy_only=False).astype("int64"), column.flatten().to_numpy(zero_copy_only=False)]
    out = np.zeros((len(column), int(lists[0].max(initial=0))))
    out[np.repeat(np.arange(len(column)), lists[0]), _runs(np.zeros(len(column), "int64"), lists[0])] = lists[1]
    return out


def spline_at(rows: pa.RecordBatch, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where thin-plate splines (cx, cy, wx, wy, ax, ay: centres, weights, affine parts of 1, x and y), a row each, take rows of places."""
    cx, cy, wx, wy, ax, ay = (_padded(rows.column(c)) for c in ("cx", "cy", "wx", "wy", "ax", "ay"))
    r2 = (x[..., None] - cx[:, None]) ** 2 + (y[..., None] - cy[:, None]) ** 2
    pull = r2 * np.log(np.where(r2 > 0, r2, 1)) / 2
    return tuple(a[:, :1] + a[:, 1:2] * x + a[:, 2:3] * y + (pull @ w[..., None])[..., 0] for a, w in ((ax, wx), (ay, wy)))


def spline_warp(tiles: DataFrame, splines: DataFrame, width: int, height: int, mode: str = "bilinear", step: int = 8, side: int = SIDE, kind: str = "u1", out: str | None = None) -> DataFrame:
    """Tiles of each image under its spline (img, cx, cy, wx, wy, ax, ay), on width x height places, in the type out (kind).

    The spline says where a place takes its value from. It is computed on every step-th place of a tile and one beyond, and
    what lies between is interpolated; step divides side. The box that a tile needs is that of its grid.
    """
    if side % step:
        raise ValueError("step divides a tile's side")
    grid_side = side // step + 1

    def grid(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """u and v on the grids of the rows' tiles, a row each."""
        y, x = (a.ravel().astype(float) * step for a in np.mgrid[:grid_side, :grid_side])
        gx, gy = _ints(rows, "gx", "gy")
        each = [1 + len(x) * n for n in rows.column("cx").value_lengths().to_pylist()]
        done = [spline_at(rows.slice(a, b - a), x + gx[a:b, None] * side, y + gy[a:b, None] * side) for a, b in _parts(np.array(each))]
        return tuple(map(np.concatenate, zip(*done)))

    names = ("cx", "cy", "wx", "wy", "ax", "ay")
    last = lambda n: (n - 1) // side
    rows = sizes_of(tiles).join(splines.select("img", *[F.col(c).cast("array<double>").alias(c) for c in names]), "img")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(last(height)))).alias("gy")).select("*", F.explode(F.sequence(F.lit(0), F.lit(last(width)))).alias("gx"))

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = {}
            for c, p, most in zip("xy", grid(batch), _ints(batch, "iw", "ih")):
                ends[f"{c}0"] = np.clip(np.floor(p.min(axis=1)) - 1, 0, most)
                ends[f"{c}1"] = np.clip(np.ceil(p.max(axis=1)) + 2, 0, most)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(ends[c].astype("int32")) for c in _BOX)], [*batch.schema.names, *_BOX])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def places(rows: pa.RecordBatch, own: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u, v = ((p - (g * side)[own]) / step for p, g in zip((x, y), _ints(rows, "gx", "gy")))
        bu, bv = (np.minimum(np.floor(p), grid_side - 2).astype("int64") for p in (u, v))
        weigh = lambda a: sum(np.abs(1 - i - (u - bu)) * np.abs(1 - j - (v - bv)) * a[own, (bv + j) * grid_side + bu + i] for i in (0, 1) for j in (0, 1))
        return tuple(map(weigh, grid(rows)))

    requests = rows.mapInArrow(boxes, f"{kinds}, x0 int, y0 int, x1 int, y1 int")
    return _resampled(tiles, requests, places, width, height, mode, False, side, kind, out or kind)
