"""Neighbourhood operators: Spark deals the cells of a table (img, x, y, ...) by image, a task works on an image's planes.

An image is a frame, so a task holds a few planes of some hundred thousand cells and never more than one image. Cells are
moved once, whatever the radius or the number of passes. Cells that lack are holes: they take no part, and get no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Planes = Mapping[str, np.ndarray]
#: Cells of an image's bounding box for each cell that it has, beyond a first million, before it counts as no image.
SPARSE = 64


def by_image(cells: DataFrame, values: Sequence[str], f: Callable[[Planes, np.ndarray], Planes], made: str) -> DataFrame:
    """cells with the columns made, a schema string: f gets planes of values and which places have cells, and gives planes.

    Where a place has no cell, a value is 0.
    """
    names = [c.split(" ")[0] for c in made.split(", ")]

    def run(rows: pa.Table) -> pa.Table:
        x, y = (rows[c].to_numpy().astype("int64") for c in ("x", "y"))
        x, y = x - x.min(), y - y.min()
        shape = (int(y.max()) + 1, int(x.max()) + 1)
        if shape[0] * shape[1] > (1 << 20) + SPARSE * len(x):
            raise ValueError(f"{len(x)} cells spread over {shape[1]} x {shape[0]} places are no image")
        there = np.zeros(shape, bool)
        there[y, x] = True
        planes = {}
        for c in values:
            own = rows[c].to_numpy()
            planes[c] = np.zeros(shape, own.dtype)
            planes[c][y, x] = own
        out = f(planes, there)
        for n in names:
            rows = rows.append_column(n, pa.array(out[n][y, x], from_pandas=True))
        return rows

    own = ", ".join(f"`{f_.name}` {f_.dataType.simpleString()}" for f_ in cells.schema)
    return cells.groupBy("img").applyInArrow(run, f"{own}, {made}")


def spread(a: np.ndarray, radius: int, f: np.ufunc = np.maximum) -> np.ndarray:
    """f over the square of radius around each place: along the rows, then along the columns."""
    for axis in (1, 0):
        a = np.moveaxis(a, axis, 0)
        out = a.copy()
        for d in range(1, min(radius, len(a) - 1) + 1):
            out[d:] = f(out[d:], a[:-d])
            out[:-d] = f(out[:-d], a[d:])
        a = np.moveaxis(out, 0, axis)
    return a


def shifted(a: np.ndarray, dx: int, dy: int) -> np.ndarray:
    """The plane of each place's neighbour at (dx, dy), zero outside."""
    out = np.zeros_like(a)
    h, w = a.shape
    if abs(dx) < w and abs(dy) < h:
        out[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = a[max(0, dy) : h - max(0, -dy), max(0, dx) : w - max(0, -dx)]
    return out


def maxima(s: np.ndarray, there: np.ndarray, radius: int) -> np.ndarray:
    """Places whose value is the largest within radius; ties all count."""
    s = np.where(there, s.astype(float), -np.inf)
    return there & (s == spread(s, radius))


def kept_maxima(s: np.ndarray, there: np.ndarray, radius: int, recoveries: int) -> np.ndarray:
    """Maxima, and then those that are maxima once the kept ones' surroundings count as 0."""
    kept = maxima(s, there, radius)
    for _ in range(recoveries):
        near = spread(kept, radius, np.logical_or)
        left = np.where(near, 0.0, s.astype(float))
        kept = kept | (there & ~near & maxima(left, there, radius))
    return kept


def centres_of_mass(s: np.ndarray, there: np.ndarray, radius: int, temperature: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of the softmax's centre within radius, and its mean squared distance from there."""
    top = spread(np.where(there, s.astype(float), -np.inf), radius)
    total, ox, oy, far = (np.zeros(s.shape) for _ in range(4))
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            with np.errstate(invalid="ignore", over="ignore"):
                w = np.where(shifted(there, dx, dy), np.exp((shifted(s.astype(float), dx, dy) - top) / temperature), 0.0)
            total += w
            ox += w * dx
            oy += w * dy
            far += w * (dx * dx + dy * dy)
    with np.errstate(invalid="ignore", over="ignore"):
        ox, oy = ox / total, oy / total
        return ox, oy, np.maximum(far / total - ox * ox - oy * oy, 0.0)


def laplacian(v: np.ndarray) -> np.ndarray:
    """The 4-neighbour Laplacian, places outside counting as zero."""
    v = v.astype(float)
    return sum(shifted(v, dx, dy) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))) - 4 * v


def square_distance(seeds: np.ndarray, most: int) -> np.ndarray:
    """Chebyshev distance to the nearest seed, NaN beyond most."""
    out, reached = np.where(seeds, 0.0, np.nan), seeds
    for d in range(1, most + 1):
        if reached.all() or not reached.any():
            break
        reached, before = spread(reached, 1, np.logical_or), reached
        out[reached & ~before] = d
    return out


def plain_distance(ground: np.ndarray) -> np.ndarray:
    """Exact Euclidean distance to the nearest place of ground, infinite if there is none.

    First along the columns, then each row as the lower envelope of the parabolas that its places stand for: the time is in
    proportion to the places. All rows go over their columns together.
    """
    h, w = ground.shape
    rows = np.arange(h)[:, None]
    above = np.maximum.accumulate(np.where(ground, rows, -np.inf), axis=0)
    below = np.minimum.accumulate(np.where(ground, rows, np.inf)[::-1], axis=0)[::-1]
    tall = np.minimum(rows - above, below - rows) ** 2
    apex, begin, top = np.zeros((h, w), "int64"), np.full((h, w + 1), np.inf), np.full(h, -1)
    for q in range(w):
        left, start = np.flatnonzero(np.isfinite(tall[:, q])), np.full(h, -np.inf)
        added = left
        while len(left := left[top[left] >= 0]):  # parabolas that the new one hides come off
            p = apex[left, top[left]]
            cross = ((tall[left, q] + q * q) - (tall[left, p] + p * p)) / (2.0 * (q - p))
            hidden = cross <= begin[left, top[left]]
            start[left[~hidden]] = cross[~hidden]
            left = left[hidden]
            top[left] -= 1
        top[added] += 1
        apex[added, top[added]], begin[added, top[added]] = q, start[added]
        begin[added, top[added] + 1] = np.inf
    out, at, some = np.full((h, w), np.inf), np.zeros(h, "int64"), np.flatnonzero(top >= 0)
    for q in range(w):
        left = some
        while len(left := left[begin[left, at[left] + 1] < q]):
            at[left] += 1
        p = apex[some, at[some]]
        out[some, q] = (q - p) ** 2 + tall[some, p]
    return np.sqrt(out)


def first_cells(there: np.ndarray) -> np.ndarray:
    """For each place the number of the first place, row by row, that it reaches over 8 neighbours."""
    label = np.where(there, np.arange(there.size).reshape(there.shape), there.size)
    while True:
        near = np.where(there, spread(label, 1, np.minimum), there.size)
        up = np.arange(there.size + 1)
        np.minimum.at(up, label.ravel(), near.ravel())
        while (up[up] != up).any():
            up = up[up]
        new = up[label]
        if (new == label).all():
            return label
        label = new


def membrane(canvas: np.ndarray, patch: np.ndarray, mask: np.ndarray, rounds: int = 50) -> np.ndarray:
    """patch in canvas where mask is set, with its edge's difference to canvas spread inwards by Jacobi steps: no seam shows."""
    mask = mask.astype(bool)
    around = ((1, 0), (-1, 0), (0, 1), (0, -1))
    inner = mask & np.logical_and.reduce([shifted(mask, dx, dy) for dx, dy in around])
    diff = np.where(mask & ~inner, canvas.astype(float) - patch, 0.0)
    for _ in range(rounds):
        diff = np.where(inner, sum(shifted(diff, dx, dy) for dx, dy in around) / 4, diff)
    return np.where(mask, patch + diff, canvas)


def _circle(points: list[tuple[float, float]]) -> tuple[float, float, float] | None:
    """The circle through two points, as its diameter, or three; None for three in a line."""
    (ax, ay), (bx, by), *rest = points
    if not rest:
        return (ax + bx) / 2, (ay + by) / 2, float(np.hypot(ax - bx, ay - by)) / 2
    (cx, cy) = rest[0]
    d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
    if abs(d) < 1e-9:
        return None
    a, b, c = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
    x, y = (a * (by - cy) + b * (cy - ay) + c * (ay - by)) / d, (a * (cx - bx) + b * (ax - cx) + c * (bx - ax)) / d
    return x, y, float(np.hypot(ax - x, ay - y))


def enclosing_circle(there: np.ndarray) -> tuple[float, float, float]:
    """Centre and radius of the smallest circle around all set places, by adding points one after the other."""
    ys = np.flatnonzero(there.any(axis=1))
    left, right = there[ys].argmax(axis=1), there.shape[1] - 1 - there[ys][:, ::-1].argmax(axis=1)
    points = [(float(x), float(y)) for x, y in dict.fromkeys((*zip(left, ys), *zip(right, ys)))]
    points = [points[i] for i in np.random.default_rng(1).permutation(len(points))]
    out = lambda p, c: np.hypot(p[0] - c[0], p[1] - c[1]) > c[2] + 1e-9
    best = (*points[0], 0.0)
    for i, p in enumerate(points):
        if out(p, best):
            best = (*p, 0.0)
            for j, q in enumerate(points[:i]):
                if out(q, best):
                    best = _circle([p, q])
                    for r in points[:j]:
                        if out(r, best) and (c := _circle([p, q, r])):
                            best = c
    return best


def scope(v: np.ndarray, there: np.ndarray, least: int, radius: int) -> tuple[float, float, float] | None:
    """The circle around the largest lit set, after opening and closing by a square; None if nothing is lit."""
    lit = there & (v > least)
    smaller = lambda a: ~spread(~a, radius, np.logical_or)
    larger = lambda a: spread(a, radius, np.logical_or)
    lit = smaller(larger(larger(smaller(lit))))
    if not lit.any():
        return None
    label = first_cells(lit)
    numbers, sizes = np.unique(label[lit], return_counts=True)
    return enclosing_circle(label == numbers[sizes.argmax()])


#: The five taps of the pyramids' Gaussian.
TAPS = (1 / 16, 4 / 16, 6 / 16, 4 / 16, 1 / 16)


def _blurred(image: np.ndarray) -> np.ndarray:
    """The five taps along rows and columns, the image mirrored at its edges without them twice."""
    for axis in (0, 1):
        n = image.shape[axis]
        at = np.arange(-2, n + 2)
        at = np.abs(at) if n > 1 else np.zeros_like(at)
        at = np.where(at >= n, 2 * (n - 1) - at, at).clip(0, n - 1)
        padded = np.take(image, at, axis)
        image = sum(t * np.take(padded, np.arange(k, k + n), axis) for k, t in enumerate(TAPS))
    return image


def resampled(image: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """image on shape places by bilinear weights between the middles of its places; its edge goes on outside."""
    for axis, n in enumerate(shape):
        old = image.shape[axis]
        at = np.clip((np.arange(n) + 0.5) * old / n - 0.5, 0, old - 1)
        low = np.floor(at).astype(int)
        share = (at - low).reshape([-1 if a == axis else 1 for a in (0, 1)])
        image = np.take(image, low, axis) * (1 - share) + np.take(image, np.minimum(low + 1, old - 1), axis) * share
    return image


def halved(image: np.ndarray) -> np.ndarray:
    """An image blurred, on half as many places along each side."""
    return resampled(_blurred(image.astype(float)), tuple(max(1, n // 2) for n in image.shape))


def doubled(image: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """An image on twice as many places along each side, blurred, and brought to shape by nearest places where that differs."""
    out = _blurred(resampled(image, tuple(2 * n for n in image.shape)))
    for axis, n in enumerate(shape):
        if out.shape[axis] != n:
            out = np.take(out, np.arange(n) * out.shape[axis] // n, axis)
    return out


def gaussian_pyramid(image: np.ndarray, levels: int) -> list[np.ndarray]:
    out = [image.astype(float)]
    for _ in range(levels - 1):
        out.append(halved(out[-1]))
    return out


def laplacian_pyramid(image: np.ndarray, levels: int) -> list[np.ndarray]:
    """What each level of the Gaussian pyramid lacks of the one before, and its coarsest level."""
    levels_ = gaussian_pyramid(image, levels)
    return [fine - doubled(coarse, fine.shape) for fine, coarse in zip(levels_, levels_[1:])] + levels_[-1:]


def collapsed(bands: list[np.ndarray]) -> np.ndarray:
    """The image of a Laplacian pyramid."""
    out = bands[-1]
    for band in reversed(bands[:-1]):
        out = band + doubled(out, band.shape)
    return out


def multiband(canvas: np.ndarray, patch: np.ndarray, mask: np.ndarray, levels: int) -> np.ndarray:
    """patch in canvas where mask, from 0 to 1, says so, each band of both blended under the mask of its level."""
    bands = zip(laplacian_pyramid(canvas, levels), laplacian_pyramid(patch, levels), gaussian_pyramid(mask, levels))
    return collapsed([c * (1 - m) + p * m for c, p, m in bands])
