"""Pasting a frame into a canvas with a feathered edge, on arrays of one frame and its part of the canvas.

A frame's own pixels are those that its occlusion mask leaves; the base canvas also loses a rim of TRIM pixels. What the
transform brings to a canvas place that is painted already counts with a weight that grows from the edge of the pasted
region inwards: one less the ramp of what isn't pasted. The ramp is made on a reduced grid of means of REDUCED x REDUCED
places, those over LEAST counting as set, by accumulated dilations, and brought back to full size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from framelake.operators import images, raster

#: Rim of the base canvas, length of the ramp in pixels, its grid, and the mean over which a place of it is set.
TRIM, RADIUS, REDUCED, LEAST = 12, 201, 4, 0.3


def reduced(mask: np.ndarray, by: int = REDUCED, least: float = LEAST) -> np.ndarray:
    """Which blocks of by x by places have a mean over least; places beyond the last whole block don't count."""
    h, w = (n // by for n in mask.shape)
    return mask[: h * by, : w * by].reshape(h, by, w, by).mean(axis=(1, 3)) > least


def enlarged(grid: np.ndarray, shape: tuple[int, int], origin: tuple[int, int] = (0, 0), by: int = 1, whole: tuple[int, int] | None = None) -> np.ndarray:
    """grid brought to shape by bilinear weights between the middles of its places; its edge goes on outside.

    With whole, grid is the part from origin / by on of what an image of that shape is reduced to.
    """
    for axis, n in enumerate(shape):
        own = grid.shape[axis]
        old, new, start = (own, n, 0) if whole is None else (whole[axis] // by, whole[axis], origin[axis])
        at = np.clip((np.arange(n) + start + 0.5) * old / new - 0.5, 0, old - 1) - start // by
        at = np.clip(at, 0, own - 1)
        low = np.floor(at).astype(int)
        share = (at - low).reshape([-1 if a == axis else 1 for a in (0, 1)])
        grid = np.take(grid, low, axis) * (1 - share) + np.take(grid, np.minimum(low + 1, own - 1), axis) * share
    return grid


def ramp(mask: np.ndarray, radius: int = RADIUS, by: int = REDUCED, origin: tuple[int, int] = (0, 0), whole: tuple[int, int] | None = None) -> np.ndarray:
    """1 where mask is set and next to it, falling to 0 over radius pixels: the mean of radius / by dilations on the grid.

    mask may be the part of a whole image from origin on, if that is a multiple of by and nothing beyond matters.
    """
    grid, steps = reduced(mask, by), max(1, radius // by)
    if not grid.size:
        return np.zeros(mask.shape)
    d = images.square_distance(grid, steps)
    accumulated = np.where(np.isnan(d), 0.0, steps - np.maximum(d, 1) + 1) / steps
    return np.clip(enlarged(accumulated, mask.shape, origin, by, whole), 0, 1)


def weight(region: np.ndarray, radius: int = RADIUS, by: int = REDUCED, origin: tuple[int, int] = (0, 0), whole: tuple[int, int] | None = None) -> np.ndarray:
    """How much of the pasted frame counts at each place: 0 outside region, growing inwards from its edge."""
    return np.clip((1 - ramp(~region, radius, by, origin, whole)) * region, 0, 1)


def trimmed(shape: tuple[int, int], trim: int = TRIM) -> np.ndarray:
    """The places of a frame but for a rim of trim."""
    out = np.zeros(shape, bool)
    out[trim : max(trim, shape[0] - trim), trim : max(trim, shape[1] - trim)] = True
    return out


def regions(occluded: np.ndarray, m: np.ndarray, width: int, height: int, trim: int = TRIM) -> tuple[np.ndarray, np.ndarray] | None:
    """Which canvas places the frame under m covers, without its rim and with it, nowhere occluded; None for a singular m."""
    own = np.stack((trimmed(occluded.shape, trim) & ~occluded, ~occluded, occluded)).astype(float)
    there = [raster.warped(a, m, width, height) for a in own]
    if there[0] is None:
        return None
    clear = there[2] <= 0.5
    return (there[0] > 0.5) & clear, (there[1] > 0.5) & clear


def feathered(values: np.ndarray, painted: np.ndarray, new: np.ndarray, region: np.ndarray, alpha: np.ndarray | float) -> np.ndarray:
    """values with new in region: all of it where nothing is painted; if any of region is painted, alpha of it everywhere."""
    base = np.where(region & ~painted, new, values)
    if not (region & painted).any():
        return base
    return np.where(region, base * (1 - alpha) + new * alpha, base)


def feathered_cells(cells: DataFrame, radius: int = RADIUS, by: int = REDUCED) -> DataFrame:
    """cells (img, x, y, canvas, painted, new, region) with alpha, the pasted image's weight, and v, the canvas after the paste.

    An image's cells are all places of its canvas.
    """

    def run(p: images.Planes, there: np.ndarray) -> images.Planes:  # noqa: ARG001
        region, painted = p["region"].astype(bool), p["painted"].astype(bool)
        alpha = weight(region, radius, by)
        return {"alpha": alpha, "v": feathered(p["canvas"].astype(float), painted, p["new"].astype(float), region, alpha)}

    return images.by_image(cells, ["canvas", "painted", "new", "region"], run, "alpha double, v double")


def pasted(values: np.ndarray, painted: np.ndarray, new: np.ndarray, base_region: np.ndarray, frame_region: np.ndarray, blurred: bool, alpha: np.ndarray | float, empty: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(base, its painted places, the frame's own canvas, its painted places) after a frame.

    The base canvas is feathered by alpha; a blurred frame leaves it as it is. The frame's own canvas shows the frame
    wherever it covers it, but where it is blurred or covers nothing painted it only gains what is new. A sharp frame on an
    empty canvas makes both alike.
    """
    base, known = values, painted
    if not blurred:
        base, known = feathered(values, painted, new, base_region, alpha), painted | base_region
    if empty and not blurred:
        return base, known, base, known
    shown = frame_region if (base_region & painted).any() and not blurred else frame_region & ~painted
    return base, known, np.where(shown, new, values), painted | frame_region
