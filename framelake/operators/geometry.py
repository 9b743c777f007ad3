"""Planar geometry: 3x3 transforms as structs h00..h22, their inverse and decomposition, fits, projections, boxes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.operators.selection import lower_median
from framelake.sources.scratch import materialise

NAMES = tuple(f"h{i}{j}" for i in range(3) for j in range(3))


def entries(prefix: str = "") -> list[list[Column]]:
    return [[F.col(f"{prefix}h{i}{j}") for j in range(3)] for i in range(3)]


def product(a: Sequence[Sequence[Column]], b: Sequence[Sequence[Column]]) -> list[list[Column]]:
    return [[a[i][0] * b[0][j] + a[i][1] * b[1][j] + a[i][2] * b[2][j] for j in range(3)] for i in range(3)]


def inverse(m: Sequence[Sequence[Column]]) -> list[list[Column]]:
    """Cofactors over the determinant; NULL for a singular matrix."""
    cof = lambda i, j: m[(i + 1) % 3][(j + 1) % 3] * m[(i + 2) % 3][(j + 2) % 3] - m[(i + 1) % 3][(j + 2) % 3] * m[(i + 2) % 3][(j + 1) % 3]
    det = m[0][0] * cof(0, 0) + m[0][1] * cof(0, 1) + m[0][2] * cof(0, 2)
    return [[F.try_divide(cof(j, i), det) for j in range(3)] for i in range(3)]


def apply(m: Sequence[Sequence[Column]], x: Column, y: Column, least: float = 1e-8) -> tuple[Column, Column]:
    """A point under a transform; the divisor is at least least."""
    w = F.greatest(m[2][0] * x + m[2][1] * y + m[2][2], F.lit(least))
    return (m[0][0] * x + m[0][1] * y + m[0][2]) / w, (m[1][0] * x + m[1][1] * y + m[1][2]) / w


def decompose(m: Sequence[Sequence[Column]]) -> tuple[Column, Column, Column]:
    """Shear and rotation in degrees and scale (the larger of the largest stretch and the largest shrinkage).

    Where h22 is about 0 the shear is 0 and the scale 1.
    """
    flat = F.abs(m[2][2]) < 1e-8
    d = F.when(flat, F.lit(1.0)).otherwise(m[2][2])
    a, b, c, e = m[0][0] / d, m[0][1] / d, m[1][0] / d, m[1][1] / d
    r00 = F.sqrt(a * a + c * c + 1e-8)
    r01 = (a * b + c * e) / r00
    r11 = F.sqrt(F.greatest(b * b + e * e - r01 * r01, F.lit(1e-8)))
    trace, det = a * a + b * b + c * c + e * e, a * e - b * c
    root = F.sqrt(F.greatest(trace * trace - 4 * det * det, F.lit(0.0)))
    most, least = F.sqrt((trace + root) / 2), F.sqrt(F.greatest((trace - root) / 2, F.lit(1e-16)))
    scale = F.greatest(most, 1 / least)
    shear = F.degrees(F.abs(F.atan(r01 / (r11 + 1e-8))))
    return F.when(flat, 0.0).otherwise(shear), F.degrees(F.atan2(m[1][0], m[0][0])), F.when(flat, 1.0).otherwise(scale)


def needs_reset(shear: Column, rotation: Column, scale: Column, most_shear: float = 15, most_rotation: float = 15, most_scale: float = 2) -> Column:
    return (shear > most_shear) | (F.abs(rotation) > most_rotation) | (scale > most_scale)


def corner_box(m: Sequence[Sequence[Column]], width: int, height: int, canvas_w: int, canvas_h: int) -> Column:
    """struct(x1, y1, x2, y2) of an image's projected corners, clipped to the canvas; the whole canvas if that is empty."""
    at = [apply(m, F.lit(float(x)), F.lit(float(y)), 1e-6) for x in (0, width - 1) for y in (0, height - 1)]
    xs, ys = [p[0] for p in at], [p[1] for p in at]
    clip = lambda v, most: F.greatest(F.lit(0.0), F.least(v, F.lit(float(most)))).cast("bigint")
    x1, y1 = clip(F.floor(F.least(*xs)).cast("double"), canvas_w), clip(F.floor(F.least(*ys)).cast("double"), canvas_h)
    x2, y2 = clip(F.ceil(F.greatest(*xs)).cast("double"), canvas_w), clip(F.ceil(F.greatest(*ys)).cast("double"), canvas_h)
    empty = (x2 <= x1) | (y2 <= y1)
    box = lambda v, other: F.when(empty, F.lit(other).cast("bigint")).otherwise(v)
    return F.struct(box(x1, 0).alias("x1"), box(y1, 0).alias("y1"), box(x2, canvas_w).alias("x2"), box(y2, canvas_h).alias("y2"))


Keys = str | list[str]


def keys_of(key: Keys) -> list[str]:
    return [key] if isinstance(key, str) else key


def point_moments(points: DataFrame, key: Keys, x: str, y: str, w: str) -> DataFrame:
    """(key, cx, cy, dist, scale): weighted centre, mean distance from it, and the scale that makes that sqrt 2."""
    key = keys_of(key)
    total = points.groupBy(*key).agg(F.sum(w).alias("t"), F.sum(F.col(w) * F.col(x)).alias("sx"), F.sum(F.col(w) * F.col(y)).alias("sy"))
    centre = total.select(*key, "t", (F.col("sx") / F.col("t")).alias("cx"), (F.col("sy") / F.col("t")).alias("cy"))
    away = points.join(centre, key).groupBy(*key, "cx", "cy", "t").agg(F.sum(F.col(w) * F.hypot(F.col(x) - F.col("cx"), F.col(y) - F.col("cy"))).alias("d"))
    return away.select(*key, "cx", "cy", (F.col("d") / F.col("t")).alias("dist"), (F.lit(2**0.5) / (F.col("d") / F.col("t") + 1e-8)).alias("scale"))


def normal_sums(points: DataFrame, key: Keys, w: Column) -> DataFrame:
    """(key, n, a00..a77 of the upper triangle, b0..b7): the weighted normal equations of x, y -> u, v in one pass."""
    x, y, u, v, o, z = F.col("x"), F.col("y"), F.col("u"), F.col("v"), F.lit(1.0), F.lit(0.0)
    rows = ([x, y, o, z, z, z, -u * x, -u * y], [z, z, z, x, y, o, -v * x, -v * y])
    a = [F.sum(w * (rows[0][i] * rows[0][j] + rows[1][i] * rows[1][j])).alias(f"a{i}{j}") for i in range(8) for j in range(i, 8)]
    b = [F.sum(w * (rows[0][i] * u + rows[1][i] * v)).alias(f"b{i}") for i in range(8)]
    return points.groupBy(*keys_of(key)).agg(F.count("*").alias("n"), *a, *b)


def solve_homographies(matches: DataFrame, key: Keys, ridge: float = 1e-6, least: int = 4, seed: int = 42) -> DataFrame:
    """(key, h00..h22) from matches (key, x, y, u, v, w); NULL with fewer than least matches or without a solution.

    Points are first moved and scaled on both sides; sums are taken by Spark, a task only solves 8x8 systems. Keys whose
    sums give no finite solution are tried again on samples of their matches (sampled_homographies).
    """
    key = keys_of(key)
    rows = matches.where("w > 0")
    p = point_moments(rows, key, "x", "y", "w").select(*key, F.col("cx").alias("px"), F.col("cy").alias("py"), F.col("scale").alias("ps"))
    q = point_moments(rows, key, "u", "v", "w").select(*key, F.col("cx").alias("qx"), F.col("cy").alias("qy"), F.col("scale").alias("qs"))
    total = rows.groupBy(*key).agg(F.sum("w").alias("total"))
    sides = p.join(q, key).join(total, key)
    at = lambda c, mid, s: ((F.col(c) - F.col(mid)) * F.col(s)).alias(c)
    scaled = rows.join(sides, key).select(*key, at("x", "px", "ps"), at("y", "py", "ps"), at("u", "qx", "qs"), at("v", "qy", "qs"), (F.col("w") / (F.col("total") + 1e-8)).alias("w"))
    sums = normal_sums(scaled, key, F.col("w")).join(sides, key)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                a = np.zeros((8, 8))
                for i in range(8):
                    for j in range(i, 8):
                        a[i, j] = a[j, i] = r[f"a{i}{j}"]
                h = None
                if r["n"] >= least:
                    try:
                        m = np.append(np.linalg.solve(a + ridge * np.eye(8), [r[f"b{i}"] for i in range(8)]), 1).reshape(3, 3)
                        to = np.array([[r["ps"], 0, -r["ps"] * r["px"]], [0, r["ps"], -r["ps"] * r["py"]], [0, 0, 1]])
                        back = np.array([[1 / r["qs"], 0, r["qx"]], [0, 1 / r["qs"], r["qy"]], [0, 0, 1]])
                        m = back @ m @ to
                        h = m / m[2, 2] if np.isfinite(m).all() and abs(m[2, 2]) > 1e-12 else None
                    except np.linalg.LinAlgError:
                        h = None
                out.append([*(r[k] for k in key), r["n"], *(h.ravel() if h is not None else [None] * 9)])
            yield pd.DataFrame(out, columns=[*key, "n", *NAMES])

    kinds = ", ".join(f"`{k}` {matches.schema[k].dataType.simpleString()}" for k in key)
    fitted = sums.mapInPandas(solve, f"{kinds}, n long, " + ", ".join(f"{n} double" for n in NAMES))
    failed = fitted.where(F.col("h00").isNull() & (F.col("n") >= least)).select(*key)
    again = sampled_homographies(rows.join(failed, key, "left_semi"), key, seed).select(*key, *[F.col(n).alias(f"s{n}") for n in NAMES])
    return fitted.join(again, key, "left").select(*key, *[F.coalesce(n, f"s{n}").alias(n) for n in NAMES])


def exact_homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    """The transform of four points or more, by least squares; None if there is no finite one."""
    x, y, u, v = *src.T, *dst.T
    o, z = np.ones_like(x), np.zeros_like(x)
    a = np.concatenate((np.stack((x, y, o, z, z, z, -u * x, -u * y), 1), np.stack((z, z, z, x, y, o, -v * x, -v * y), 1)))
    h, _, rank, _ = np.linalg.lstsq(a, np.concatenate((u, v)), rcond=None)
    return np.append(h, 1).reshape(3, 3) if rank == 8 and np.isfinite(h).all() else None


def sampled_homographies(matches: DataFrame, key: Keys, seed: int = 42, rounds: int = 100, within: float = 2.0, sure: float = 0.95) -> DataFrame:
    """(key, h00..h22) from seeded samples of four matches: the one with most matches within so many pixels, fitted to these.

    Ends before rounds where a sample without an outlier has been drawn with the probability sure. A key is a frame,
    whose matches are a few thousand at most; NULL where no sample has a solution.
    """
    key = keys_of(key)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "y", "u", "v"])
        src, dst, draw = pdf[["x", "y"]].to_numpy(float), pdf[["u", "v"]].to_numpy(float), np.random.default_rng(seed)
        best, ok, left, at = None, np.zeros(len(src), bool), rounds, 0
        while at < left and len(src) >= 4:
            at += 1
            some = draw.choice(len(src), 4, replace=False)
            if (h := exact_homography(src[some], dst[some])) is None:
                continue
            to = np.c_[src, np.ones(len(src))] @ h.T
            with np.errstate(divide="ignore", invalid="ignore"):
                near = np.hypot(*(to[:, :2] / to[:, 2:] - dst).T) <= within
            if best is None or near.sum() > ok.sum():
                best, ok = h, near
                share = ok.mean() ** 4
                left = min(left, rounds if share <= 0 else 1 if share >= 1 else int(np.ceil(np.log(1 - sure) / np.log(1 - share))))
        if ok.sum() > 4 and (h := exact_homography(src[ok], dst[ok])) is not None:
            best = h
        return pd.DataFrame([[*(pdf[k].iat[0] for k in key), *(best.ravel() if best is not None else [None] * 9)]], columns=[*key, *NAMES])

    kinds = ", ".join(f"`{k}` {matches.schema[k].dataType.simpleString()}" for k in key)
    return matches.groupBy(*key).applyInPandas(run, f"{kinds}, " + ", ".join(f"{n} double" for n in NAMES))


def fit_spline(src: np.ndarray, dst: np.ndarray, ridge: float = 1e-6) -> np.ndarray | None:
    """Thin-plate spline weights (n + 3, 2) that take src to dst; None with fewer than ten points or no finite solution."""
    if len(src) < 10:
        return None
    r2 = ((src[:, None] - src[None]) ** 2).sum(axis=2)
    k = r2 * np.log(np.where(r2 > 0, r2, 1)) / 2 + ridge * np.eye(len(src))
    p = np.hstack((np.ones((len(src), 1)), src))
    full = np.block([[k, p], [p.T, np.zeros((3, 3))]])
    try:
        w = np.linalg.solve(full, np.vstack((dst, np.zeros((3, 2)))))
    except np.linalg.LinAlgError:
        return None
    return w if np.isfinite(w).all() else None


def apply_spline(w: np.ndarray, src: np.ndarray, at: np.ndarray) -> np.ndarray:
    r2 = ((at[:, None] - src[None]) ** 2).sum(axis=2)
    return (r2 * np.log(np.where(r2 > 0, r2, 1)) / 2) @ w[:-3] + np.hstack((np.ones((len(at), 1)), at)) @ w[-3:]


#: Share of a key's largest coordinate up to which its matches count as moved by a straight map.
STRAIGHT = 1e-9


def splines(matches: DataFrame, key: str, places: Sequence[tuple[float, float]]) -> DataFrame:
    """(key, x, y, u, v): where each key's thin-plate spline takes the places; u, v NULL without a fit.

    Where a straight map takes all of a key's matches to their places, within STRAIGHT, that map is the spline: no weight
    but its affine part is needed, and the system has no other solution. Two aggregations find it, so such a key may have
    any number of matches. The matches of other keys, a frame's few thousand, are solved in one task, whose memory grows
    with their square.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        src, dst, at = pdf[["x", "y"]].to_numpy(float), pdf[["u", "v"]].to_numpy(float), np.array(places, float)
        w = fit_spline(src, dst)
        uv = apply_spline(w, src, at) if w is not None else np.full((len(at), 2), np.nan)
        out = pd.DataFrame({key: pdf[key].iat[0], "x": at[:, 0], "y": at[:, 1], "u": uv[:, 0], "v": uv[:, 1]})
        return out.astype(object).where(out.notna(), None) if w is None else out

    kind = matches.schema[key].dataType.simpleString()
    made = f"{key} {kind}, x double, y double, u double, v double"
    rows = matches.select(F.col(key).alias(key), *[F.col(c).cast("double").alias(c) for c in "xyuv"])
    fits = materialise(_straight_maps(rows, key), "straight")  # a row a key
    same = lambda a, b: a[key].eqNullSafe(b[key])
    curved = rows.join(fits.select(key), same(rows, fits), "left_anti").groupBy(key).applyInPandas(run, made)
    at = F.explode(F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in places])).alias("at")
    led = lambda c: F.col(f"m{c}") + F.col(f"{c}x") * (F.col("at.x") - F.col("mx")) + F.col(f"{c}y") * (F.col("at.y") - F.col("my"))
    straight = fits.select("*", at).select(key, "at.x", "at.y", led("u").alias("u"), led("v").alias("v"))
    return curved.unionByName(straight)


def _straight_maps(rows: DataFrame, key: str) -> DataFrame:
    """(key, mx, my, mu, mv, ux, uy, vx, vy): the means and slopes of keys of ten or more matches that a straight map moves."""
    whole = F.bool_and(sum((F.coalesce(F.abs(c), F.lit(float("nan"))) for c in "xyuv"), F.lit(0.0)) < float("inf"))
    sums = [F.covar_pop(a, b).alias(f"{a}{b}") for a, b in ("xx", "xy", "yy", "xu", "yu", "xv", "yv")]
    by = rows.groupBy(key).agg(F.count("*").alias("n"), whole.alias("whole"), *[F.avg(c).alias(f"m{c}") for c in "xyuv"], *sums)
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    by = by.where("n >= 10 and whole").where(det > 1e-12 * F.col("xx") * F.col("yy"))  # not all on one line
    slopes = [e.alias(c + a) for c in "uv" for a, e in (("x", (F.col(f"x{c}") * F.col("yy") - F.col(f"y{c}") * F.col("xy")) / det), ("y", (F.col(f"y{c}") * F.col("xx") - F.col(f"x{c}") * F.col("xy")) / det))]
    fits = by.select(key, *[f"m{c}" for c in "xyuv"], *slopes)
    named = fits.withColumnRenamed(key, "_key")
    away = [F.abs(F.col(c) - (F.col(f"m{c}") + F.col(f"{c}x") * (F.col("x") - F.col("mx")) + F.col(f"{c}y") * (F.col("y") - F.col("my")))) for c in "uv"]
    off = rows.join(named, rows[key].eqNullSafe(named["_key"])).groupBy(key).agg(F.max(F.greatest(*away)).alias("off"), F.max(F.greatest(*[F.abs(c) for c in "xyuv"])).alias("most"))
    held = off.where(F.col("off") <= STRAIGHT * F.col("most")).select(F.col(key).alias("_key"))
    return fits.join(held, fits[key].eqNullSafe(held["_key"])).drop("_key")


def canvas_of(width: Column, height: Column, scale_x: int = 3, scale_y: int = 3) -> Column:
    """struct(cw, ch, ox, oy): a canvas some times as large as the frame, and the offset that centres the frame in it."""
    cw, ch = width * scale_x, height * scale_y
    half = lambda a, b: F.floor((a - b) / 2).cast("bigint")
    return F.struct(cw.cast("bigint").alias("cw"), ch.cast("bigint").alias("ch"), half(cw, width).alias("ox"), half(ch, height).alias("oy"))


def to_canvas(m: Sequence[Sequence[Column]], offset_x: Column, offset_y: Column, scale: Column, scale_first: bool = True) -> list[list[Column]]:
    """A frame's transform m into its canvas: scaled and then moved by the offset, or moved first, so that the offset grows too."""
    one, no = F.lit(1.0), F.lit(0.0)
    grow, move = [[scale, no, no], [no, scale, no], [no, no, one]], [[one, no, offset_x], [no, one, offset_y], [no, no, one]]
    return product(move, product(grow, m)) if scale_first else product(grow, product(move, m))


def crop_box(mode: Column, valid: Column, original: Column, canvas_w: Column, canvas_h: Column) -> Column:
    """The crop of a mode: external the valid region, original the projected frame, entire the canvas; else internal = valid."""
    whole = F.struct(F.lit(0).cast("bigint").alias("x1"), F.lit(0).cast("bigint").alias("y1"), canvas_w.cast("bigint").alias("x2"), canvas_h.cast("bigint").alias("y2"))
    return F.when(mode == "entire", whole).when(mode == "original", original).otherwise(valid)


def to_frame(x: Column, y: Column, box_x: Column, box_y: Column, inv: Sequence[Sequence[Column]], roi_x: Column, roi_y: Column) -> tuple[Column, Column]:
    """A point of a crop in its frame: crop to canvas by the box's corner, canvas to frame by the inverse, plus the ROI."""
    u, v = apply(inv, x + box_x, y + box_y)
    return u + roi_x, v + roi_y


def box_to_frame(x1: Column, y1: Column, x2: Column, y2: Column, inv: Sequence[Sequence[Column]]) -> Column:
    """struct(x, y, w, h), cut to whole numbers, of a box's four corners under the inverse."""
    at = [apply(inv, x, y) for x in (x1, x2) for y in (y1, y2)]
    xs, ys = [p[0] for p in at], [p[1] for p in at]
    cut = lambda c: F.signum(c).cast("bigint") * F.floor(F.abs(c)).cast("bigint")
    return F.struct(cut(F.least(*xs)).alias("x"), cut(F.least(*ys)).alias("y"), cut(F.greatest(*xs) - F.least(*xs)).alias("w"), cut(F.greatest(*ys) - F.least(*ys)).alias("h"))


def unit_transform(m: Sequence[Sequence[Column]], src_w: int, src_h: int, dst_w: int, dst_h: int) -> list[list[Column]]:
    """A pixel transform between coordinates that run from -1 to 1 over each image."""
    f = lambda x: F.lit(float(x))
    to = [[f(2 / (dst_w - 1)), f(0), f(-1)], [f(0), f(2 / (dst_h - 1)), f(-1)], [f(0), f(0), f(1)]]
    back = [[f((src_w - 1) / 2), f(0), f((src_w - 1) / 2)], [f(0), f((src_h - 1) / 2), f((src_h - 1) / 2)], [f(0), f(0), f(1)]]
    return product(to, product(m, back))


def camera_shift(flow: DataFrame, key: str, least_share: float = 0.3) -> DataFrame:
    """(key, sx, sy): lower medians of the valid flow (dx, dy, valid); 0 where too few vectors are valid."""
    valid = flow.where("valid")
    by = flow.groupBy(key).agg(F.avg(F.col("valid").cast("int")).alias("share"))
    for c, name in (("dx", "sx"), ("dy", "sy")):
        by = by.join(lower_median(valid, c, key, name=name), key, "left")
    ok = F.col("share") >= least_share
    return by.select(key, F.when(ok, F.col("sx")).otherwise(0.0).alias("sx"), F.when(ok, F.col("sy")).otherwise(0.0).alias("sy"))
