"""The contract of models that stay outside the engine, with deterministic stubs.

A segmentation model is a function of (n, h, w) gray images that gives (n, h, w) classes; an extractor gives a frame's
keypoints as rows. Weights are loaded once in each worker by the loader that is passed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Model = Callable[[np.ndarray], np.ndarray]


@lru_cache(maxsize=4)
def _loaded(loader: Callable[[], Model]) -> Model:
    return loader()


def stub_segmenter() -> Model:
    """Classes by brightness: 0 below 64, then one more each 64."""
    return lambda images: (images // 64).astype("u1")


def segment(images: DataFrame, loader: Callable[[], Model] = stub_segmenter) -> DataFrame:
    """images (img, h, w, pixels) with classes: what the model gives for each, a byte a pixel."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _loaded(loader)
        for pdf in batches:
            out = [model(np.frombuffer(p, "u1").reshape(1, h, w))[0].astype("u1").tobytes() for p, h, w in zip(pdf["pixels"], pdf["h"], pdf["w"])]
            yield pd.DataFrame({"img": pdf["img"], "h": pdf["h"], "w": pdf["w"], "classes": out})

    return images.mapInPandas(run, f"img {images.schema['img'].dataType.simpleString()}, h int, w int, classes binary")


def segment_resized(images: DataFrame, loader: Callable[[], Model] = stub_segmenter, side: int | None = None, multiple: int = 32) -> DataFrame:
    """segment() by a model that wants square images of side, or sides that multiple divides; classes at the images' own size.

    Images are brought to that size, and classes back, by the nearest place whose share of the side is as large.
    """

    def adapted() -> Model:
        model = loader()

        def run(batch: np.ndarray) -> np.ndarray:
            h, w = batch.shape[1:]
            new_h, new_w = (side, side) if side else (-(-h // multiple) * multiple, -(-w // multiple) * multiple)
            at = lambda n, of: np.arange(n) * of // n
            classes = model(batch[:, at(new_h, h)[:, None], at(new_w, w)])
            return classes[:, at(h, new_h)[:, None], at(w, new_w)]

        return run

    return segment(images, adapted)


def stub_flow() -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The whole-pixel move, of up to two pixels a side, that makes the frame before most like this one."""

    def run(now: np.ndarray, before: np.ndarray) -> np.ndarray:
        tries = [(dx, dy) for dy in range(-2, 3) for dx in range(-2, 3)]
        cost = [np.abs(np.roll(before.astype(float), (-dy, -dx), (0, 1)) - now)[2:-2, 2:-2].sum() for dx, dy in tries]
        dx, dy = tries[int(np.argmin(cost))]
        return np.stack((np.full(now.shape, dx, "f4"), np.full(now.shape, dy, "f4")))

    return run


def flow(pairs: DataFrame, loader: Callable = stub_flow, multiple: int = 8) -> DataFrame:
    """(img, h, w, dx, dy) of pairs (img, h, w, pixels, before): the flow from each frame to the one before, 4 bytes a pixel.

    The model sees images whose edges are repeated so that multiple divides their sides.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _loaded(loader)
        for pdf in batches:
            out = []
            for p, q, h, w in zip(pdf["pixels"], pdf["before"], pdf["h"], pdf["w"]):
                edges = [((-n % multiple) // 2, -n % multiple - (-n % multiple) // 2) for n in (h, w)]
                both = [np.pad(np.frombuffer(x, "u1").reshape(h, w), edges, mode="edge") for x in (p, q)]
                out.append(model(*both)[:, edges[0][0] : edges[0][0] + h, edges[1][0] : edges[1][0] + w].astype("<f4"))
            yield pd.DataFrame({"img": pdf["img"], "h": pdf["h"], "w": pdf["w"], "dx": [x[0].tobytes() for x in out], "dy": [x[1].tobytes() for x in out]})

    return pairs.mapInPandas(run, f"img {pairs.schema['img'].dataType.simpleString()}, h int, w int, dx binary, dy binary")


def keypoints(images: DataFrame, most: int = 64) -> DataFrame:
    """images' keypoints (img, kp, x, y, score) by the stub: the most steepest places, by gradient, y, x."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for img, h, w, p in zip(pdf["img"], pdf["h"], pdf["w"], pdf["pixels"]):
                a = np.frombuffer(p, "u1").reshape(h, w).astype(float)
                gy, gx = np.gradient(a)
                s = np.hypot(gx, gy)
                order = np.lexsort((np.arange(s.size), -s.ravel()))[:most]
                out += [(img, k, int(i % w), int(i // w), float(s.ravel()[i])) for k, i in enumerate(order)]
            yield pd.DataFrame(out, columns=["img", "kp", "x", "y", "score"])

    return images.mapInPandas(run, f"img {images.schema['img'].dataType.simpleString()}, kp int, x int, y int, score double")
