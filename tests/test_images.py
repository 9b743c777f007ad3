"""Array operators of one image against slower definitions."""

import time

import numpy as np
import pytest

from framelake.operators import images


@pytest.mark.parametrize("share", [0.001, 0.02, 0.3, 0.9, 1.0])
@pytest.mark.parametrize("shape", [(1, 1), (1, 40), (40, 1), (37, 53)])
def test_distance_equals_all_pairs(shape, share):
    rng = np.random.default_rng(7)
    ground = rng.random(shape) < share
    y, x = np.nonzero(ground)
    yy, xx = np.mgrid[: shape[0], : shape[1]]
    want = np.sqrt(((yy[..., None] - y) ** 2 + (xx[..., None] - x) ** 2).min(axis=2)) if len(y) else np.full(shape, np.inf)
    assert (images.plain_distance(ground) == want).all()


def test_distance_of_a_frame_is_fast():
    rng = np.random.default_rng(1)
    ground = rng.random((480, 854)) < 0.01
    images.plain_distance(ground[:50])
    took = []
    for _ in range(3):
        began = time.thread_time()
        images.plain_distance(ground)
        took.append(time.thread_time() - began)
    assert min(took) < 0.4  # 0.1 s alone on a machine; 1.1 s by comparing the places of a row


@pytest.mark.parametrize("shape", [(40, 24), (37, 53), (5, 4), (3, 1)])
@pytest.mark.parametrize("levels", [1, 2, 4])
def test_collapse_gives_the_image_back(shape, levels):
    image = np.random.default_rng(2).uniform(0, 255, shape)
    assert np.abs(images.collapsed(images.laplacian_pyramid(image, levels)) - image).max() < 1e-9
    assert np.abs(images.multiband(image, image, np.ones(shape), levels) - image).max() < 1e-9


def test_bands_leave_what_is_far_from_the_mask():
    rng = np.random.default_rng(3)
    canvas, patch, mask = rng.uniform(0, 255, (64, 64)), rng.uniform(0, 255, (64, 64)), np.zeros((64, 64))
    mask[:, 40:] = 1
    out = images.multiband(canvas, patch, mask, 3)
    assert np.allclose(out[:, :20], canvas[:, :20]) and np.allclose(out[:, 60:], patch[:, 60:])
    flat = images.halved(np.full((9, 7), 3.0))
    assert flat.shape == (4, 3) and np.allclose(flat, 3) and np.allclose(images.doubled(flat, (9, 7)), 3)
