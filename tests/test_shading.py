"""Shading and bleeding that were put into images, found again."""

import numpy as np
import pytest

from mosaiq.operators import shading

H, W = 24, 32


def planted(r, n=30):
    yy, xx = np.mgrid[:H, :W]
    flat = 1.2 - 0.5 * (((yy - 10) / H) ** 2 + ((xx - 18) / W) ** 2)
    flat /= flat.mean()
    images = []
    for _ in range(n):
        v = r.uniform(80, 200) * flat
        for _ in range(r.integers(1, 5)):  # bright objects
            y, x = r.integers(0, H - 5), r.integers(0, W - 5)
            v[y : y + 5, x : x + 5] *= r.uniform(2, 6)
        images.append(v + r.normal(0, 1, v.shape))
    return flat, images


def table(spark, images):
    rows = [(k, int(y), int(x), float(v)) for k, a in enumerate(images) for (y, x), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, "image long, y long, x long, v double")


def test_planted_shading_is_found_within_a_hundredth(spark):
    flat, images = planted(np.random.default_rng(4))
    got, _ = shading.flat_field(table(spark, images), H, W)
    assert got.shape == (H, W) and np.abs(got / flat - 1).max() < 0.01


def test_dark_field(spark):
    r = np.random.default_rng(5)
    flat, images = planted(r, 40)
    dark = 20 * (1 + np.cos(np.pi * np.mgrid[:H, :W][1] / W))
    got, base = shading.flat_field(table(spark, [a + dark for a in images]), H, W, dark=True)
    want = dark - (dark / flat).min() * flat
    assert np.abs(got / flat - 1).max() < 0.02 and np.abs(base - want).max() < 4


def test_blocks_and_errors(spark):
    pixels = table(spark, [np.ones((H, W))])
    rows, shape = shading.averaged(pixels, H, W, 8)
    assert shape == (8, 8) and rows.first().v == [1.0] * 64
    with pytest.raises(ValueError, match="image"):
        shading.flat_field(pixels.filter("y > 0"), H, W)


def test_cosines_are_orthonormal():
    c = shading.cosines(9)
    assert np.allclose(c @ c.T, np.eye(9))


def test_planted_mixing_is_found(spark):
    r = np.random.default_rng(6)
    clean = r.gamma(2, 50, (2, 3, 14, 15))  # image, channel, y, x
    kernel = np.array([[0, 0.02, 0], [0.05, 0.3, 0.01], [0, 0.04, 0]])
    seen = clean.copy()
    for i in range(2):
        for y in range(1, 13):
            for x in range(1, 14):
                seen[i, 2, y, x] = 7 + 0.001 * r.normal() + (clean[i, 0, y - 1 : y + 2, x - 1 : x + 2] * kernel).sum()
    rows = [(i, y, x, c, float(v)) for (i, c, y, x), v in np.ndenumerate(seen)]
    got = shading.bleed_through(spark.createDataFrame(rows, "image long, y long, x long, channel long, v double"), [0, 1, 2])
    assert abs(got[2][0] - 7) < 0.1
    assert np.abs(got[2][1:10].reshape(3, 3) - kernel).max() < 1e-3 and np.abs(got[2][10:]).max() < 1e-3
