"""Turned images, and plates that were drawn."""

import numpy as np

from mosaiq.operators import plates

H, W = 104, 140


def table(spark, images):
    rows = [(k, int(y), int(x), int(v)) for k, a in images.items() for (y, x), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, "image string, y long, x long, v long")


def drawn(degrees):
    yy, xx = np.mgrid[:H, :W]
    a = np.full((H, W), 10) + (yy * 7 + xx * 3) % 5
    t = np.radians(degrees)
    for r in range(4):
        for c in range(6):
            y, x = (r - 1.5) * 18, (c - 2.5) * 18
            cy, cx = y * np.cos(t) - x * np.sin(t) + (H - 1) / 2, x * np.cos(t) + y * np.sin(t) + (W - 1) / 2
            a[(yy - cy) ** 2 + (xx - cx) ** 2 <= 30] = 100 + r
    return a


def turned(a, degrees):
    out, t = np.zeros(a.shape), np.radians(degrees)
    for y, x in np.ndindex(*a.shape):
        dy, dx = y - (a.shape[0] - 1) / 2, x - (a.shape[1] - 1) / 2
        sy, sx = np.round(dx * np.sin(t) + dy * np.cos(t) + (a.shape[0] - 1) / 2, 9), np.round(dx * np.cos(t) - dy * np.sin(t) + (a.shape[1] - 1) / 2, 9)
        for i in (0, 1):
            for j in (0, 1):
                p, q = int(np.floor(sy)) + i, int(np.floor(sx)) + j
                if 0 <= p < a.shape[0] and 0 <= q < a.shape[1]:
                    out[y, x] += a[p, q] * (1 - abs(sy - p)) * (1 - abs(sx - q))
    return out


def test_turned_images_equal_pixel_by_pixel(spark):
    r = np.random.default_rng(1)
    images = {"a": r.integers(0, 99, (9, 12)), "b": r.integers(0, 99, (9, 12))}
    got = plates.rotated(table(spark, images), spark.createDataFrame([("a", 30), ("b", 90)], "image string, degrees int"), 9, 12).collect()
    want = {"a": turned(images["a"], 30), "b": turned(images["b"], 90)}
    assert len(got) == 2 * 9 * 12 and all(abs(p.v - want[p.image][p.y, p.x]) < 1e-6 for p in got)


def test_drawn_plates_are_found(spark):
    none = np.full((H, W), 3)
    none[50:60, 20:30] = 90
    got = {p.image: p for p in plates.plates(table(spark, {"flat": drawn(0), "turned": drawn(6), "none": none}), H, W).collect()}
    assert set(got) == {"flat", "turned"}
    for name, degrees in (("flat", 0), ("turned", 6)):
        p = got[name]
        assert p.size == 24 and abs(abs(p.degrees) - degrees) <= 1 and p.radius in (5, 6) and p.roi_radius in (8, 9)
        assert np.abs(np.array(p.rows) - [25, 43, 61, 79]).max() <= 1.5 and np.abs(np.array(p.columns) - [25, 43, 61, 79, 97, 115]).max() <= 1.5
        assert p.y0 < 25 - p.radius and p.x1 > 115 + p.radius
