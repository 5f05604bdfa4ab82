"""Distances and watersheds, against all pixels and a flood by priority."""

import heapq
import random

import numpy as np
import pytest

from mosaiq.operators import watershed

H, W = 14, 17


def table(spark, arrays, column="v"):
    rows = [(k, y, x, v) for k, a in arrays.items() for (y, x), v in np.ndenumerate(np.array(a)) for v in [int(v)]]
    return spark.createDataFrame(rows, f"image string, y long, x long, {column} long")


def masks():
    r = np.random.default_rng(3)
    yy, xx = np.mgrid[:H, :W]
    discs = ((yy - 6) ** 2 + (xx - 4) ** 2 <= 14) | ((yy - 7) ** 2 + (xx - 10) ** 2 <= 17)
    return {"noise": r.random((H, W)) < 0.7, "discs": discs, "none": np.zeros((H, W), bool), "one": ~((yy == 3) & (xx == 2))}


def test_lower_envelope_equals_all_pairs():
    r = np.random.default_rng(1)
    for _ in range(300):
        n = r.integers(1, 40)
        g = np.where(r.random(n) < 0.3, np.inf, r.integers(0, 30, n) ** 2).astype(float)
        want = np.min((np.arange(n)[:, None] - np.arange(n)[None]) ** 2 + g[None], axis=1)
        assert (watershed.lower_envelope(g) == want).all()


def test_distances_equal_all_pairs(spark):
    made = masks() | {"full": np.ones((H, W), bool)}
    got = watershed.squared_distance(table(spark, made)).collect()
    assert len(got) == H * W * len(made)
    for r in got:
        away = np.argwhere(~made[r.image])
        want = min(((y - r.y) ** 2 + (x - r.x) ** 2 for y, x in away.tolist()), default=None)
        assert r.d2 == want


def by_priority(heights, seeds, steps):
    """The seeds' pixels take the least edge to any pixel without a label, again and again."""
    label, heap = dict(seeds), []

    def put(p):
        for dy, dx in steps:
            q = (p[0] + dy, p[1] + dx)
            if q in heights and q not in label:
                heapq.heappush(heap, (max(heights[p], heights[q]), min(p, q), max(p, q), p, q))

    for p in list(label):
        put(p)
    while heap:
        *_, p, q = heapq.heappop(heap)
        if q not in label:
            label[q] = label[p]
            put(q)
    return label


@pytest.mark.parametrize("connectivity", [1, 2])
def test_flood_equals_a_flood_by_priority(spark, connectivity):
    r = random.Random(connectivity)
    rows, seeds, want = [], [], {}
    steps = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and (connectivity == 2 or not dy * dx)]
    for image, most in (("rough", 1000), ("plateaus", 3), ("flat", 0), ("holes", 4)):
        heights = {(y, x): r.randint(0, most) for y in range(H) for x in range(W) if image != "holes" or r.random() < 0.65}
        own = {p: i for i, p in enumerate(r.sample(sorted(heights), 6))}
        first = min(own)
        own |= {q: own[first] for q in ((first[0], first[1] + 1),) if q in heights and q not in own}
        rows += [(image, y, x, h) for (y, x), h in heights.items()]
        seeds += [(image, y, x, i) for (y, x), i in own.items()]
        want |= {(image, *p): v for p, v in by_priority(heights, own, steps).items()}
    got = watershed.flood(spark.createDataFrame(rows, "image string, y long, x long, h long"), spark.createDataFrame(seeds, "image string, y long, x long, label long"), W, connectivity)
    assert {(g.image, g.y, g.x): g.label for g in got.collect()} == want


def test_touching_discs_are_split(spark):
    made = masks()["discs"]
    got = {(g.y, g.x): g.label for g in watershed.split_touching(table(spark, {"discs": made}), W, radius=3).collect()}
    assert set(got) == {(int(y), int(x)) for y, x in np.argwhere(made)}
    assert len(set(got.values())) == 2 and got[6, 2] != got[7, 12]


def test_empty(spark):
    none = table(spark, masks()).limit(0)
    assert watershed.squared_distance(none).count() == 0 == watershed.split_touching(none, W).count()


def test_parts_find_where_their_edges_lead_in_few_jobs(spark):
    """A row of 5,000 parts that ends in a seed, and one that ends in a pair: each was tied by stars, of several jobs and joins a round."""
    rows = [("i", k, k - 1 if k else -7) for k in range(5000)] + [("j", k, k + 1 if k < 4999 else 4998) for k in range(5000)]
    best = spark.createDataFrame(rows, "image string, a long, b long")
    got = watershed._led(best)
    seen = {(r.image, r.least) for r in got.collect()}
    assert got.count() == 10_000 and seen == {("i", -7), ("j", 4998)}
