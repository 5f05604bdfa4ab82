"""A map that was put into matches, found again among wrong ones."""

import numpy as np

from mosaiq.operators import registration

MAPS = {"a": [[1.02, 0.05, 12], [-0.04, 0.97, -7], [1e-5, -2e-5, 1]], "b": [[0.8, -0.3, 200], [0.35, 0.9, 30], [5e-5, 1e-5, 1]]}


def test_planted_maps_are_found_among_wrong_matches(spark):
    r = np.random.default_rng(7)
    rows, right = [], {}
    for pair, h in MAPS.items():
        p = r.uniform(0, 1000, (400, 2))
        q = np.column_stack([p, np.ones(400)]) @ np.array(h).T
        q = q[:, :2] / q[:, 2:] + r.normal(0, 0.3, (400, 2))
        wrong = r.random(400) < 0.4
        q[wrong] = r.uniform(0, 1000, (wrong.sum(), 2))
        right[pair] = (~wrong).sum()
        rows += [(pair, i, *map(float, (*p[i], *q[i]))) for i in range(400)]
    rows += [("few", i, 1.0 * i, 2.0, 3.0, 4.0) for i in range(3)] + [("a", 900, None, 1.0, 1.0, 1.0)]
    got = {x.pair: x for x in registration.homographies(spark.createDataFrame(rows, "pair string, m long, x1 double, y1 double, x2 double, y2 double")).collect()}
    assert set(got) == set(MAPS)
    corners = np.array([[0, 0, 1], [1000, 0, 1], [0, 1000, 1], [1000, 1000, 1]], float)
    for pair, x in got.items():
        found, want = corners @ np.reshape(x.h, (3, 3)).T, corners @ np.array(MAPS[pair]).T
        assert np.abs(found[:, :2] / found[:, 2:] - want[:, :2] / want[:, 2:]).max() < 0.5
        assert x.n == 400 and right[pair] <= x.agreeing <= right[pair] + 3
