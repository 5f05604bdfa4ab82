"""Trial maps meet matches in blocks."""

import numpy as np

from mosaiq.operators import registration


def test_maps_are_not_sent_with_every_match(spark, monkeypatch):
    """Rows that meet the trial maps are some hundred times fewer than matches, and all matches count."""
    met = []
    monkeypatch.setattr(registration, "looked_up", lambda rows, lookup, key, plain=registration.looked_up: met.append(rows.count()) or plain(rows, lookup, key))
    r = np.random.default_rng(5)
    p = r.uniform(0, 1000, (4000, 2))
    wrong = np.arange(4000) % 4 == 0
    q = np.where(wrong[:, None], r.uniform(5000, 6000, (4000, 2)), 1.1 * p + [5.0, -3.0])
    rows = [("a" if i % 10 else "b", i, *map(float, (*p[i], *q[i]))) for i in range(4000)]
    df = spark.createDataFrame(rows, "pair string, m long, x1 double, y1 double, x2 double, y2 double").coalesce(1)
    got = {x["pair"]: x for x in registration.homographies(df).collect()}
    assert max(met) < 40
    for name in "ab":
        mine = np.array([x[0] == name for x in rows])
        want = int(((np.hypot(*(1.1 * p + [5.0, -3.0] - q).T) <= 2) & mine).sum())
        assert got[name]["n"] == mine.sum() and got[name]["agreeing"] == want
        assert np.allclose(got[name]["h"], [1.1, 0, 5, 0, 1.1, -3, 0, 0, 1], atol=1e-6)
