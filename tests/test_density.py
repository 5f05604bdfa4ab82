"""Clusters by density over many tasks, against cutting the whole tree from the top."""

import numpy as np
import pytest

from mosaiq.operators import clustering, density


def reach(x, least):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    core = np.sort(d, axis=1)[:, min(least, len(x) - 1)]
    return np.maximum(d, np.maximum(core[:, None], core[None]))


def pieces(w, members, below):
    """Parts of the members that are tied by lengths below a bound."""
    left, found = set(members), []
    while left:
        part, todo = set(), [left.pop()]
        while todo:
            i = todo.pop()
            part.add(i)
            near = [j for j in left if w[i, j] < below]
            left -= set(near)
            todo += near
        found.append(sorted(part))
    return found


def top_down(x, least):
    """Labels by cutting, from all points down, at every length at which something falls apart."""
    n, w = len(x), reach(x, least)
    labels = np.full(n, -1)
    if n <= least:
        return labels

    def longest(members):
        """The length at which the members are just tied: the longest edge of a spanning tree."""
        inside, best = {members[0]}, {j: w[members[0], j] for j in members[1:]}
        worst = 0.0
        while best:
            j = min(best, key=best.get)
            worst = max(worst, best.pop(j))
            inside.add(j)
            for k in best:
                best[k] = min(best[k], w[j, k])
        return worst

    def grow(members, birth, is_root):
        """(stability, chosen clusters) of the cluster that begins with these members."""
        stable, own = 0.0, members
        while True:
            at = longest(own) if len(own) > 1 else 0.0
            rate = 1 / max(at, 1e-300)
            parts = pieces(w, own, at) if len(own) > 1 else []
            large = [p for p in parts if len(p) >= least]
            if len(large) == 1:
                stable += (rate - birth) * (len(own) - len(large[0]))
                own = large[0]
                continue
            stable += (rate - birth) * len(own)
            below = [grow(p, rate, False) for p in large]
            break
        inner = sum(s for s, _ in below)
        if not is_root and (not below or stable >= inner):
            return stable, [members]
        return inner, [c for _, chosen in below for c in chosen]

    _, chosen = grow(list(range(n)), 0.0, True)
    for k, members in enumerate(sorted(chosen, key=min)):
        labels[members] = k
    return labels


def blobs(r, kind):
    if kind == "even":  # ties everywhere
        return np.array([(i, j) for i in range(9) for j in range(9)] + [(30 + i, j) for i in range(5) for j in range(5)], float)
    if kind == "copies":
        return np.vstack([np.repeat(r.normal(size=(4, 2)) * 10, 12, axis=0), r.normal(size=(60, 2)), np.repeat([[3.0, 3.0]], 5, axis=0)])
    if kind == "line":
        return np.cumsum(np.arange(1, 41))[:, None] * 1.0
    x = np.vstack([r.normal(c, s, (m, 2)) for c, s, m in (((0, 0), 0.3, 60), ((3, 0), 0.3, 50), ((3, 1.5), 0.2, 30), ((20, 20), 1.0, 40))])
    return np.vstack([x, r.uniform(-5, 25, (25, 2))])


@pytest.mark.parametrize("kind", ["blobs", "even", "copies", "line"])
def test_labels_equal_cutting_from_the_top(spark, kind):
    r = np.random.default_rng(5)
    x = blobs(r, kind)
    ids = r.permutation(len(x))
    x = x[np.argsort(ids)]
    rows = [(int(i), *map(float, v)) for i, v in enumerate(x)] + [(len(x), *[None] * x.shape[1])]
    columns = [f"x{i}" for i in range(x.shape[1])]
    df = spark.createDataFrame(rows, ", ".join(["id long", *(f"{c} double" for c in columns)])).repartition(3)
    how = density.Spread() if kind == "line" else density.Spread(cell=20, most_cells=8, sample=90)
    got = {r.id: r.cluster for r in density.spread_labels(df, columns, 4, "id", how).collect()}
    assert got.pop(len(x)) == -1
    assert [got[i] for i in range(len(x))] == top_down(x, 4).tolist()
    if kind == "blobs":
        assert [got[i] for i in range(len(x))] == clustering.density_labels(x, 4).tolist()


def test_few_rows_are_noise(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(4)], "id long, x double")
    assert {r.cluster for r in density.spread_labels(df, ["x"], 5, "id").collect()} == {-1}
    assert density.spread_labels(df.limit(0), ["x"], 5, "id").count() == 0


@pytest.mark.parametrize("kind", ["groups", "copies"])
def test_points_in_many_dimensions_meet_once_for_their_lists(spark, monkeypatch, kind):
    """All cells met each other in every round; now only what its lists do not tell looks for its least edge."""
    r = np.random.default_rng(7)
    if kind == "groups":  # far apart, so that no list leaves its group
        x = np.vstack([r.normal(c, 0.3, (m, 6)) for c, m in ((0, 40), (8, 30), (-7, 30))])
    else:  # copies, and ties everywhere
        x = np.vstack([np.repeat(r.normal(size=(3, 4)) * 10, 8, axis=0), np.array(list(np.ndindex(3, 3, 3, 2)), float), [[30.0] * 4] * 5])
    x = r.permutation(x)
    looked = []
    monkeypatch.setattr(density, "_looked_for", lambda *a, plain=density._looked_for: looked.append(plain(*a)) or looked[-1])
    monkeypatch.setattr(density, "spanning_edges", lambda *a: pytest.fail("cells met in a round"))
    columns = [f"x{i}" for i in range(x.shape[1])]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], ", ".join(["id long", *(f"{c} double" for c in columns)])).repartition(3)
    got = {r.id: r.cluster for r in density.spread_labels(df, columns, 4, "id", density.Spread(most_cells=8, sample=90, wide=15, listed=4)).collect()}
    assert [got[i] for i in range(len(x))] == top_down(x, 4).tolist()
    assert kind == "copies" or any(f.count() for f in looked)


def test_least_tree_of_lists_is_that_of_all_pairs(spark):
    r = np.random.default_rng(9)
    x = np.vstack([r.normal(c, 1.0, (40, 5)) for c in (0, 30, 31, 90)])
    df = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], "p long, weight long, v array<double>")
    how = density.Spread(wide=30, listed=5)
    points, known = density.lists(df, 5, 4, len(x), len(x), how)
    got = sorted(e.w for e in density.spanning_of_lists(points, known, 5, how).collect())
    w, inside, best, want = reach(x, 4), {0}, {}, []
    while len(inside) < len(x):
        best = {j: min(w[i, j] for i in inside) for j in range(len(x)) if j not in inside}
        j = min(best, key=best.get)
        want.append(best[j])
        inside.add(j)
    assert np.allclose(got, sorted(want), rtol=1e-12) and len(got) == len(x) - 1
