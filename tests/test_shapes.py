"""Outlines and hulls of objects, against pixels one by one."""

import math

import numpy as np
from pyspark.sql import functions as F

from mosaiq.operators import shapes


def table(spark, objects):
    rows = [("i", int(y), int(x), k) for k, a in enumerate(objects, 1) for y, x in np.argwhere(a)]
    return spark.createDataFrame(rows, "image string, y long, x long, label long")


def made():
    r = np.random.default_rng(8)
    ring = np.ones((7, 9), bool)
    ring[2:4, 3:7] = False
    ring[5, 1] = False
    stairs = np.tril(np.ones((9, 9), bool))
    return [ring, np.ones((1, 1), bool), np.ones((1, 12), bool), np.eye(5, dtype=bool), stairs, r.random((12, 12)) < 0.6]


def inside(points, asked):
    """Which of the asked lie on no side of a line through two points that no point lies on."""
    p, q = np.array(points), np.array(asked)
    ok = np.ones(len(q), bool)
    for a in p:
        d = p - a
        turn = lambda to: d[:, None, 0] * (to[None, :, 1] - a[1]) - d[:, None, 1] * (to[None, :, 0] - a[0])
        bounds = (turn(p) >= 0).all(axis=1) & d.any(axis=1)
        ok &= (turn(q)[bounds] >= 0).all(axis=0)
    return ok


def test_outlines_are_closed_turn_at_each_corner_and_hold_the_pixels(spark):
    objects = made()
    outlines = shapes.contours(table(spark, objects)).cache()
    areas = {}
    for r in shapes.areas(outlines).collect():
        areas.setdefault(r.label, []).append(r.area)
    assert {k: sum(v) for k, v in areas.items()} == {k: a.sum() for k, a in enumerate(objects, 1)}
    assert sorted(areas[1]) == [-8, -1, 63] and areas[4] == [1] * 5
    for r in shapes.polygons(outlines).collect():
        c = r.coordinates
        steps = [(x1 - x0, y1 - y0) for (x0, y0), (x1, y1) in zip(c, c[1:])]
        assert c[0] == c[-1] and all((dx == 0) != (dy == 0) for dx, dy in steps)
        assert all((a[0] == 0) != (b[0] == 0) for a, b in zip(steps, steps[1:] + steps[:1]))
    first = outlines.filter("label = 1 and ring = 0").orderBy("k").collect()
    assert [(r.y, r.x) for r in first] == [(0, 0), (0, 9), (7, 9), (7, 0)]


def test_hulls_equal_half_planes(spark):
    objects = made()
    got = {r.label: r for r in shapes.hulls(table(spark, objects)).collect()}
    for k, a in enumerate(objects, 1):
        points = sorted({(2 * y + dy, 2 * x + dx) for y, x in np.argwhere(a).tolist() for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0))})
        h, w = a.shape
        assert got[k].convex_area == inside(points, [(2 * y, 2 * x) for y in range(h) for x in range(w)]).sum()
        assert {(p.y2, p.x2) for p in got[k].hull} <= set(points)
    assert got[2].hull_area == 0.5 and got[3].hull_area == 11.5


def test_regular_polygons_score_most(spark):
    side, root = 10.0, math.sqrt(3)
    rows = [("i", 1, 1.5 * root * side**2, 6 * side, 6, 1.0, root * side, 2 * side), ("i", 2, 9.0, 12.0, 2, 1.0, 3.0, 4.0), ("i", 3, 9.0, 0.0, 4, 1.0, 3.0, 4.0), ("i", 4, 100.0, 40.0, 4, 1.0, 10.0, 14.0)]
    df = spark.createDataFrame(rows, "image string, label long, area double, perimeter double, neighbours long, solidity double, feret_min double, feret_max double")
    got = {r.label: r for r in shapes.polygonality(df).collect()}
    # all estimates of a hexagon's area agree; of 14 of its size one, from the apothem of the hull, is 3 / 4 of the others
    size = (78 + 10 * (1 - 1 / 3) + 3 * 0.75) / 91
    assert abs(got[1].polygonality - 10) < 1e-9 and abs(got[1].hexagonality - 5 * (1 + size)) < 1e-9
    assert got[2].polygonality is None and got[3].hexagonality is None
    assert abs(got[4].polygonality - 10) < 1e-9 and got[4].hexagonality < 9.5


def test_no_objects(spark):
    none = table(spark, made()).filter(F.lit(False))
    assert shapes.contours(none).count() == 0 == shapes.hulls(none).count()


def test_outlines_over_tiles_equal_those_within_one_and_need_no_rounds_there(spark):
    """All sides met in joins, round by round, wherever they were."""
    one = table(spark, [*made(), np.ones((1, 700), bool), np.arange(40)[:, None] % 2 + np.zeros((1, 40)) + (np.arange(40) == 0) > 0])
    spark.sparkContext.setJobGroup("outlines", "")
    small = shapes.contours(one.filter("label <> 7"))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("outlines"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 12
    want = sorted((r.label, r.ring, r.k, r.y + 250, r.x + 507) for r in small.collect())
    moved = one.withColumn("y", F.col("y") + 250).withColumn("x", F.col("x") + 507)
    got = sorted((r.label, r.ring, r.k, r.y, r.x) for r in shapes.contours(moved).collect())
    assert [r for r in got if r[0] != 7] == want
    assert [r[3:] for r in got if r[0] == 7] == [(250, 507), (250, 1207), (251, 1207), (251, 507)]


def test_areas_of_objects_over_tiles_are_their_pixels(spark):
    """A disc with holes over four tiles, in few jobs."""
    y, x = np.mgrid[:60, :60]
    disc = ((y - 30) ** 2 + (x - 30) ** 2 < 800) & ~((y % 9 == 4) & (x % 7 == 3))
    moved = table(spark, [disc, ~disc]).withColumn("y", F.col("y") + 226).withColumn("x", F.col("x") + 226)
    spark.sparkContext.setJobGroup("areas", "")
    got = shapes.areas(shapes.contours(moved)).groupBy("label").agg(F.sum("area").alias("a")).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("areas"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r.label: r.a for r in got} == {1: disc.sum(), 2: (~disc).sum()} and jobs < 70


def test_scores_of_many_objects_do_not_make_all_pairs_for_each_pair(spark):
    """Each of 91 differences from the mean made that mean, and so all pairs, anew: 2,000 objects took minutes."""
    df = spark.range(2000).selectExpr("'i' AS image", "id AS label", "90.0 + id AS area", "40.0D AS perimeter", "6L AS neighbours", "0.9D AS solidity", "9.0D AS feret_min", "12.0D AS feret_max")
    tree = shapes.polygonality(df)._jdf.queryExecution().optimizedPlan().treeString()
    assert len(tree) < 10_000
    assert shapes.polygonality(df).filter("hexagonality_sd > 0").count() == 2000
