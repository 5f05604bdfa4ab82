"""Operators that SQL does not tell, against brute force and known results."""

import itertools
import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mosaiq.functions import distogram, extend, names, special
from mosaiq.operators import clustering, filters, objects, ranks, regions, reshape, tables, thresholds, vectors
from mosaiq.sources import files
from mosaiq.streaming import resume


def two_humps(spark):
    rng = np.random.default_rng(4)
    values = np.clip(np.concatenate([rng.normal(40, 8, 6000), rng.normal(120, 12, 4000)]).round(), 0, 255).astype(int)
    v, n = np.unique(values, return_counts=True)
    return spark.createDataFrame([("i", int(a), int(b)) for a, b in zip(v, n, strict=True)], "image string, v long, n long"), values


def test_thresholds_part_two_humps(spark):
    hist, _ = two_humps(spark)
    for name, rule in thresholds.METHODS.items():
        found = rule(hist).first()["threshold"]
        low, high = {"percentile": (35, 60), "triangle": (45, 120), "rosin": (45, 120)}.get(name, (50, 110))
        assert low <= found <= high, (name, found)


def test_smoothing_ends_with_two_modes():
    bins = np.array([0, 5, 1, 6, 0, 0, 0, 7, 2, 8, 1], float)
    smooth, peaks = thresholds.two_modes(bins)
    assert len(peaks) == 2 and abs(smooth.sum() - bins.sum()) < bins.sum() / 2
    assert thresholds._minimum(bins) in range(peaks[0], peaks[1] + 1)


def test_colours_are_those_of_one_node_after_the_other(spark):
    r = random.Random(3)
    nodes = list(range(1, 41))
    edges = sorted({tuple(sorted(r.sample(nodes[:36], 2))) for _ in range(90)})
    got = regions.coloured(spark.createDataFrame([("i", n) for n in nodes], "image string, label long"), spark.createDataFrame([("i", *e) for e in edges], "image string, a long, b long"))
    near = {n: {b if a == n else a for a, b in edges if n in (a, b)} for n in nodes}
    wanted = {}
    for n in sorted(nodes, key=lambda n: (-len(near[n]), n)):
        used = {wanted[m] for m in near[n] if m in wanted}
        wanted[n] = next(c for c in itertools.count() if c not in used)
    assert {x["label"]: x["colour"] for x in got.collect()} == wanted
    spread = {x["label"]: x["new"] for x in regions.spread_colours(got, 255).collect()}
    assert min(spread.values()) == 1 and max(spread.values()) < 255


def test_nearest_objects_far_apart_and_missing(spark):
    r = random.Random(1)
    left = [("i", n, r.uniform(0, 1000), r.uniform(0, 1000)) for n in range(30)] + [("empty", 1, 5.0, 5.0)]
    right = [("i", n, r.uniform(0, 30), r.uniform(0, 30)) for n in range(12)]
    schema = "image string, label long, cy double, cx double"
    got = regions.nearest(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), 3, 1.0).collect()
    wanted = {(n, rank): m for _, n, y, x in left[:30] for rank, m in enumerate((m for _, m, *_ in sorted(right, key=lambda o: ((o[2] - y) ** 2 + (o[3] - x) ** 2, o[1]))[:3]), 1)}
    assert {(g["left"], g["rank"]): g["right"] for g in got} == wanted and len(got) == 90


def test_boxes_of_very_different_sizes_are_in_range(spark):
    r = random.Random(2)
    boxes = []
    for n in range(60):
        y, x, s = r.randrange(400), r.randrange(400), r.choice([0, 1, 3, 40, 200])
        boxes.append(("i", n, y, x, y + s, x + r.choice([0, s])))
    got = {(g["a"], g["b"]) for g in regions.in_range(spark.createDataFrame(boxes, "image string, label long, y1 long, x1 long, y2 long, x2 long"), 1.5).collect()}
    middle = {n: ((a + c) / 2, (b + d) / 2, ((c - a) ** 2 + (d - b) ** 2) ** 0.5 / 2) for _, n, a, b, c, d in boxes}
    wanted = {(p, q) for p in middle for q in middle if p < q and ((middle[p][0] - middle[q][0]) ** 2 + (middle[p][1] - middle[q][1]) ** 2) ** 0.5 <= (middle[p][2] + middle[q][2]) * 1.5}
    assert got == wanted


def test_quantiles_with_ties_nulls_and_one_value(spark):
    rows = [("a", float(x)) for x in [1, 1, 1, 2, 50, 50, 1000]] + [("b", None), ("b", 7.0), ("c", None), (None, 3.0), (None, 5.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r["m"] for r in tables.quantile(df, ["k"], "v", {"m": 0.5}).collect()}
    assert got == {"a": 2.0, "b": 7.0, None: 4.0}
    assert tables.quantile(df, [], "v", {"m": 0.25}).first()["m"] == float(np.quantile([x for _, x in rows if x is not None], 0.25))
    assert tables.quantile(df.limit(0), ["k"], "v", {"m": 0.5}).count() == 0


def test_sketches_merge(spark):
    rng = np.random.default_rng(9)
    values = rng.lognormal(1, 0.7, 20_000)
    parts = [distogram.Distogram(64).update(p) for p in np.array_split(values, 7)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.merge(p)
    assert len(whole.at) <= 64 and round(whole.n.sum()) == len(values) and (whole.low, whole.high) == (values.min(), values.max())
    assert abs(whole.quantile(0.5) - np.median(values)) < 0.15 and abs(whole.moments()[0] - values.mean()) < 1e-9
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(len(values)) % 3, "v": values}))
    assert {r["k"]: round(sum(r["n"])) for r in distogram.sketches(df.repartition(3), "k", "v").collect()} == {0: 6667, 1: 6667, 2: 6666}


def test_positions_merge_with_the_mean_before_them(spark):
    df = spark.createDataFrame([("i", float(x)) for x in (1, 2, 3, 10, 11, 13, 30)], "image string, p double")
    got = [(r["position"], r["n"]) for r in tables.merged_positions(df, ["image"], "p", 2.0).collect()]
    assert got == [(2.0, 3), (10.5, 2), (13.0, 1), (30.0, 1)]


def test_ranks_go_on_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(9)
    assert [r["rank"] for r in ranks.ranked(df, ["v"]).orderBy("v").collect()] == list(range(1000))


def test_k_means_and_whitening(spark):
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal(c, 0.1, (50, 2)) * [1, 100] for c in ((0, 0), (3, 3), (6, 0))])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>")
    centres = np.array(vectors.whitened_k_means(df, 3))
    assert np.all(np.diff(np.linalg.norm(centres, axis=1)) >= 0)
    truth = np.stack([points[i : i + 50].mean(axis=0) for i in (0, 50, 100)])
    near = np.abs(centres[:, None] / [1, 100] - truth[None] / [1, 100]).sum(axis=2).min(axis=1)
    settled = np.array(vectors.k_means(df, 3))
    which = ((points[:, None] - settled[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert np.allclose(settled, np.stack([points[which == c].mean(axis=0) for c in range(3)])) and near.max() < 4


def test_steps_of_users(spark):
    df = spark.range(10)
    calls = {"n": 0}

    def flaky(frame):
        calls["n"] += 1
        if calls["n"] % 2:
            raise OSError("not yet")
        return frame * 2

    assert sorted(r["id"] for r in extend.apply_step(df, flaky, "id long").collect()) == list(range(0, 20, 2))
    extend.register(spark)
    assert spark.sql("SELECT count(*) AS n, max(y1) AS h, max(x1) AS w FROM tiles(10, 7, 4)").first() == (6, 10, 7)
    told = json.loads(extend.manifest([tables.merged_positions, regions.in_range]))
    assert told[0]["inputs"] == ["df"] and told[0]["parameters"]["properties"]["radius"] == {"type": "number"} and told[1]["parameters"]["properties"]["multiplier"]["default"] == 1.0


def test_plan_time_checks(spark):
    assert names.expanded(["a, *G*"], {"G": ["b", "a"], "H": ["c"]}) == ["a", "b"]
    for bad in (["x"], ["*X*"]):
        with pytest.raises(ValueError):
            names.expanded(bad, {"G": ["b"]})
    with pytest.raises(ValueError):
        names.checked("c", ["z"], {"a"})
    assert names.best_grouping({"r": 4, "c": 6, "z": 50}, 30) == (["c", "r"], 24)
    with pytest.raises(ValueError):
        reshape.zipped(spark.createDataFrame([("a",)], "name string"), spark.createDataFrame([("b",)], "name string"), "name")
    with pytest.raises(ValueError):
        files.write(spark.range(1), "/nowhere", "xlsx")
    with pytest.raises(ValueError):
        objects.components(spark.createDataFrame([("i", 0, 9, 1)], "image string, y long, x long, v long"), 5)
    a, b = special.curve(1.0, 0.1)
    assert abs(a - 1.577) < 0.01 and abs(b - 0.895) < 0.005


def test_ellipse_and_filled_holes(spark):
    assert sorted(filters.ellipse(3)) == [(-1, 0), (0, -1), (0, 0), (0, 1), (1, 0)]
    picture = ["1111", "1001", "1111", "0000"]
    mask = spark.createDataFrame([("i", y, x, int(c)) for y, line in enumerate(picture) for x, c in enumerate(line)], "image string, y long, x long, v long")
    assert filters.holes_filled(mask, 4, 4).filter("v > 0").count() == 12


def test_density_clusters_and_noise(spark):
    rng = np.random.default_rng(2)
    blobs = np.concatenate([rng.normal((0, 0), 0.3, (60, 2)), rng.normal((10, 10), 0.5, (80, 2)), rng.normal((0, 12), 0.2, (40, 2)), [[5.0, 5.0], [20.0, -9.0], [-9.0, 25.0]]])
    labels = clustering.density_labels(blobs, 5)
    assert len(set(labels[labels >= 0].tolist())) == 3 and (labels[-2:] == -1).all()
    for a, z in ((0, 60), (60, 140), (140, 180)):
        inside = labels[a:z][labels[a:z] >= 0]
        assert len(set(inside.tolist())) == 1 and len(inside) > 0.8 * (z - a)
    df = spark.createDataFrame(pd.DataFrame({"g": ["a"] * 100 + ["b"] * 83, "x": blobs[:, 0], "y": blobs[:, 1]}))
    got = clustering.density_clusters(df, ["x", "y"], 5, ["g"])
    assert got.count() == 183 and got.columns == ["g", "x", "y", "cluster"] and got.agg(F.min("cluster")).first()[0] == 0
    assert clustering.density_clusters(df, ["x", "y"], 5, outlier=1).agg(F.min("cluster")).first()[0] == 1
    with pytest.raises(ValueError):
        clustering.density_clusters(df, ["x", "y"], 5, ["g"], most_rows=90)


def test_a_spanning_tree_is_the_least(spark):
    rng = np.random.default_rng(8)
    points = rng.random((40, 3))
    core = clustering.core_distances(points, 3)
    reach = np.maximum(np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2)), np.maximum(core[:, None], core[None]))
    found, total = list(range(40)), 0.0
    for d, i, j in sorted((reach[i, j], i, j) for i in range(40) for j in range(i)):
        if found[i] != found[j]:
            total, old = total + d, found[j]
            found = [found[i] if f == old else f for f in found]
    assert np.isclose(clustering.spanning_tree(points, core)[:, 2].sum(), total)


def test_unmixing_tells_channels_apart(spark):
    rng = np.random.default_rng(7)
    points = np.concatenate([rng.normal(c, 0.2, (200, 2)) for c in ((0, 0), (8, 1), (2, 9))])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in clustering.unmixed(df, 2, percent=60).collect()}
    for a in (0, 200, 400):
        assert len({got[i]["cluster"] for i in range(a, a + 200)}) == 1
    assert got[0]["cluster"] == 0 and abs(got[300]["strength"] - np.linalg.norm(points[300])) < 1e-9


def test_fetching_goes_on_where_it_ended(spark, tmp_path):
    target, state = str(tmp_path / "rows"), str(tmp_path / "state")
    rows = [("2024-01-01", 1), ("2024-01-02", 2)]
    source = lambda: spark.createDataFrame(rows, "day string, id long")
    assert resume.last_fetched(spark, state) is None and resume.fetch(source(), "day", target, state) == 2
    assert resume.fetch(source(), "day", target, state) == 0
    rows += [("2024-01-03", 3), ("2024-01-02", 4)]
    assert resume.fetch(source(), "day", target, state) == 1 and resume.last_fetched(spark, state) == "2024-01-03"
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == [1, 2, 3]
    folder = str(tmp_path / "files")
    for part, ids in enumerate(([1, 2, 2], [3])):
        spark.createDataFrame([(i,) for i in ids], "id long").coalesce(1).write.mode("append").json(folder)
        resume.follow(spark, folder, "id long", str(tmp_path / "out"), str(tmp_path / "done"), ["id"])
        assert spark.read.parquet(str(tmp_path / "out")).count() == (2, 3)[part]
