"""Operators on small fixtures with known results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.functions.patterns import FilePattern, rename
from mosaiq.operators import matching, neighbours, objects, raster, tables, vectors
from mosaiq.plans.predicates import compile_predicate
from mosaiq.sources import vectors as stitching
from mosaiq.streaming import events


def pixels(spark, picture, value="v"):
    rows = [("i", y, x, int(c)) for y, line in enumerate(picture) for x, c in enumerate(line)]
    return spark.createDataFrame(rows, f"image string, y long, x long, {value} long")


def picture(df, h, w, value="v"):
    out = [["0"] * w for _ in range(h)]
    for r in df.collect():
        out[r["y"]][r["x"]] = str(r[value])
    return ["".join(line) for line in out]


def test_pattern_names(spark):
    files = spark.createDataFrame([("r001_c02_DAPI.tif",), ("r010_c3_GFP.tif",), ("other",)], "file string")
    p = FilePattern("r{row:ddd}_c{col:d+}_{chan:c+}.tif")
    got = {r["file"]: (r["row"], r["col"], r["chan"]) for r in p.parse(files).collect()}
    assert got == {"r001_c02_DAPI.tif": (1, 2, "DAPI"), "r010_c3_GFP.tif": (10, 3, "GFP")}
    new = {r["file"]: r["new_name"] for r in rename(files, p, FilePattern("x{row:dddd}_{chan:dd}.ome.tif")).collect()}
    assert new == {"r001_c02_DAPI.tif": "x0001_01.ome.tif", "r010_c3_GFP.tif": "x0010_00.ome.tif"}
    with pytest.raises(ValueError):
        FilePattern("{a:d}{a:d}")


def test_components_meet_around_corners(spark):
    mask = pixels(spark, ["11011", "01010", "01110", "00000", "10001"])
    found = {r["label"] for r in objects.components(mask, 5).collect()}
    assert found == {1, 21, 25}
    assert {r["label"] for r in objects.relabel(objects.components(mask, 5)).collect()} == {1, 2, 3}
    diagonal = pixels(spark, ["10", "01"])
    assert {r["label"] for r in objects.components(diagonal, 2, 1).collect()} == {1, 4}
    assert {r["label"] for r in objects.components(diagonal, 2, 2).collect()} == {1}


def test_a_long_snake_is_one_component(spark):
    lines = [("1" * 15 if y % 2 == 0 else ("0" * 14 + "1" if y % 4 == 1 else "1" + "0" * 14)) for y in range(21)]
    assert {r["label"] for r in objects.components(pixels(spark, lines), 15).collect()} == {1}


def test_morphology_and_pyramid(spark):
    dot = pixels(spark, ["00000", "00000", "00100", "00000", "00000"])
    assert picture(raster.dilate(dot), 5, 5) == ["00000", "01110", "01110", "01110", "00000"]
    assert picture(raster.dilate(dot, raster.cross(1)), 5, 5) == ["00000", "00100", "01110", "00100", "00000"]
    assert picture(raster.erode(raster.dilate(dot)), 5, 5) == picture(dot, 5, 5)
    assert picture(raster.pyramid_mode(pixels(spark, ["113", "223", "555"])), 2, 2) == ["23", "55"]
    assert picture(raster.pyramid_mean(pixels(spark, ["113", "223", "555"])), 2, 2) == ["13", "55"]


def test_region_shapes(spark):
    r = objects.properties(pixels(spark, ["0000", "0110", "0110", "0000"], "label")).first()
    assert (r["area"], r["y0"], r["x1"], r["cy"]) == (4, 1, 2, 1.5)
    assert r["major_axis"] == pytest.approx(4 * (1 / 4 + 1 / 12) ** 0.5) and r["eccentricity"] == pytest.approx(0)
    f = objects.feret(pixels(spark, ["111", "000"], "label"), 90).first()
    assert (f["feret_min"], f["feret_max"]) == pytest.approx((1, 3))


def test_as_of_takes_the_last_at_or_before(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("a", 9), ("b", 5)], "k string, t int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("a", 5, "z"), ("b", 6, "w")], "k string, t int, v string")
    got = {(r["k"], r["t"]): r["v"] for r in matching.as_of(left, right, ["k"], "t", "t", ["v"]).collect()}
    assert got == {("a", 1): None, ("a", 5): "z", ("a", 9): "z", ("b", 5): None}


def test_hinges(spark):
    rows = spark.createDataFrame([("odd", float(x)) for x in (1, 2, 3, 4, 5)] + [("even", float(x)) for x in (1, 2, 3, 4)] + [("one", 7.0)], "g string, x double")
    got = {r["g"]: r["x_iqr"] for r in tables.hinge_iqr(rows, ["g"], "x").collect()}
    assert got == {"odd": 3.0, "even": 2.0, "one": 0.0}


def test_neighbours_are_exact(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r["query"], r["rank"]): r["item"] for r in neighbours.nearest(rows.filter("vec_id < 9"), rows.repartition(4), 3).collect()}
    d = np.linalg.norm(x[:9, None] - x[None], axis=2)
    d[np.arange(9), np.arange(9)] = np.inf
    assert got == {(q, k + 1): int(np.argsort(d[q])[k]) for q in range(9) for k in range(3)}
    sigma = vectors.smooth_distances(neighbours.nearest(rows.filter("vec_id < 9"), rows, 8)).collect()
    for r in sigma:
        near = np.sort(d[r["query"]])[:8]
        assert np.exp(-np.maximum(near - r["rho"], 0) / r["sigma"]).sum() == pytest.approx(3, abs=1e-4)


def test_components_of_variance(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 4)) * [5, 2, 1, 0.1]
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "embedding array<double>").repartition(3)
    values, directions = vectors.principal_components(rows, 2)
    assert values == pytest.approx(np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1][:2])
    assert directions.shape == (4, 2)


def test_vector_lines_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a b.tif", 0.5, 10, -3, 1, 2)], "file string, corr double, pos_x long, pos_y long, grid_x long, grid_y long")
    stitching.write(rows, str(tmp_path / "v"))
    assert stitching.read(spark, str(tmp_path / "v")).collect() == rows.collect()


def test_predicates(spark):
    rows = spark.range(10).withColumn("s", F.when(F.col("id") % 2 == 0, "a").otherwise("b"))
    tree = {"OR": [{"AND": [{">=": {"id": 8}}, {"IN": {"s": ["a"]}}]}, {"NOT": {">": {"id": 0}}}]}
    assert [r["id"] for r in rows.filter(compile_predicate(tree)).collect()] == [0, 8]
    with pytest.raises(ValueError):
        compile_predicate({"LIKE": {"s": "a"}})


def test_streams_give_what_batches_give(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", "event_id", "user_id")
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    q = events.tumbling(stream, "1 day", ["event_type"], late="400 days").writeStream.outputMode("complete").format("memory").queryName("tumbled").start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r["window_start"], r["event_type"])
    batch = {key(r): r["n"] for r in events.tumbling(source, "1 day", ["event_type"]).collect()}
    assert {key(r): r["n"] for r in spark.table("tumbled").collect()} == batch


def test_neighbours_of_more_queries_than_a_block(spark):
    rows = spark.createDataFrame([(i, [float(i * i % 37), float(i % 11)]) for i in range(40)], "vec_id long, embedding array<double>")
    whole = sorted(neighbours.nearest(rows, rows, 3).collect())
    assert len(whole) == 120
    for most in (7, 8, 40):
        assert sorted(neighbours.nearest(rows, rows.repartition(3), 3, most_queries=most).collect()) == whole
