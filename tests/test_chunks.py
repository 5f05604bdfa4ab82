"""Chunks are written once, whole, or not at all, and read back."""

import json
import os

import numpy as np
import pytest

from mosaiq.sources import chunks


def pixels(spark, shape=(11, 14)):
    r = np.random.default_rng(2)
    rows = [(name, int(y), int(x), int(v)) for name in ("a b/c", "é%20", "z") for (y, x), v in np.ndenumerate(r.integers(-9, 10**12, shape))]
    return spark.createDataFrame(rows, "image string, y long, x long, v long")


def files(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if not f.endswith(".crc"))


def test_round_trip(spark, tmp_path):
    path, table = f"{tmp_path}/out", pixels(spark)
    chunks.write_chunks(chunks.chunked(table, 4).unionByName(chunks.chunked(table.filter("y < 5 and x < 6"), 4, level=1)), path, 4)
    key = lambda r: tuple(r)
    got = sorted(map(key, chunks.read_chunks(spark, path).collect()))
    want = [(r.image, 0, r.y, r.x, r.v) for r in table.collect()] + [(r.image, 1, r.y, r.x, r.v) for r in table.filter("y < 5 and x < 6").collect()]
    assert got == sorted(want)
    found = files(path)
    assert len([f for f in found if "/0/" in f and "." not in f.split("/")[-1][:1]]) == 3 * 12
    assert json.load(open(f"{path}/z/0/.zarray"))["shape"] == [11, 14] and os.listdir(tmp_path) == ["out"]
    with pytest.raises(Exception, match="FileExists"):
        chunks.write_chunks(chunks.chunked(table, 4), path, 4)
    assert files(path) == found and os.listdir(tmp_path) == ["out"]
    chunks.write_chunks(chunks.chunked(table.filter("image = 'z'"), 8), path, 8, overwrite=True)
    assert chunks.read_chunks(spark, path).count() == 11 * 14


def test_a_task_that_runs_again_leaves_one_chunk(spark, tmp_path):
    rows = chunks.chunked(pixels(spark), 4).collect()
    writer = chunks.ChunkWriter(f"{tmp_path}/out", 4, False)

    def fails():
        yield from rows[:5]
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(fails())
    assert not os.path.exists(f"{tmp_path}/out")
    writer.commit([writer.write(iter(rows)), None])
    assert len([f for f in files(f"{tmp_path}/out") if "_" not in f and f.count(".") == 1 and not f.split("/")[-1].startswith(".")]) == len(rows)
    assert chunks.read_chunks(spark, f"{tmp_path}/out").count() == 3 * 11 * 14


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    bad = chunks.chunked(pixels(spark), 4).withColumn("data", F.when(F.col("cx") == 3, F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("data")))
    with pytest.raises(Exception, match="lost"):
        chunks.write_chunks(bad, f"{tmp_path}/out", 4)
    assert os.listdir(tmp_path) == []
