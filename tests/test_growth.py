"""Steps whose work must not grow faster than their tables."""

import math
import tracemalloc
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mosaiq.operators import density, layout, matching, neighbours, thresholds, vectors
from mosaiq.plans import reshape as tables_in_pairs


def test_substrings_meet_without_a_broadcast(spark, tmp_path):
    texts = [(i, ["large ring", "small ring", "green bolt", "ngng", "g", None][i % 6]) for i in range(60)] + [(None, "odd ring")]
    names = ["ring", "g", "ng", "e r", "odd", "bolt", "none of them"]
    spark.createDataFrame([(n,) for n in names], "name string").write.parquet(f"{tmp_path}/names")
    spark.createDataFrame(texts, "k long, text string").write.parquet(f"{tmp_path}/texts")  # files tell how small they are
    got = matching.by_substring(spark.read.parquet(f"{tmp_path}/names"), spark.read.parquet(f"{tmp_path}/texts"), "name", "text", "k")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    hits = {n: [k for k, t in texts if t is not None and n in t] for n in names}
    assert {r["name"]: r["k"] for r in got.collect()} == {n: min((k for k in ks if k is not None), default=None) for n, ks in hits.items() if ks}


def test_centres_settle_however_many_rounds_it_takes(spark, monkeypatch):
    """Even points on a line, whose centres took more than 300 rounds."""
    seen = []
    monkeypatch.setattr(vectors.np, "allclose", lambda a, b, plain=np.allclose: seen.append(1) or plain(a, b))
    x = np.arange(10_000) / 10_000
    df = spark.range(len(x)).select(F.col("id").alias("vec_id"), F.array(F.col("id") / 10_000).alias("embedding")).coalesce(1)
    centres = np.array(vectors.k_means(df, 30))[:, 0]
    assert len(seen) > 300
    near = np.abs(x[:, None] - centres[None]).argmin(axis=1)
    assert np.abs(np.array([x[near == c].mean() for c in range(30)]) - centres).max() < 1e-4
    with pytest.raises(RuntimeError, match="did not settle"):
        vectors.k_means(df, 30, rounds=3)


def test_minimum_error_is_that_of_exact_fractions(spark):
    """One value alone above a candidate has no spread, however its sums are rounded."""
    hist = [("A", v, n) for v, n in [(0, 490), *[(v, 1 + v % 3) for v in range(262, 391, 2)], (394, 1), (397, 2)]]
    total, best = sum(n for *_, n in hist), []
    for cut in range(1, len(hist)):
        score = 1.0
        for part in (hist[:cut], hist[cut:]):
            n, s, q = (sum(c * v**k for _, v, c in part) for k in range(3))
            spread = Fraction(q, n) - Fraction(s, n) ** 2
            score += n / total * (math.log(spread) - 2 * math.log(n / total)) if spread else math.inf
        best.append((round(score, 9), hist[cut - 1][1]))
    got = thresholds.min_error(spark.createDataFrame(hist, "image string, v long, n long")).first()
    assert got["threshold"] == min(best)[1]


def test_only_pairs_that_can_be_nearest_are_measured(monkeypatch):
    """The nearest of each point and the least edges of components, as by all differences, from few of them."""
    seen = []
    monkeypatch.setattr(density, "_lengths", lambda a, b, plain=density._lengths: seen.append(len(a)) or plain(a, b))
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(2, 400, 64))
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    for i, near, weights in density._kth(a, b, np.arange(400), 5):
        order = np.argsort(d[i], kind="stable")[:6]
        assert np.array_equal(near, d[i, order]) and np.array_equal(weights, order)
    frames = [pd.DataFrame({"p": np.arange(400) + s, "v": list(x), "comp": np.arange(400) % 7 + c, "core": 0.0}) for x, s, c in ((a, 0, 0), (b, 400, 4))]
    got = density._least_out(*frames)
    comps = [f["comp"].to_numpy() for f in frames]
    open_ = np.where(comps[0][:, None] == comps[1][None], np.inf, d)
    for r in got.itertuples():
        want = min(open_[comps[0] == r.comp].min(initial=np.inf), open_[:, comps[1] == r.comp].min(initial=np.inf))
        assert r.w == want == d[r.lo, r.hi - 400]
    assert len(got) == 11 and sum(seen) < 0.05 * 2 * d.size


def test_pairs_of_many_groups_leave_a_task_piece_by_piece():
    """A batch of groups is not held as all of its pairs, and the pairs are those of all differences."""
    rng = np.random.default_rng(4)
    groups, size = 3000, 40
    x = rng.normal(size=(groups * size, 8)).astype(np.float32)
    fresh = np.tile(np.arange(size) % 3 == 0, groups)
    bound = np.where(np.arange(groups * size) % 5 > 0, np.inf, 4.0)
    rows = [pa.array(np.arange(groups * size)), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, 8, dtype=np.int32)), pa.array(x.ravel())), pa.array(fresh), pa.array(bound)]
    near = pa.ListArray.from_arrays(pa.array(np.arange(0, groups * size + 1, size, dtype=np.int32)), pa.StructArray.from_arrays(rows, ["c", "v", "fresh", "bound"]))
    tracemalloc.start()
    seen, first = 0, None
    for found in neighbours._joined(iter([pa.RecordBatch.from_arrays([near], ["near"])])):
        first = found.to_pandas() if first is None else first
        seen += found.num_rows
    assert tracemalloc.get_traced_memory()[1] < 25e6 < 24 * seen / 2
    tracemalloc.stop()
    d = np.sqrt(((x[:size, None].astype(float) - x[None, :size]) ** 2).sum(axis=2))
    want = {(i, j): d[i, j] for i in range(size) for j in range(size) if i != j and (fresh[i] or fresh[j]) and d[i, j] < bound[i]}
    got = first[first["query"] < size]
    assert {(r.query, r.item) for r in got[["query", "item"]].itertuples()} == set(want)
    assert all(abs(r.distance - want[r.query, r.item]) < 1e-9 for r in got.itertuples())


def test_pairs_of_few_keys_are_made_in_many_tasks(spark):
    """A table in one file was one task, which made all pairs."""
    got = tables_in_pairs.many_to_many_match(spark, "/root/testdata/sf0.001")
    made = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(made) > 4 and max(r["count"] for r in made) < got.count() / 4


def test_pairs_of_few_keys_take_few_bytes_where_they_are_written(spark, tmp_path):
    """Customers of all nations met all suppliers in turn, so each row took its own bytes; the pairs are all there, once."""
    nation = (F.col("id") % 5).alias
    spark.range(400).select(F.col("id").alias("c_custkey"), nation("c_nationkey")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(20_000).select(F.col("id").alias("s_suppkey"), nation("s_nationkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    got = tables_in_pairs.many_to_many_match(spark, str(tmp_path))
    assert got.filter("c_custkey % 5 <> s_suppkey % 5").isEmpty() and got.count() == 400 * 4000 == got.distinct().count()
    got = tables_in_pairs.many_to_many_match(spark, "/root/testdata/sf0.1")
    got.write.parquet(f"{tmp_path}/pairs")
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.5 * got.count()


def test_one_job_serves_many_rounds_of_centres(spark, monkeypatch):
    """Each round was a job; the centres are those of plain rounds over all rows."""
    rounds = []
    monkeypatch.setattr(vectors.np, "allclose", lambda a, b, plain=np.allclose: rounds.append(1) or plain(a, b))
    x = np.random.default_rng(4).normal(size=(20_000, 2))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    spark.sparkContext.setJobGroup("centres", "")
    starts = np.array([r[0] for r in df.select("embedding").orderBy(F.xxhash64("vec_id")).limit(64 * 4).collect()])
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("centres"))
    centres = np.array(vectors.k_means(df, 4))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("centres")) - before
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(rounds) > 30 and jobs < len(rounds) / 2
    chance, picked = np.random.default_rng(0), [0]
    while len(picked) < 4:
        far = ((starts[:, None] - starts[picked][None]) ** 2).sum(axis=2).min(axis=1)
        picked.append(int(chance.choice(len(starts), p=far / far.sum())))
    plain = starts[picked]
    for _ in rounds:
        near = ((x[:, None] - plain[None]) ** 2).sum(axis=2).argmin(axis=1)
        plain = np.array([x[near == c].mean(axis=0) for c in range(4)])
    assert np.abs(plain - centres).max() < 1e-9


def test_graph_of_all_rows_is_exact_in_parts(spark, monkeypatch):
    """Lists of descent lacked some neighbours and moved vectors in each round; equal vectors meet by their ids."""
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(700, 24)), np.repeat(rng.normal(size=(4, 24)), 40, axis=0) + 3, rng.normal(size=(60, 24)) * 1e-3 + 50]).astype(np.float32)
    ids = rng.permutation(5000)[: len(x)]
    rows = spark.createDataFrame([(int(i), v) for i, v in zip(ids, x.tolist(), strict=True)] + [(9999, [float("nan")] * 24)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(neighbours, "ROWS", 150)
    got = {}
    for r in neighbours.neighbour_graph(rows, 6).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append((r.item, r.distance))
    d = np.sqrt(((x[:, None].astype(float) - x[None].astype(float)) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    for i, q in enumerate(ids.tolist()):
        order = np.lexsort((ids, d[i]))[:6]
        assert [k for k, _ in got.pop(q)] == ids[order].tolist()
    assert not got


def test_descent_finds_nine_of_ten(spark):
    """The way beyond the rows that are met exactly."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    exact = neighbours.nearest(rows.filter("vec_id % 50 = 0"), rows, 5).select("query", "item")
    graph = neighbours.neighbour_graph(rows, 5, how=neighbours.Descent())
    assert exact.join(graph, ["query", "item"]).count() >= 0.9 * exact.count()


def test_edges_of_a_layout_are_made_once(spark):
    """They were made anew for the vertices, the greatest weight and the edges."""
    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    edges = spark.range(300).select(F.explode(F.array(F.struct(F.col("id").alias("query"), ((F.col("id") + 1) % 300).alias("item")), F.struct(((F.col("id") + 1) % 300).alias("query"), F.col("id").alias("item")))).alias("e")).select("e.query", "e.item", F.lit(1.0).alias("weight"))
    got = layout.laid_out(edges.mapInPandas(counted, edges.schema), layout.Layout(epochs=1))
    assert got.count() == 300 and seen.value == 600
