"""A layout keeps neighbours together and does not depend on how its edges are spread."""

import numpy as np

from mosaiq.operators import layout, neighbours


def test_groups_stay_together_and_the_result_is_the_same_again(spark):
    r = np.random.default_rng(3)
    x = np.vstack([r.normal(c, 1, (30, 8)) for c in (0, 12, 24)])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    near = neighbours.nearest(rows, rows, 8)
    from pyspark.sql import functions as F

    one = near.select("query", "item", (1 / F.col("rank")).alias("weight"))
    edges = one.unionByName(one.select(F.col("item").alias("query"), F.col("query").alias("item"), "weight")).groupBy("query", "item").agg(F.max("weight").alias("weight")).cache()
    how = layout.Layout(epochs=30, start=5.0)
    got = {p.v: p.at for p in layout.laid_out(edges, how).collect()}
    at = np.array([got[i] for i in range(90)])
    d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    same = [np.mean(np.argsort(d[i])[:8] // 30 == i // 30) for i in range(90)]
    assert np.mean(same) > 0.95
    few = layout.Layout(epochs=2)
    a, b = ({p.v: p.at for p in layout.laid_out(e, few).collect()} for e in (edges, edges.repartition(7)))
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-9) for k in a)
    assert layout.laid_out(edges.limit(0), few).count() == 0
