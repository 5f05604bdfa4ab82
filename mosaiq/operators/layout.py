"""Positions in few dimensions for the vertices of a weighted neighbour graph, by sampled steps along its edges."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.operators.iteration import saved
from mosaiq.operators.ranks import ranked
from mosaiq.operators.skew import HOT


@dataclass(frozen=True)
class Layout:
    dimensions: int = 2
    epochs: int = 100
    #: Vertices that each drawn edge's first end is pushed away from.
    negatives: int = 5
    #: Shape of the attraction, 1 / (1 + a d ** (2 b)): for a least distance of 0.1.
    a: float = 1.577
    b: float = 0.895
    rate: float = 1.0
    #: Most that one edge, and all of an epoch, move a vertex along one axis.
    most: float = 4.0
    #: Vertices start within this far of the middle.
    start: float = 10.0


def _even(*what: Column | str) -> Column:
    """A number from 0 to 1 by hash."""
    return F.pmod(F.xxhash64(*what), F.lit(1 << 30)) / float(1 << 30)


def _at(how: Layout, name: str) -> list[str]:
    return [f"{name}{k}" for k in range(how.dimensions)]


def started(edges: DataFrame, how: Layout = Layout()) -> DataFrame:
    """``v, rank, p0, p1 ...``: the vertices numbered from 0, each at a place by its hash."""
    ends = edges.select(F.col("query").alias("v")).unionByName(edges.select(F.col("item").alias("v"))).distinct()
    place = [((2 * _even("v", F.lit(k)) - 1) * how.start).alias(c) for k, c in enumerate(_at(how, "p"))]
    return saved(ranked(ends, ["v"]).select("v", "rank", *place))


def _summed(values: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, values)


def _steps(met: DataFrame, how: Layout) -> DataFrame:
    """``rank, s0, s1 ...``: what moves vertices of ``other, rank, near, p0 ..., q0 ...``, as ``near`` ones pull each other and the others
    push the first of two."""
    bounded = lambda x: F.greatest(F.lit(-how.most), F.least(F.lit(how.most), x))
    apart = {d: F.col(p) - F.col(q) for d, p, q in zip(_at(how, "d"), _at(how, "p"), _at(how, "q"), strict=True)}
    d2 = F.col("d2")
    pull = -2 * how.a * how.b * F.pow(d2, how.b - 1) / (1 + how.a * F.pow(d2, how.b))
    push = 2 * how.b / ((0.001 + d2) * (1 + how.a * F.pow(d2, how.b)))
    met = met.select("rank", "other", "near", *[x.alias(d) for d, x in apart.items()]).withColumn("d2", F.lit(0.0) + _summed([F.col(d) * F.col(d) for d in apart]))
    met = met.withColumn("g", F.when(d2 > 0, F.when(F.col("near"), pull).otherwise(push)).otherwise(0.0))
    met = met.select("rank", "other", "near", *[bounded(F.col("g") * F.col(d)).alias(s) for d, s in zip(apart, _at(how, "s"), strict=True)])
    both = lambda sign, rank: F.struct(F.col(rank).alias("rank"), *[(sign * F.col(s)).alias(s) for s in _at(how, "s")])
    return met.select(F.inline(F.when(F.col("near"), F.array(both(1, "rank"), both(-1, "other"))).otherwise(F.array(both(1, "rank")))))


def laid_out(edges: DataFrame, how: Layout = Layout()) -> DataFrame:
    """``v, at`` for every vertex of ``query, item, weight`` (each edge both ways).

    In an epoch an edge is drawn as often as its share of the greatest weight says; its ends are pulled together and its first end is
    pushed away from vertices drawn by hash.  All vertices move at once by the sum of what pulls and pushes them, the less the later the
    epoch.  The positions are a table that each epoch writes anew.  A drawn edge takes its first end's position to its item and to the
    vertices drawn for it in one join; vertices that very many edges end at meet them by a broadcast of fewer than HOT rows.  The
    result depends on nothing but the edges."""
    edges = saved(edges.select("query", "item", "weight"))
    places = started(edges, how)
    n = places.count()
    total, most = edges.agg(F.count(F.lit(1)), F.max("weight")).first()
    hot = saved(edges.groupBy("item").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max(1, total // HOT)).select("item"))
    any_hot = not hot.isEmpty()
    numbered = [places.select(F.col("v").alias(c), F.col("rank").alias(r)) for c, r in (("query", "rank"), ("item", "other"))]
    # items last, as many edges may end at one
    edges = saved(edges.join(numbered[0], "query"))
    often = edges.join(F.broadcast(hot), "item", "left_semi").join(F.broadcast(numbered[1].join(F.broadcast(hot), "item", "left_semi")), "item")
    seldom = edges.join(F.broadcast(hot), "item", "left_anti").join(numbered[1], "item")
    both = seldom.withColumn("hot", F.lit(False))
    both = both.unionByName(often.withColumn("hot", F.lit(True))) if any_hot else both
    edges = saved(both.select("rank", "other", "query", "item", "hot", (F.col("weight") / F.lit(most or 1.0)).alias("share")))
    far = F.transform(F.sequence(F.lit(1), F.lit(how.negatives)), lambda j: F.pmod(F.xxhash64(F.col("query"), F.col("item"), F.col("epoch"), j), F.lit(max(n, 1))))
    to = lambda other, near: F.struct(other.alias("other"), F.lit(near).alias("near"))
    away = F.transform("far", lambda r: to(r, False))
    for epoch in range(how.epochs):
        drawn = edges.filter(F.floor(F.col("share") * (epoch + 1)) > F.floor(F.col("share") * epoch))
        drawn = drawn.join(places.drop("v"), "rank").withColumn("epoch", F.lit(epoch)).withColumn("far", far)
        there = places.select(F.col("rank").alias("other"), *[F.col(p).alias(q) for p, q in zip(_at(how, "p"), _at(how, "q"), strict=True)])
        ends = F.when(F.col("hot"), away).otherwise(F.concat(F.array(to(F.col("other"), True)), away)) if any_hot else F.concat(F.array(to(F.col("other"), True)), away)
        met = drawn.select("rank", F.inline(ends), *_at(how, "p")).filter("near or other <> rank").join(there, "other")
        if any_hot:
            held = there.join(F.broadcast(edges.filter("hot").select("other").distinct()), "other", "left_semi")
            met = met.unionByName(drawn.filter("hot").select("rank", "other", F.lit(True).alias("near"), *_at(how, "p")).join(F.broadcast(held), "other"))
        bounded = lambda x: F.greatest(F.lit(-how.most), F.least(F.lit(how.most), x))
        moves = _steps(met, how).groupBy("rank").agg(*[bounded(F.sum(s)).alias(s) for s in _at(how, "s")])
        rate = how.rate * (1 - epoch / how.epochs)
        moved = [F.when(F.col(s).isNull(), F.col(p)).otherwise(F.col(p) + rate * F.col(s)).alias(p) for p, s in zip(_at(how, "p"), _at(how, "s"), strict=True)]
        places = saved(places.join(moves, "rank", "left").select("v", "rank", *moved))
    return places.select("v", F.array(*_at(how, "p")).alias("at"))
