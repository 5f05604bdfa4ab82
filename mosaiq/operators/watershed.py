"""Distances to the background and seeded watersheds of rasters ``image, y, x, v``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.operators import objects
from mosaiq.operators.iteration import saved
from mosaiq.operators.raster import AT

#: Neighbours in one direction each: beside and below; and also across.
EDGES = {1: [(0, 1), (1, 0)], 2: [(0, 1), (1, 0), (1, 1), (1, -1)]}


def lower_envelope(heights: np.ndarray) -> np.ndarray:
    """For each place q the least ``(q - p)**2 + heights[p]``, by the parabolas that are lowest somewhere."""
    known = np.flatnonzero(np.isfinite(heights))
    if not len(known):
        return heights
    lowest, begins = [int(known[0])], [-np.inf]
    for q in known[1:].tolist():
        while True:
            p = lowest[-1]
            at = ((heights[q] + q * q) - (heights[p] + p * p)) / (2 * (q - p))
            if at > begins[-1]:
                break
            lowest.pop()
            begins.pop()
        lowest.append(q)
        begins.append(at)
    places = np.arange(len(heights))
    p = np.array(lowest)[np.searchsorted(begins, places, side="right") - 1]
    return (places - p) ** 2 + heights[p]


def squared_distance(mask: DataFrame) -> DataFrame:
    """``image, y, x, d2``: the squared distance of every pixel of a dense mask to the nearest pixel that is 0; null where its
    image has none.

    Along columns by windows that remember the last background pixel, then along rows by the lower envelope of parabolas; a task
    has one row of an image at a time."""
    down = Window.partitionBy("image", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy("image", "x").orderBy("y").rowsBetween(0, Window.unboundedFollowing)
    empty = F.when(F.col("v") == 0, F.col("y"))
    near = F.least(F.col("y") - F.last(empty, ignorenulls=True).over(down), F.first(empty, ignorenulls=True).over(up) - F.col("y"))
    rows = mask.select(*AT, near.cast("double").alias("g")).groupBy("image", "y").agg(F.array_sort(F.collect_list(F.struct("x", "g"))).alias("a"))
    rows = rows.select("image", "y", F.transform("a", lambda p: p["x"]).alias("x"), F.transform("a", lambda p: p["g"]).alias("g"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for x, g in zip(frame["x"], frame["g"], strict=True):
                heights = np.full(int(x[-1] - x[0]) + 1, np.inf)
                heights[x - x[0]] = np.where(np.isnan(g), np.inf, g * g)
                found.append(lower_envelope(heights)[x - x[0]])
            yield frame[["image", "y", "x"]].assign(d2=pd.Series(found, frame.index, object))

    kind = mask.schema["image"].dataType.simpleString()
    out = rows.mapInPandas(run, f"image {kind}, y long, x array<long>, d2 array<double>")
    out = out.select("image", "y", F.inline(F.arrays_zip("x", "d2")))
    return out.select(*AT, F.when(F.col("d2") < float("inf"), F.col("d2")).cast("long").alias("d2"))


def peaks(distances: DataFrame, width: int, radius: int = 1) -> DataFrame:
    """``image, y, x, label``: plateaus that nothing within ``radius`` rows and columns is above, labelled by their first pixel."""
    across = Window.partitionBy("image", "y").orderBy("x").rangeBetween(-radius, radius)
    down = Window.partitionBy("image", "x").orderBy("y").rangeBetween(-radius, radius)
    top = distances.withColumn("m", F.max("d2").over(across)).withColumn("m", F.max("m").over(down))
    return objects.components(top.select(*AT, ((F.col("d2") > 0) & (F.col("d2") == F.col("m"))).cast("long").alias("v")), width, connectivity=2)


def _led(best: DataFrame, rounds: int = 60) -> DataFrame:
    """``image, node, least``: where each part ``a`` comes by going on along its one edge to ``b``: to a part that has none, or to the
    lesser of two that have the same edge.  Each learns where it comes in 1, 2, 4, ... steps."""
    back = best.select("image", F.col("a").alias("b"), F.col("b").alias("c"))
    both = best.join(back, ["image", "b"], "left")
    to = saved(both.select("image", F.col("a").alias("node"), F.when((F.col("c") == F.col("a")) & (F.col("a") < F.col("b")), F.col("a")).otherwise(F.col("b")).alias("least")))
    for _ in range(rounds):
        ahead = to.select("image", F.col("node").alias("least"), F.col("least").alias("further"))
        now = to.join(ahead, ["image", "least"], "left")
        to = saved(now.select("image", "node", F.coalesce("further", "least").alias("least"), F.coalesce(F.col("further") != F.col("least"), F.lit(False)).alias("moved")))
        if to.filter("moved").isEmpty():
            return to.drop("moved")
    raise RuntimeError(f"parts are tied in a row of more than 2 ** {rounds}")


def flood(heights: DataFrame, seeds: DataFrame, width: int, connectivity: int = 1, rounds: int = 60) -> DataFrame:
    """``image, y, x, label``: every pixel of ``heights`` (``h``; only pixels that may be flooded) goes to the seed (``label``) from which
    the least of the largest heights on the way reaches it.

    Two neighbours are tied at the larger of their heights, of equal ones at the lesser of the first pixel and then of the
    second, row by row; the seeds' forest of least edges in this order is what a flood by priority gives.  It grows by Borůvka's
    rounds: each part without a seed joins along its least edge out, so parts halve at least.  Pixels that no seed reaches are left
    out.  Seeds that touch stay apart."""
    at = (F.col("y") * width + F.col("x")).alias("p")
    pixels = saved(heights.select("image", at, "y", "x", F.col("h").cast("double").alias("h")))
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in EDGES[connectivity]])
    beside = pixels.select("image", "p", "h", "x", F.explode(steps).alias("o"), "y")
    beside = beside.filter((F.col("x") + F.col("o.dx")).between(0, width - 1)).select("image", "p", "h", ((F.col("y") + F.col("o.dy")) * width + F.col("x") + F.col("o.dx")).alias("q"))
    edges = beside.join(pixels.select("image", F.col("p").alias("q"), F.col("h").alias("k")), ["image", "q"])
    edges = saved(edges.select("image", F.struct(F.greatest("h", "k").alias("w"), F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi")).alias("e"), F.col("p").alias("a"), F.col("q").alias("b")))
    # a part is named by a negative number if it is a seed's (all pixels of a label are one part), else by a pixel
    named = seeds.select("image", at, (-F.col("label") - 1).alias("part")).groupBy("image", "p").agg(F.max("part").alias("part"))
    parts = saved(pixels.select("image", "p").join(named, ["image", "p"], "left").select("image", "p", F.coalesce("part", "p").alias("part")))
    for end in "ab":
        edges = edges.join(parts.select("image", F.col("p").alias(end), F.col("part").alias(f"{end}_")), ["image", end]).drop(end).withColumnRenamed(f"{end}_", end)
    edges = saved(edges.filter("a <> b and (a >= 0 or b >= 0)"))
    for _ in range(rounds):
        both = edges.select("image", "a", "b", "e").unionByName(edges.select("image", F.col("b").alias("a"), F.col("a").alias("b"), "e"))
        best = saved(both.filter("a >= 0").groupBy("image", "a").agg(F.min(F.struct("e", "b")).alias("m")).select("image", "a", F.col("m.b").alias("b")))
        if best.isEmpty():
            return parts.filter("part < 0").select("image", F.floor(F.col("p") / width).cast("long").alias("y"), (F.col("p") % width).alias("x"), (-F.col("part") - 1).alias("label"))
        # parts tied together: there is one seed at most
        moved = _led(best, rounds)
        parts = saved(parts.join(moved.withColumnRenamed("node", "part"), ["image", "part"], "left").select("image", "p", F.coalesce("least", "part").alias("part")))
        for end in "ab":
            edges = edges.join(moved.select("image", F.col("node").alias(end), "least"), ["image", end], "left").withColumn(end, F.coalesce("least", end)).drop("least")
        edges = saved(edges.filter("a <> b and (a >= 0 or b >= 0)"))
    raise RuntimeError(f"the flood did not settle within {rounds} rounds")


def split_touching(mask: DataFrame, width: int, radius: int = 1) -> DataFrame:
    """``image, y, x, label``: objects of a dense mask cut where they are narrow: seeds are the peaks of the distance to the background,
    and the negative distance is flooded from them."""
    distances = saved(squared_distance(mask))
    inside = distances.filter("d2 > 0")
    return flood(inside.select(*AT, (-F.col("d2")).alias("h")), peaks(distances, width, radius), width)
