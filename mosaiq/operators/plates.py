"""Plates of wells in images: how they lie, and where their wells are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.operators import objects, tables, thresholds
from mosaiq.operators.iteration import saved
from mosaiq.operators.raster import AT

#: Rows and columns of plates by their number of wells. Fixed values.
LAYOUTS = {6: (2, 3), 12: (3, 4), 24: (4, 6), 48: (6, 8), 96: (8, 12), 384: (16, 24), 1536: (32, 48)}
#: Thresholds in the order in which they are tried.
METHODS = (thresholds.otsu, thresholds.li, thresholds.isodata)


def rotated(pixels: DataFrame, angles: DataFrame, height: int, width: int) -> DataFrame:
    """Dense images turned counterclockwise about their middles by ``image, degrees``: each pixel between the four around where it
    comes from, 0 beyond the edges."""
    t = F.radians("degrees")
    y, x = F.col("y") - (height - 1) / 2, F.col("x") - (width - 1) / 2
    sy, sx = F.round(x * F.sin(t) + y * F.cos(t) + (height - 1) / 2, 9), F.round(x * F.cos(t) - y * F.sin(t) + (width - 1) / 2, 9)
    out = pixels.join(F.broadcast(angles) if angles.count() <= 10_000 else angles, "image").select(*AT, sy.alias("sy"), sx.alias("sx"))
    part = lambda c: F.col(c) - F.floor(c)
    corners = [F.struct((F.floor("sy") + i).alias("y"), (F.floor("sx") + j).alias("x"), ((part("sy") if i else 1 - part("sy")) * (part("sx") if j else 1 - part("sx"))).alias("w")) for i in (0, 1) for j in (0, 1)]
    each = out.select("image", F.col("y").alias("oy"), F.col("x").alias("ox"), F.explode(F.array(*corners)).alias("c"))
    each = each.select("image", "oy", "ox", F.col("c.y").alias("y"), F.col("c.x").alias("x"), "c.w")
    found = each.join(pixels.select(*AT, "v"), AT, "left").groupBy("image", "oy", "ox").agg(F.sum(F.col("w") * F.coalesce("v", F.lit(0))).alias("v"))
    return found.select("image", F.col("oy").alias("y"), F.col("ox").alias("x"), "v")


def wells(mask: DataFrame, width: int) -> DataFrame:
    """``image, label, cy, cx, radius`` of each part of a mask: the middle of its box and the radius of a disk of its area."""
    parts = objects.components(mask, width, connectivity=2).groupBy("image", "label")
    box = parts.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{k}_{c}") for k, f in (("low", F.min), ("high", F.max)) for c in ("y", "x")])
    middle = lambda c: ((F.col(f"low_{c}") + F.col(f"high_{c}") + 1) / 2).alias(f"c{c}")
    return box.select("image", "label", middle("y"), middle("x"), F.sqrt(F.col("n") / F.pi()).alias("radius"))


def turns(found: DataFrame) -> DataFrame:
    """``image, degrees``: the turn after which the middles spread least from top to bottom, from -89 to 90; of equals the first of 0
    to 179."""
    t = F.radians(F.col("a"))
    across = F.col("cy") * F.cos(t) - F.col("cx") * F.sin(t)
    each = found.select("image", "cy", "cx", F.explode(F.sequence(F.lit(0), F.lit(179))).alias("a")).groupBy("image", "a").agg(F.round(F.max(across) - F.min(across), 9).alias("s"))
    best = each.groupBy("image").agg(F.min(F.struct("s", "a")).alias("b")).select("image", F.col("b.a").alias("a"))
    return best.select("image", F.when(F.col("a") > 90, F.col("a") - 180).otherwise(F.col("a")).alias("degrees"))


def plates(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """``image, degrees, size, radius, roi_radius, y0, y1, x0, x1, rows, columns`` of each dense image with a known layout.

    Thresholds are tried in turn until as many wells are there as a layout has, give or take a twentieth.  The image is turned so that
    the plate lies flat, wells whose middles are within a radius share a row or column, and an image whose rows or columns are not
    those of the layout is left out, as is one in which no threshold finds a layout."""
    left, found = saved(pixels), []
    known = reduce(lambda c, n: c.when(F.abs(1 - F.col("n") / n) < 0.05, n), LAYOUTS, F)
    for method in METHODS:
        cut = saved(method(thresholds.histogram(left)))
        angles = saved(turns(wells(thresholds.apply(left, cut), width)))
        flat = saved(rotated(left, angles, height, width))
        there = saved(wells(thresholds.apply(flat, cut), width))
        size = there.groupBy("image").agg(F.count(F.lit(1)).alias("n")).select("image", known.alias("size")).filter("size is not null")
        ok = saved(size.join(angles, "image"))
        found.append(there.join(ok, "image"))
        left = saved(left.join(ok.select("image"), "image", "left_anti"))
    every = saved(reduce(DataFrame.unionByName, found))
    radius = F.floor(F.avg("radius")).cast("long")
    whole = every.groupBy("image", "size", "degrees").agg(radius.alias("radius"), *[f(c).alias(f"{k}_{c}") for k, f in (("low", F.min), ("high", F.max)) for c in ("cy", "cx")])
    lines = {}
    for c, name in (("cy", "rows"), ("cx", "columns")):
        merged = tables.merged_within(every.join(whole.select("image", F.col("radius").alias("within")), "image"), ["image"], c, "within")
        lines[name] = merged.groupBy("image").agg(F.array_sort(F.collect_list(F.floor("position").cast("long"))).alias(name))
    out = whole.join(lines["rows"], "image").join(lines["columns"], "image")
    n_rows, n_columns = (reduce(lambda c, n, k=k: c.when(F.col("size") == n, LAYOUTS[n][k]), LAYOUTS, F) for k in (0, 1))
    out = out.filter((F.size("rows") == n_rows) & (F.size("columns") == n_columns))
    step = lambda c: F.get(c, F.lit(1)) - F.get(c, F.lit(0))
    edge = lambda c, sign: F.floor(F.col(c) + sign * 2 * F.col("radius")).cast("long")
    return out.select("image", "degrees", "size", "radius", F.floor(F.least(step("rows"), step("columns")) / 2).cast("long").alias("roi_radius"), edge("low_cy", -1).alias("y0"), edge("high_cy", 1).alias("y1"), edge("low_cx", -1).alias("x0"), edge("high_cx", 1).alias("x1"), "rows", "columns")
