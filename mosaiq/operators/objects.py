"""Objects in label rasters ``image, y, x, label`` (0 is background)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.operators import tables
from mosaiq.operators.iteration import by_rows, written


def runs(mask: DataFrame) -> DataFrame:
    """Foreground runs along rows: ``image, y, x0, x1``."""
    island = F.col("x") - F.row_number().over(Window.partitionBy("image", "y").orderBy("x"))
    return mask.filter("v > 0").withColumn("i", island).groupBy("image", "y", "i").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("i")


def components(mask: DataFrame, width: int, connectivity: int = 1, rounds: int = 60) -> DataFrame:
    """Label of every foreground pixel: the first pixel of its component, row by row, counted from 1.

    Runs are joined with overlapping runs of the next row (with ``connectivity`` 2 diagonal ones too); the least run of each
    component is found over these few edges by large-star and small-star steps, which need few rounds however long a
    component is.  Nothing is returned that has not settled.
    """
    reach = connectivity - 1
    r = written(runs(mask).withColumn("id", F.col("y") * width + F.col("x0") + 1))
    if not r.filter((F.col("x0") < 0) | (F.col("x1") >= width)).isEmpty():
        raise ValueError(f"the raster is wider than {width}")
    below = r.select("image", (F.col("y") - 1).alias("y"), F.col("x0").alias("b0"), F.col("x1").alias("b1"), F.col("id").alias("v"))
    touch = r.join(by_rows(below), ["image", "y"]).filter((F.col("b0") <= F.col("x1") + reach) & (F.col("b1") >= F.col("x0") - reach))
    labels = least_linked(touch.select("image", F.col("id").alias("u"), "v"), rounds)
    placed = r.join(by_rows(labels.select("image", F.col("node").alias("id"), "least")), ["image", "id"], "left")
    return placed.select("image", "y", F.explode(F.sequence("x0", "x1")).alias("x"), F.coalesce("least", "id").alias("label"))


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Ties every larger neighbour of a node to the least node near it, or every smaller neighbour and the node itself."""
    if larger:
        both = edges.unionByName(edges.select("image", F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select("image", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("image", "u").agg(F.min("v").alias("m")).select("image", "u", F.least("u", "m").alias("m"))
    tied = both.join(by_rows(least), ["image", "u"])
    if larger:
        out = tied.filter("v > u").select("image", F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select("image", F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("image", "u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def least_linked(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``image, node, least`` of every node that has an edge ``u``, ``v``: the least node that it is tied to."""
    edges = written(edges.select("image", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    for _ in range(rounds):
        ends = edges.select("image", F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("below")).unionByName(edges.select("image", F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("below")))
        if ends.groupBy("image", "n").agg(F.sum("up").alias("up"), F.max("below").alias("below")).filter("up > 1 or (up = 1 and below = 1)").isEmpty():
            tops = edges.select("image", F.col("v").alias("node"), F.col("v").alias("least")).distinct()
            return edges.select("image", F.col("u").alias("node"), F.col("v").alias("least")).unionByName(tops)
        edges = written(_star(_star(edges, True), False))
    raise RuntimeError(f"components did not settle within {rounds} rounds")


def relabel(labels: DataFrame) -> DataFrame:
    """Labels 1, 2, 3 ... in order: distinct labels are numbered, then joined back."""
    distinct = labels.filter("label > 0").select("image", "label").distinct()
    numbered = distinct.withColumn("new", F.dense_rank().over(Window.partitionBy("image").orderBy("label")).cast("long"))
    return labels.join(numbered, ["image", "label"]).select("image", "y", "x", F.col("new").alias("label"))


def sizes(labels: DataFrame) -> DataFrame:
    return labels.filter("label > 0").groupBy("image", "label").agg(F.count(F.lit(1)).alias("area"))


def remove_by_size(labels: DataFrame, least: int = 0, most: int | None = None) -> DataFrame:
    """Pixels of objects whose area lies within the bounds."""
    ok = sizes(labels).filter((F.col("area") >= least) & (F.lit(True) if most is None else F.col("area") <= most))
    return labels.join(ok.drop("area"), ["image", "label"], "left_semi").select("image", "y", "x", "label")


def clear_border(labels: DataFrame, height: int, width: int) -> DataFrame:
    """Pixels of objects that do not touch an edge of their image."""
    edge = labels.filter(f"y = 0 or x = 0 or y = {height - 1} or x = {width - 1}").select("image", "label").distinct()
    return labels.filter("label > 0").join(edge, ["image", "label"], "left_anti").select("image", "y", "x", "label")


def properties(labels: DataFrame) -> DataFrame:
    """Area, bounding box, centroid, axes, eccentricity and equivalent diameter of every object."""
    m = labels.filter("label > 0").groupBy("image", "label").agg(F.count(F.lit(1)).alias("area"), F.min("y").alias("y0"), F.min("x").alias("x0"), F.max("y").alias("y1"), F.max("x").alias("x1"), F.avg("y").alias("cy"), F.avg("x").alias("cx"), (F.var_pop("y") + 1 / 12).alias("vy"), (F.var_pop("x") + 1 / 12).alias("vx"), F.covar_pop("y", "x").alias("cv"))
    root = F.sqrt((F.col("vy") - F.col("vx")) * (F.col("vy") - F.col("vx")) + 4 * F.col("cv") * F.col("cv"))
    m = m.withColumns({"l1": (F.col("vy") + F.col("vx") + root) / 2, "l2": F.greatest(F.lit(0.0), (F.col("vy") + F.col("vx") - root) / 2)})
    return m.select("image", "label", "area", "y0", "x0", "y1", "x1", "cy", "cx", (4 * F.sqrt("l1")).alias("major_axis"), (4 * F.sqrt("l2")).alias("minor_axis"), F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("l2") / F.col("l1"))).alias("eccentricity"), F.sqrt(4 * F.col("area") / F.pi()).alias("equivalent_diameter"))


def intensities(labels: DataFrame, pixels: DataFrame) -> DataFrame:
    """Mean, extremes, median, spread, skewness, kurtosis (3 for a normal one), entropy (bits) and mode (the least of equal
    ones) of each object's values; both moments are 0 where all values are equal."""
    both = labels.filter("label > 0").join(pixels, ["image", "y", "x"])
    first = both.groupBy("image", "label").agg(F.avg("v").alias("mean"), F.min("v").alias("least"), F.max("v").alias("greatest"), F.stddev_pop("v").alias("std"), F.skewness("v").alias("skewness"), F.kurtosis("v").alias("kurtosis"))
    middle = tables.quantile(both, ["image", "label"], "v", {"median": 0.5})
    counts = both.groupBy("image", "label", "v").agg(F.count(F.lit(1)).alias("n"))
    entropy = counts.groupBy("image", "label").agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("entropy"))
    mode = counts.groupBy("image", "label").agg(F.max(F.struct("n", (-F.col("v")).alias("k")))["k"].alias("k")).select("image", "label", (-F.col("k")).alias("mode"))
    even = F.col("std") > 0
    out = first.join(middle, ["image", "label"]).join(entropy, ["image", "label"]).join(mode, ["image", "label"])
    return out.withColumns({"skewness": F.when(even, F.col("skewness")).otherwise(0.0), "kurtosis": F.when(even, F.col("kurtosis") + 3).otherwise(0.0)})


def neighbours(labels: DataFrame, distance: int) -> DataFrame:
    """How many other objects have a pixel within ``distance`` rows and columns."""
    near = F.explode(F.expr(f"flatten(transform(sequence(-{distance}, {distance}), a -> transform(sequence(-{distance}, {distance}), b -> struct(a as dy, b as dx))))"))
    moved = labels.filter("label > 0").select("image", "y", "x", "label", near.alias("o")).select("image", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), "label").distinct()
    pairs = moved.join(labels.withColumnRenamed("label", "other"), ["image", "y", "x"]).filter("other > 0 and other <> label").select("image", "label", "other").distinct()
    found = pairs.groupBy("image", "label").agg(F.count(F.lit(1)).alias("n"))
    return sizes(labels).join(found, ["image", "label"], "left").select("image", "label", F.coalesce("n", F.lit(0)).alias("neighbours"))


def feret(labels: DataFrame, step: int = 1) -> DataFrame:
    """Least and greatest width of each object over directions ``step`` degrees apart, pixels taken as squares."""
    degrees = F.explode(F.sequence(F.lit(step), F.lit(180), F.lit(step))).alias("a")
    # the ends of an object's runs along a row are all that can be extreme
    ends = labels.filter("label > 0").groupBy("image", "label", "y").agg(F.min("x").alias("a0"), F.max("x").alias("a1")).select("image", "label", "y", F.explode(F.array_distinct(F.array("a0", "a1"))).alias("x"))
    t = F.radians(F.col("a"))
    width = F.max(F.col("x") * F.cos(t) + F.col("y") * F.sin(t)) - F.min(F.col("x") * F.cos(t) + F.col("y") * F.sin(t))
    each = ends.select("image", "label", "y", "x", degrees).groupBy("image", "label", "a").agg((width + F.abs(F.cos(F.first(t))) + F.abs(F.sin(F.first(t)))).alias("w"))
    return each.groupBy("image", "label").agg(F.min("w").alias("feret_min"), F.max("w").alias("feret_max"))


def orientation(labels: DataFrame) -> DataFrame:
    """``image, label, degrees``: the angle of each object's longer axis, from its second moments; 0 where they are round."""
    m = labels.filter("label > 0").groupBy("image", "label").agg(*[(f * F.count(F.lit(1))).alias(k) for k, f in (("uyy", F.var_pop("x")), ("uxx", F.var_pop("y")), ("uxy", F.covar_pop("y", "x")))])
    m = m.withColumns({k: F.round(k, 9) for k in ("uyy", "uxx", "uxy")})
    root = F.sqrt((F.col("uyy") - F.col("uxx")) * (F.col("uyy") - F.col("uxx")) + 4 * F.col("uxy") * F.col("uxy"))
    steep = F.col("uyy") > F.col("uxx")
    top = F.when(steep, F.col("uyy") - F.col("uxx") + root).otherwise(2 * F.col("uxy"))
    bottom = F.when(steep, 2 * F.col("uxy")).otherwise(F.col("uxx") - F.col("uyy") + root)
    angle = F.when((top == 0) & (bottom == 0), 0.0).when(bottom == 0, -90.0).otherwise(-F.degrees(F.atan(top / F.when(bottom != 0, bottom))))
    return m.select("image", "label", angle.alias("degrees"))


def _beside(labels: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Each pixel of an object and the offsets at which the same object goes on."""
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets])
    return labels.filter("label > 0").select("image", "label", "y", "x", F.explode(steps).alias("o")).select("image", "label", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), (-F.col("o.dy")).alias("dy"), (-F.col("o.dx")).alias("dx"))


def perimeter(labels: DataFrame) -> DataFrame:
    """``image, label, perimeter``: border pixels weighted by how the border goes on: 1 straight on, the root of 2 across,
    half of both where it turns."""
    place = ["image", "label", "y", "x"]
    own = labels.filter("label > 0").select(*place)
    around = _beside(labels, [(-1, 0), (1, 0), (0, -1), (0, 1)]).join(own, place, "left_semi").groupBy(*place).agg(F.count(F.lit(1)).alias("n"))
    border = own.join(around.filter("n = 4"), place, "left_anti")
    near = _beside(border, [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]).join(border, place, "left_semi")
    weight = F.when(F.abs("dy") + F.abs("dx") == 1, 2).otherwise(10)
    code = border.join(near.groupBy(*place).agg(F.sum(weight).alias("c")), place, "left").select(*place, (1 + F.coalesce("c", F.lit(0))).alias("c"))
    root = 2.0**0.5
    length = F.when(F.col("c").isin(5, 7, 15, 17, 25, 27), 1.0).when(F.col("c").isin(21, 33), root).when(F.col("c").isin(13, 23), (1 + root) / 2).otherwise(0.0)
    return code.groupBy("image", "label").agg(F.sum(length).alias("perimeter"))


def euler(labels: DataFrame) -> DataFrame:
    """``image, label, euler``: parts less holes of each object (diagonal neighbours tied), from its 2 x 2 windows."""
    corners = _beside(labels, [(0, 0), (0, 1), (1, 0), (1, 1)]).groupBy("image", "label", "y", "x").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("dy") + F.col("dx")).alias("s"), F.max(F.abs(F.col("dy") - F.col("dx"))).alias("apart"), F.min(F.abs(F.col("dy") - F.col("dx"))).alias("least"))
    one, three = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 3)
    across = F.count_if((F.col("n") == 2) & ((F.col("least") == 1) & (F.col("s") == -2) | (F.col("apart") == 0)))
    return corners.groupBy("image", "label").agg(((one - three - 2 * across) / 4).cast("long").alias("euler"))

