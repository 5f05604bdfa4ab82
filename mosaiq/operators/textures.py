"""Textures of objects: how grey levels lie beside each other, in runs and in zones.

``toned`` gives ``image, y, x, label, g``; all else sums counts of levels over its rows, and no object meets in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.operators import objects

OBJECT = ["image", "label"]
#: Directions in degrees, by rows and columns.
DIRECTIONS = {0: (0, 1), 45: (-1, 1), 90: (-1, 0), 135: (-1, -1)}


def toned(labels: DataFrame, pixels: DataFrame, levels: int) -> DataFrame:
    """Grey levels 1 to ``levels`` of the pixels of objects, in equal steps from each object's least value to its greatest; 1 where all
    are equal."""
    both = labels.filter("label > 0").join(pixels, ["image", "y", "x"]).select(*OBJECT, "y", "x", "v")
    ends = both.groupBy(*OBJECT).agg(F.min("v").alias("least"), F.max("v").alias("most"))
    step = F.floor((F.col("v") - F.col("least")) * levels / (F.col("most") - F.col("least"))) + 1
    g = F.when(F.col("most") > F.col("least"), F.least(step, F.lit(levels))).otherwise(1)
    return both.join(ends, OBJECT).select("image", "y", "x", "label", g.cast("long").alias("g"))


def pairs(tones: DataFrame, distance: int = 1) -> DataFrame:
    """``image, label, angle, i, j, n``: how often levels i and j are ``distance`` steps apart, counted both ways."""
    steps = F.array(*[F.struct(F.lit(a).alias("angle"), F.lit(dy * distance).alias("dy"), F.lit(dx * distance).alias("dx")) for a, (dy, dx) in DIRECTIONS.items()])
    moved = tones.select(*OBJECT, F.col("g").alias("j"), "y", "x", F.explode(steps).alias("o"))
    moved = moved.select(*OBJECT, "j", F.col("o.angle").alias("angle"), (F.col("y") - F.col("o.dy")).alias("y"), (F.col("x") - F.col("o.dx")).alias("x"))
    met = tones.select(*OBJECT, "y", "x", F.col("g").alias("i")).join(moved, [*OBJECT, "y", "x"])
    counts = met.groupBy(*OBJECT, "angle", "i", "j").agg(F.count(F.lit(1)).alias("n"))
    both = counts.unionByName(counts.select(*OBJECT, "angle", F.col("j").alias("i"), F.col("i").alias("j"), "n"))
    return both.groupBy(*OBJECT, "angle", "i", "j").agg(F.sum("n").alias("n"))


def cooccurrence(tones: DataFrame, distance: int = 1) -> DataFrame:
    """Contrast, dissimilarity, homogeneity, energy, entropy (bits) and correlation of each object and angle; correlation is 1 where
    there is one level."""
    p, i, j = F.col("n") / F.col("all"), F.col("i"), F.col("j")
    found = pairs(tones, distance)
    total = found.groupBy(*OBJECT, "angle").agg(F.sum("n").alias("all"))
    sums = {
        "contrast": (i - j) * (i - j) * p,
        "dissimilarity": F.abs(i - j) * p,
        "homogeneity": p / (1 + (i - j) * (i - j)),
        "energy": p * p,
        "entropy": -p * F.log2(p),
        "mean": i * p,
        "square": i * i * p,
        "product": i * j * p,
    }
    each = found.join(total, [*OBJECT, "angle"]).groupBy(*OBJECT, "angle").agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    spread = F.col("square") - F.col("mean") * F.col("mean")
    correlation = F.when(spread > 1e-12, (F.col("product") - F.col("mean") * F.col("mean")) / spread).otherwise(1.0)
    return each.select(*OBJECT, "angle", "contrast", "dissimilarity", "homogeneity", "energy", "entropy", correlation.alias("correlation"))


def runs(tones: DataFrame) -> DataFrame:
    """``image, label, angle, g, size``: each run of one level along a direction."""
    lines = {0: ("y", "x"), 45: (F.col("y") + F.col("x"), "x"), 90: ("x", "y"), 135: (F.col("y") - F.col("x"), "x")}
    along = F.explode(F.array(*[F.struct(F.lit(a).alias("angle"), (F.col(line) if isinstance(line, str) else line).alias("line"), F.col(at).alias("at")) for a, (line, at) in lines.items()]))
    rows = tones.select(*OBJECT, "g", along.alias("o")).select(*OBJECT, "g", "o.*")
    # places of one level on a line less their number are equal just within a run
    island = F.col("at") - F.row_number().over(Window.partitionBy(*OBJECT, "angle", "line", "g").orderBy("at"))
    return rows.withColumn("k", island).groupBy(*OBJECT, "angle", "line", "g", "k").agg(F.count(F.lit(1)).alias("size")).drop("line", "k")


def zones(tones: DataFrame, width: int) -> DataFrame:
    """``image, label, g, size``: each part of an object of one level whose pixels touch, at corners too."""
    one = tones.select(F.struct(*OBJECT, "g").alias("image"), "y", "x", F.lit(1).alias("v"))
    sizes = objects.components(one, width, connectivity=2).groupBy("image", F.col("label").alias("zone")).agg(F.count(F.lit(1)).alias("size"))
    return sizes.select("image.*", "size")


def emphases(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Of runs or zones (``g``, ``size``): emphases of small and large sizes and of low and high levels, how unevenly levels and sizes are
    found, and their number for each pixel."""
    counts = counted.groupBy(*keys, "g", "size").agg(F.count(F.lit(1)).alias("n"))
    n, g, size = F.col("n"), F.col("g"), F.col("size")
    sums = {"small": n / (size * size), "large": n * size * size, "low": n / (g * g), "high": n * g * g, "all": n, "pixels": n * size}
    each = counts.groupBy(*keys).agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    uneven = lambda by: counts.groupBy(*keys, by).agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum(F.col("n") * F.col("n")).alias(f"uneven_{by}"))
    both = each.join(uneven("g"), keys).join(uneven("size"), keys)
    share = [(F.col(c) / F.col("all")).alias(k) for c, k in (("small", "small_emphasis"), ("large", "large_emphasis"), ("low", "low_level_emphasis"), ("high", "high_level_emphasis"), ("uneven_g", "level_nonuniformity"), ("uneven_size", "size_nonuniformity"))]
    return both.select(*keys, *share, (F.col("all") / F.col("pixels")).alias("percentage"))
