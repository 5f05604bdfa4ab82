"""Matching and relabelling of regions by place.

Centroids and boxes meet through cells of a grid, never as all pairs of an image.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.operators.iteration import written

OBJECT = ["image", "label"]


def _cells(y: Column, x: Column, size: Column | float) -> tuple[Column, Column]:
    return F.floor(y / size), F.floor(x / size)


def _near_cells(df: DataFrame) -> DataFrame:
    """Each row in its cell ``i``, ``j`` and in the eight around it."""
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    return df.withColumn("_o", F.explode(around)).withColumns({"i": F.col("i") + F.col("_o.a"), "j": F.col("j") + F.col("_o.b")}).drop("_o")


def nearest(left: DataFrame, right: DataFrame, k: int, cell: float) -> DataFrame:
    """``image, left, right, distance, rank``: the k right objects with the nearest centroids (``cy``, ``cx``) of each left one.

    Each left object looks at the nine cells around it.  It is done if k lie no farther away than a cell is wide, as none
    elsewhere can be nearer; the others look again with cells of twice the size, until a cell holds the whole image.
    Equal distances (to nine digits) are ranked by label.
    """
    span = right.agg(F.max(F.greatest(F.abs("cy"), F.abs("cx"))).alias("m")).first()["m"]
    span = max(span or 0.0, left.agg(F.max(F.greatest(F.abs("cy"), F.abs("cx"))).alias("m")).first()["m"] or 0.0)
    rest = left.select("image", F.col("label").alias("left"), "cy", "cx")
    other = right.select("image", F.col("label").alias("right"), F.col("cy").alias("ry"), F.col("cx").alias("rx"))
    rank = F.row_number().over(Window.partitionBy("image", "left").orderBy(F.round("distance", 9), "right"))
    found = []
    while True:
        last = cell > span
        i, j = _cells(F.col("cy"), F.col("cx"), cell)
        ri, rj = _cells(F.col("ry"), F.col("rx"), cell)
        pairs = _near_cells(rest.withColumns({"i": i, "j": j})).join(other.withColumns({"i": ri, "j": rj}), ["image", "i", "j"])
        distance = F.sqrt((F.col("cy") - F.col("ry")) * (F.col("cy") - F.col("ry")) + (F.col("cx") - F.col("rx")) * (F.col("cx") - F.col("rx")))
        near = pairs.select("image", "left", "right", distance.alias("distance")).withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)
        if not last:
            near = near.filter(F.col("distance") <= cell)
        near = written(near)
        if last:
            found.append(near)
            return reduce(DataFrame.unionByName, found)
        done = near.groupBy("image", "left").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == k).drop("n")
        found.append(near.join(done, ["image", "left"], "left_semi"))
        rest = written(rest.join(done, ["image", "left"], "left_anti"))
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, found)
        cell *= 2


def overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """``image, left, right, common, iou`` of every pair of objects that share a pixel; sizes are counted before the join."""
    size = lambda d, name: d.groupBy("image", F.col("label").alias(name)).agg(F.count(F.lit(1)).alias(f"{name}_area"))
    both = left.select("image", "y", "x", F.col("label").alias("left")).join(right.select("image", "y", "x", F.col("label").alias("right")), ["image", "y", "x"])
    common = both.groupBy("image", "left", "right").agg(F.count(F.lit(1)).alias("common"))
    sized = common.join(size(left, "left"), ["image", "left"]).join(size(right, "right"), ["image", "right"])
    return sized.select("image", "left", "right", "common", (F.col("common") / (F.col("left_area") + F.col("right_area") - F.col("common"))).alias("iou"))


def contained(near: DataFrame, left: DataFrame, right: DataFrame, left_shapes: DataFrame, right_shapes: DataFrame, least_area: int = 2) -> DataFrame:
    """Of neighbours ``left``, ``right``: those of more than ``least_area`` pixels where either's centroid lies in the other."""
    place = lambda shapes, name: shapes.select("image", F.col("label").alias(name), F.floor("cy").alias("y"), F.floor("cx").alias("x"), F.col("area").alias(f"{name}_area"))
    pixels = lambda d, name: d.select("image", "y", "x", F.col("label").alias(name))
    big = near.select("image", "left", "right").join(place(right_shapes, "right").filter(F.col("right_area") > least_area), ["image", "right"])
    inside = big.join(pixels(left, "left"), ["image", "left", "y", "x"], "left_semi").select("image", "left", "right")
    around = big.drop("y", "x").join(place(left_shapes, "left"), ["image", "left"]).join(pixels(right, "right"), ["image", "right", "y", "x"], "left_semi").select("image", "left", "right")
    return inside.unionByName(around).distinct()


def matched(nearest_one: DataFrame, shared: DataFrame, shapes: DataFrame, radius_factor: float, least_iou: float) -> DataFrame:
    """``image, left, right, distance, iou, condition``: left objects in order of their labels claim their nearest right one.

    A claim holds if the distance is below half the left object's ``minor_axis`` times the factor and the overlap above
    ``least_iou``.  Each object has one claim, so the first valid claim on a right object is the one that counts.
    """
    claims = nearest_one.join(shared.select("image", "left", "right", "iou"), ["image", "left", "right"], "left").join(shapes.select("image", F.col("label").alias("left"), "minor_axis"), ["image", "left"])
    claims = claims.select("image", "left", "right", "distance", F.coalesce("iou", F.lit(0.0)).alias("iou"), "minor_axis")
    valid = (F.col("distance") < F.col("minor_axis") / 2 * radius_factor) & (F.col("iou") > least_iou)
    first = claims.filter(valid).groupBy("image", "right").agg(F.min("left").alias("first"))
    out = claims.join(first, ["image", "right"], "left")
    return out.select("image", "left", "right", "distance", "iou", F.when(valid & (F.col("left") == F.col("first")), "TP").otherwise("FN").alias("condition"))


def match_summary(matches: DataFrame) -> DataFrame:
    """Per image: matched and missed objects, and the mean distance and overlap of the matched ones (0 if there is none)."""
    hit = F.col("condition") == "TP"
    means = [F.coalesce(F.avg(F.when(hit, F.col(c))), F.lit(0.0)).alias(f"mean_{c}") for c in ("distance", "iou")]
    return matches.groupBy("image").agg(F.count_if(hit).alias("tp"), F.count_if(~hit).alias("fn"), *means)


def boxes(labels: DataFrame) -> DataFrame:
    """``image, label, y1, x1, y2, x2`` of each object, with partial minima and maxima: parts in several tiles become one."""
    return labels.filter("label > 0").groupBy(*OBJECT).agg(F.min("y").alias("y1"), F.min("x").alias("x1"), F.max("y").alias("y2"), F.max("x").alias("x2"))


def superset(found: DataFrame) -> DataFrame:
    """The one box around all boxes of an image."""
    return found.groupBy("image").agg(F.min("y1").alias("y1"), F.min("x1").alias("x1"), F.max("y2").alias("y2"), F.max("x2").alias("x2"))


def in_range(found: DataFrame, multiplier: float = 1.0) -> DataFrame:
    """``image, a, b, distance`` of boxes (``a < b``) whose centres are no farther apart than their half diagonals times
    the multiplier add up to.

    Boxes are in classes by the power of two above their half diagonal.  The larger of a pair stands in the cells around it
    in the grid of its class, the smaller in one cell of each class from its own up.
    """
    radius = F.sqrt((F.col("y2") - F.col("y1")) * (F.col("y2") - F.col("y1")) + (F.col("x2") - F.col("x1")) * (F.col("x2") - F.col("x1"))) / 2
    at = found.select("image", "label", ((F.col("y1") + F.col("y2")) / 2).alias("cy"), ((F.col("x1") + F.col("x2")) / 2).alias("cx"), radius.alias("r"))
    at = at.withColumn("class", F.ceil(F.log2(F.greatest("r", F.lit(1.0)))).cast("int"))
    size = lambda c: F.pow(F.lit(2.0), c + 1) * multiplier + 1e-9
    i, j = _cells(F.col("cy"), F.col("cx"), size(F.col("class")))
    large = _near_cells(at.withColumns({"i": i, "j": j})).select("image", "class", "i", "j", F.col("label").alias("p"), F.col("cy").alias("py"), F.col("cx").alias("px"), F.col("r").alias("pr"))
    classes = at.select("image", F.col("class").alias("grid")).distinct()
    i, j = _cells(F.col("cy"), F.col("cx"), size(F.col("grid")))
    small = at.join(classes, "image").filter("grid >= class").withColumns({"i": i, "j": j})
    small = small.select("image", F.col("grid").alias("class"), F.col("class").alias("own"), "i", "j", F.col("label").alias("q"), F.col("cy").alias("qy"), F.col("cx").alias("qx"), F.col("r").alias("qr"))
    distance = F.sqrt((F.col("py") - F.col("qy")) * (F.col("py") - F.col("qy")) + (F.col("px") - F.col("qx")) * (F.col("px") - F.col("qx")))
    pairs = large.join(small, ["image", "class", "i", "j"]).filter((F.col("own") < F.col("class")) | (F.col("p") < F.col("q")))
    pairs = pairs.filter(distance <= (F.col("pr") + F.col("qr")) * multiplier)
    return pairs.select("image", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), distance.alias("distance"))


def touching(found: DataFrame) -> DataFrame:
    """``image, a, b`` of boxes (``a < b`` by label) where the top left corner of the later one, by left, top, right and
    bottom edge, lies in the earlier; such boxes are always in range of each other."""
    side = lambda k: found.select("image", F.col("label").alias(k), F.struct("x1", "y1", "x2", "y2").alias(f"{k}_box"))
    pairs = in_range(found).join(side("a"), ["image", "a"]).join(side("b"), ["image", "b"])
    first, then = F.least("a_box", "b_box"), F.greatest("a_box", "b_box")
    hit = (then["x1"] >= first["x1"]) & (then["x1"] <= first["x2"]) & (then["y1"] >= first["y1"]) & (then["y1"] <= first["y2"])
    return pairs.filter(hit).select("image", "a", "b")


def in_order(found: DataFrame) -> DataFrame:
    """Labels 1, 2, 3 ... of each image by left, top, right and bottom edge."""
    w = Window.partitionBy("image").orderBy("x1", "y1", "x2", "y2", "label")
    return found.select("image", "label", F.row_number().over(w).cast("long").alias("new"))


def shuffled(found: DataFrame, seed: int, bytes_only: bool = False) -> DataFrame:
    """Labels in an order that only a seed decides; ``bytes_only`` repeats 1 to 255."""
    w = Window.partitionBy("image").orderBy(F.md5(F.concat_ws("-", F.col("label").cast("string"), F.lit(str(seed)))))
    rank = F.row_number().over(w).cast("long")
    return found.select("image", "label", (rank % 255 + 1 if bytes_only else rank).alias("new"))


def coloured(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``image, label, colour``: greedy colours, nodes with most neighbours first, then by label.

    A node takes its colour as soon as all neighbours that come before it have theirs, so each round colours all nodes that
    are free, and the result is that of one after the other.
    """
    both = edges.select("image", F.col("a").alias("label"), F.col("b").alias("other")).unionByName(edges.select("image", F.col("b").alias("label"), F.col("a").alias("other")))
    degree = nodes.select(*OBJECT).join(both.groupBy(*OBJECT).agg(F.count(F.lit(1)).alias("degree")), OBJECT, "left").select(*OBJECT, F.coalesce("degree", F.lit(0)).alias("degree"))
    place = lambda name: degree.select("image", F.col("label").alias(name), F.struct((-F.col("degree")).alias("d"), F.col("label").alias("l")).alias(f"{name}_at"))
    before = written(both.join(place("label"), OBJECT).join(place("other"), ["image", "other"]).filter("other_at < label_at").select(*OBJECT, "other"))
    rest, done = written(degree.select(*OBJECT)), None
    while not rest.isEmpty():
        waits = before.join(rest.select("image", F.col("label").alias("other")), ["image", "other"], "left_semi").select(*OBJECT).distinct()
        free = rest.join(waits, OBJECT, "left_anti")
        if done is None:
            fresh = free.withColumn("colour", F.lit(0).cast("long"))
        else:
            used = before.join(done.select("image", F.col("label").alias("other"), "colour"), ["image", "other"]).groupBy(*OBJECT).agg(F.collect_set("colour").alias("used"))
            used = free.join(used, OBJECT, "left").withColumn("used", F.coalesce("used", F.array().cast("array<bigint>")))
            fresh = used.select(*OBJECT, F.array_min(F.array_except(F.sequence(F.lit(0).cast("long"), F.size("used").cast("long")), F.col("used"))).alias("colour"))
        done = written(fresh if done is None else done.unionByName(fresh))
        rest = written(rest.join(done, OBJECT, "left_anti"))
    return done if done is not None else degree.select(*OBJECT, F.lit(0).cast("long").alias("colour"))


def spread_colours(colours: DataFrame, greatest: int) -> DataFrame:
    """Colours as labels that lie evenly between 1 and the greatest one."""
    n = colours.groupBy("image").agg(F.countDistinct("colour").alias("n"))
    return colours.join(n, "image").select(*OBJECT, (1 + F.col("colour") * F.floor(F.lit(greatest - 2) / F.col("n"))).alias("new"))
