"""Flow fields of objects, and objects of flow fields, over label rasters ``image, y, x, label``."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.operators import objects
from mosaiq.operators.iteration import by_rows, saved
from mosaiq.operators.raster import AT

OBJECT = ["image", "label"]


def median_pixels(labels: DataFrame) -> DataFrame:
    """``image, label, y, x``: the pixel of each object that is nearest to the medians of its rows and columns; of equally near ones
    the first, row by row."""
    own = saved(labels.filter("label > 0").select(*OBJECT, "y", "x"))
    middle = own.groupBy(*OBJECT).agg(F.median("y").alias("my"), F.median("x").alias("mx"))
    far = (F.col("y") - F.col("my")) * (F.col("y") - F.col("my")) + (F.col("x") - F.col("mx")) * (F.col("x") - F.col("mx"))
    best = own.join(by_rows(middle), OBJECT).groupBy(*OBJECT).agg(F.min(F.struct(far.alias("d"), "y", "x")).alias("b"))
    return best.select(*OBJECT, F.col("b.y").alias("y"), F.col("b.x").alias("x"))


@dataclass(frozen=True)
class Diffusion:
    #: Heat that comes to the middle in each step, the least that counts, and what warm pixels get at each look. Fixed values.
    fuel: float = 1.0
    smoulder: float = 0.00001
    shock: float = 0.01
    every: int = 10


def diffused(inside: np.ndarray, middles: np.ndarray, how: Diffusion = Diffusion()) -> np.ndarray:
    """Heat of the pixels of objects in boxes of one size (``inside`` has a box for each), each step the mean of 3 x 3; an object's heat
    stands still once all of its pixels are warm or, at a look, no new one is."""
    n, height, width = inside.shape
    found, open_ = np.zeros(inside.shape), np.arange(n)
    heat, warmed, step = np.zeros((n, height + 2, width + 2)), np.zeros(inside.shape, bool), 0
    while True:
        core = heat[:, 1:-1, 1:-1]
        core[np.arange(len(open_)), middles[:, 0], middles[:, 1]] += how.fuel
        rows = heat[:, :-2] + heat[:, 1:-1] + heat[:, 2:]
        core[:] = np.where(inside, (rows[:, :, :-2] + rows[:, :, 1:-1] + rows[:, :, 2:]) / 9, 0)
        if step % how.every == 0:
            warm = core > how.smoulder
            done = (warm == inside).all(axis=(1, 2)) | (warmed | ~warm).all(axis=(1, 2))
            found[open_[done]] = core[done]
            if done.all():
                return found
            core[:] = np.where(warm, core + how.shock, 0)
            warmed |= warm
            if done.any():
                open_, inside, middles, heat, warmed = (y[~done] for y in (open_, inside, middles, heat, warmed))
        step += 1


#: Pixels of boxes that are diffused at once (a larger box goes alone), and pixels that are gathered for them.
BOXES, GATHERED = 1 << 16, 1 << 17


def _directions(y: np.ndarray, x: np.ndarray, own: np.ndarray, middle: np.ndarray, how: Diffusion) -> np.ndarray:
    """``vy, vx`` of pixels, of which each object (numbered by ``own``, in order) has all; those in boxes of like size go together."""
    begins = np.searchsorted(own, np.arange(own[-1] + 1))
    low = np.stack([np.minimum.reduceat(c, begins) for c in (y, x)], axis=1) - 1
    sides = np.stack([np.maximum.reduceat(c, begins) for c in (y, x)], axis=1) + 2 - low
    sides = -(-sides // 8) * 8
    found = np.zeros((len(y), 2))
    kinds, which = np.unique(sides, axis=0, return_inverse=True)
    for kind, (height, width) in enumerate(kinds.tolist()):
        like, most = np.flatnonzero(which.ravel() == kind), max(1, BOXES // (height * width))
        for a in range(0, len(like), most):
            some = like[a : a + most]
            place = np.full(len(begins), -1)
            place[some] = np.arange(len(some))
            rows = np.flatnonzero(place[own] >= 0)
            at = place[own[rows]], y[rows] - low[own[rows], 0], x[rows] - low[own[rows], 1]
            inside = np.zeros((len(some), height, width), bool)
            inside[at] = True
            heat = diffused(inside, middle[begins[some]] - low[some], how)
            k, i, j = at  # boxes have a margin, so all differences are of both sides
            v = np.stack([(heat[k, i + 1, j] - heat[k, i - 1, j]) / 2, (heat[k, i, j + 1] - heat[k, i, j - 1]) / 2], axis=1)
            size = np.hypot(v[:, 0], v[:, 1])
            level = size <= 1e-9 * heat.max(axis=(1, 2))[k]  # what differs by rounding only has no direction
            v[level], size[level] = 0, 1
            found[rows] = v / size[:, None]
    return found


def flow_fields(labels: DataFrame, how: Diffusion = Diffusion()) -> DataFrame:
    """``image, y, x, label, vy, vx`` of every pixel of an object: the direction in which heat from its middle pixel grows, of length 1
    (0 where it is level).  An object meets in one task, in an array as large as the box around it, beside others of like size."""
    labels = saved(labels.filter("label > 0").select(*AT, "label"))
    middles = median_pixels(labels).select(*OBJECT, F.col("y").alias("my"), F.col("x").alias("mx"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, most = [], GATHERED
        for frame in chain(frames, [None]):
            if frame is not None and len(frame):
                kept.append(frame)
            if not kept or (frame is not None and sum(map(len, kept)) < most):
                continue
            pixels = pd.concat(kept, ignore_index=True)
            new = (pixels[OBJECT] != pixels[OBJECT].shift()).any(axis=1).to_numpy()
            end = len(pixels) if frame is None else int(np.flatnonzero(new)[-1])  # the last object may go on
            kept, most = [pixels[end:]], max(GATHERED, 2 * (len(pixels) - end))
            if end:
                whole = pixels[:end]
                v = _directions(*(whole[c].to_numpy() for c in ("y", "x")), np.cumsum(new[:end]) - 1, whole[["my", "mx"]].to_numpy(), how)
                yield whole[[*AT, "label"]].assign(vy=v[:, 0], vx=v[:, 1])

    # tasks by cores, as few bytes take long
    own = labels.join(by_rows(middles), OBJECT).repartition(4 * labels.sparkSession.sparkContext.defaultParallelism, *OBJECT).sortWithinPartitions(*OBJECT)
    kind, number = (labels.schema[c].dataType.simpleString() for c in OBJECT)
    return own.select(*AT, "label", "my", "mx").mapInPandas(run, f"image {kind}, y long, x long, label {number}, vy double, vx double")


def _bilinear(points: DataFrame, field: DataFrame, height: int, width: int) -> DataFrame:
    """Points one step along the field, which is interpolated between the four pixels around each."""
    low = [F.floor(c).cast("long") for c in ("py", "px")]
    part = [F.col(c) - F.floor(c) for c in ("py", "px")]
    corners = [F.struct((low[0] + i).alias("y"), (low[1] + j).alias("x"), ((part[0] if i else 1 - part[0]) * (part[1] if j else 1 - part[1])).alias("w")) for i in (0, 1) for j in (0, 1)]
    each = points.select("image", "oy", "ox", "py", "px", F.explode(F.array(*corners)).alias("c")).filter("c.w > 0").select("image", "oy", "ox", "py", "px", F.col("c.y").alias("y"), F.col("c.x").alias("x"), "c.w")
    each = each.join(by_rows(field.select(*AT, "vy", "vx")), AT, "left")
    moved = each.groupBy("image", "oy", "ox").agg(F.first("py").alias("py"), F.first("px").alias("px"), *[F.coalesce(F.sum(F.col("w") * F.col(c)), F.lit(0.0)).alias(c) for c in ("vy", "vx")])
    within = lambda c, n: F.greatest(F.lit(0.0), F.least(F.lit(float(n - 1)), c))
    return moved.select("image", "oy", "ox", within(F.col("py") + F.col("vy"), height).alias("py"), within(F.col("px") + F.col("vx"), width).alias("px"))


def _resolved(points: DataFrame, known: DataFrame, rounds: int = 40) -> DataFrame:
    """``image, oy, ox, label`` of points whose pixel has a label, or is where another point with a label began (and so on)."""
    to = points.select("image", "oy", "ox", F.rint("py").cast("long").alias("y"), F.rint("px").cast("long").alias("x"))
    begun = to.select("image", F.col("oy").alias("y"), F.col("ox").alias("x"), F.lit(True).alias("open"))
    at = to.join(by_rows(known), AT, "left").join(by_rows(begun), AT, "left")
    # what is neither known nor begun is background
    at = saved(at.select("image", "oy", "ox", "y", "x", F.when(F.col("open"), None).otherwise(F.coalesce("label", F.lit(0))).alias("label")))
    for _ in range(rounds):
        ahead = at.select("image", F.col("oy").alias("y"), F.col("ox").alias("x"), F.col("y").alias("y2"), F.col("x").alias("x2"), F.col("label").alias("l2"))
        now = saved(at.join(by_rows(ahead), AT, "left").select("image", "oy", "ox", F.when(F.col("label").isNull(), F.coalesce("y2", "y")).otherwise(F.col("y")).alias("y"), F.when(F.col("label").isNull(), F.coalesce("x2", "x")).otherwise(F.col("x")).alias("x"), F.coalesce("label", "l2").alias("label"), (F.col("label").isNull() & F.col("l2").isNotNull()).alias("new")))
        at = now.drop("new")
        if now.filter("new").isEmpty():
            break
    return at.filter("label is not null").select("image", "oy", "ox", "label")


def labels_of_flows(field: DataFrame, height: int, width: int, radius: int = 2, batches: int = 5, steps: int = 5) -> DataFrame:
    """``image, y, x, label``: objects of ``image, y, x, vy, vx``, which has the pixels of objects only.

    Pixels where the field flows together or goes the way of its surroundings (``radius`` rows and columns) are cores, and touching
    cores are one object.  All other pixels follow the field, by joins with bilinear weights, until they come to a core, to a pixel
    that came to one, or to the background, which takes them away; what comes nowhere in all steps has no label."""
    size = F.sqrt(F.col("vy") * F.col("vy") + F.col("vx") * F.col("vx"))
    unit = lambda c: F.when(size > 0, F.col(c) / size).otherwise(0.0).alias(c)
    field = saved(field.select(*AT, unit("vy"), unit("vx")))
    across = Window.partitionBy("image", "y").orderBy("x")
    down = Window.partitionBy("image", "x").orderBy("y")
    box = F.explode(F.array(*[F.struct(F.lit(d).alias("d")) for d in range(-radius, radius + 1)]))
    # sums over the window, first along columns, for pixels of objects only
    one = field.select("image", F.col("y"), "x", F.lit(1).alias("n"), "vy", "vx")
    for axis in ("y", "x"):
        moved = one.select("image", "y", "x", "n", "vy", "vx", box.alias("o")).withColumn(axis, F.col(axis) + F.col("o.d"))
        one = moved.groupBy(*AT).agg(*[F.sum(c).alias(c) for c in ("n", "vy", "vx")])
    mean = one.select(*AT, (F.col("vy") / F.col("n")).alias("my"), (F.col("vx") / F.col("n")).alias("mx"))
    # differences with the pixels beside, 0 where there is none of an object; one-sided at the image's ends
    def slope(c: str, axis: str, n: int, w) -> F.Column:
        beside = lambda k: F.when(F.lag(axis, k).over(w) == F.col(axis) - k, F.lag(c, k).over(w)).otherwise(0.0)
        return F.when(F.col(axis) == 0, beside(-1) - F.col(c)).when(F.col(axis) == n - 1, F.col(c) - beside(1)).otherwise((beside(-1) - beside(1)) / 2)

    parts = field.withColumn("d", slope("vy", "y", height, down)).withColumn("d", F.col("d") + slope("vx", "x", width, across)).join(by_rows(mean), AT)
    core = (F.col("d") < 0) | (F.col("vy") * F.col("my") + F.col("vx") * F.col("mx") >= 0.8)
    parts = saved(parts.select(*AT, "vy", "vx", core.alias("core")))
    cells = saved(objects.components(parts.select(*AT, F.col("core").cast("long").alias("v")), width, connectivity=2))
    within = lambda c, n: F.greatest(F.lit(0.0), F.least(F.lit(float(n - 1)), c))
    points = parts.filter("not core").select("image", F.col("y").alias("oy"), F.col("x").alias("ox"), within(F.col("y") + F.col("vy"), height).alias("py"), within(F.col("x") + F.col("vx"), width).alias("px"))
    known, points = cells, saved(points)
    for k in range(batches + 1):
        if k:
            for _ in range(steps):
                points = _bilinear(points, field, height, width)
            points = saved(points)
        found = _resolved(points, known)
        known = saved(known.unionByName(found.select("image", F.col("oy").alias("y"), F.col("ox").alias("x"), "label")))
        points = saved(points.join(by_rows(found), ["image", "oy", "ox"], "left_anti"))
        if points.isEmpty():
            break
    return known.filter("label > 0")
