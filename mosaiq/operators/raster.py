"""Rasters as long tables ``image, y, x, v``.

Neighbourhoods are exploded offsets summed with partial aggregates, or windows along a row of an image; an image is
never collected into one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.operators.iteration import saved

AT = ["image", "y", "x"]

OPERATIONS = {
    "add": lambda a, b: a + b,
    "subtract": lambda a, b: a - b,
    "multiply": lambda a, b: a * b,
    "divide": lambda a, b: F.when(b != 0, F.floor(a / b)).otherwise(0),
    "and": lambda a, b: a.bitwiseAND(b),
    "or": lambda a, b: a.bitwiseOR(b),
    "xor": lambda a, b: a.bitwiseXOR(b),
    "min": F.least,
    "max": F.greatest,
    "absdiff": lambda a, b: F.abs(a - b),
}


def dense(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """All pixels of the grid, 0 where there was none."""
    grid = pixels.select("image").distinct().select("image", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y")).select("image", "y", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    return grid.select("image", F.col("y").cast("long"), F.col("x").cast("long")).join(pixels, AT, "left").select(*AT, F.coalesce("v", F.lit(0)).alias("v"))


def calculate(a: DataFrame, b: DataFrame, operation: str, bits: int | None = None) -> DataFrame:
    """Pixel by pixel; with ``bits`` the result wraps as an unsigned number does."""
    out = OPERATIONS[operation](F.col("v"), F.col("w")).cast("long")
    out = out if bits is None else F.pmod(out, F.lit(1 << bits))
    return a.join(b.withColumnRenamed("v", "w"), AT).select(*AT, out.alias("v"))


def spread(pixels: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Each pixel's value at every offset position."""
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets])
    moved = pixels.select("image", "y", "x", "v", F.explode(steps).alias("o"))
    return moved.select("image", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), "v")


def square(radius: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)]


def cross(radius: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy, dx in square(radius) if not dy or not dx]


def _square_radius(offsets: list[tuple[int, int]]) -> int | None:
    r = max(abs(dy) for dy, _ in offsets)
    return r if sorted(offsets) == sorted(square(r)) else None


def _neighbourhood(pixels: DataFrame, offsets: list[tuple[int, int]], **how: Callable[[Column | str], Column]) -> DataFrame:
    """Aggregates of ``v`` over the pixels of a dense image near each pixel; what lies outside is left out.

    A square is a window along rows and then one along columns; other shapes are exploded."""
    if (r := _square_radius(offsets)) is not None:
        across = Window.partitionBy("image", "y").orderBy("x").rangeBetween(-r, r)
        down = Window.partitionBy("image", "x").orderBy("y").rangeBetween(-r, r)
        rows = pixels.select(*AT, *[f("v").over(across).alias(k) for k, f in how.items()])
        return rows.select(*AT, *[f(k).over(down).alias(k) for k, f in how.items()])
    out = spread(pixels, offsets).groupBy(*AT).agg(*[f("v").alias(k) for k, f in how.items()])
    return out.join(pixels.select(*AT), AT, "left_semi").select(*AT, *how)


def dilate(pixels: DataFrame, offsets: list[tuple[int, int]] = square(1)) -> DataFrame:
    return _neighbourhood(pixels, offsets, v=F.max)


def erode(pixels: DataFrame, offsets: list[tuple[int, int]] = square(1)) -> DataFrame:
    return _neighbourhood(pixels, offsets, v=F.min)


def opened(pixels: DataFrame, offsets: list[tuple[int, int]] = square(1)) -> DataFrame:
    return dilate(erode(pixels, offsets), offsets)


def closed(pixels: DataFrame, offsets: list[tuple[int, int]] = square(1)) -> DataFrame:
    return erode(dilate(pixels, offsets), offsets)


def gradient(pixels: DataFrame, offsets: list[tuple[int, int]] = square(1)) -> DataFrame:
    return _neighbourhood(pixels, offsets, high=F.max, low=F.min).select(*AT, (F.col("high") - F.col("low")).alias("v"))


def top_hat(pixels: DataFrame, offsets: list[tuple[int, int]] = square(1)) -> DataFrame:
    return calculate(pixels, opened(pixels, offsets), "subtract")


def black_hat(pixels: DataFrame, offsets: list[tuple[int, int]] = square(1)) -> DataFrame:
    return calculate(closed(pixels, offsets), pixels, "subtract")


def convolve(pixels: DataFrame, kernel: dict[tuple[int, int], float]) -> DataFrame:
    """Each pixel gets the weight at an offset times the pixel that lies so far before it; outside the image is 0."""
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(float(k)).alias("k")) for (dy, dx), k in kernel.items() if k])
    moved = pixels.select("image", "y", "x", "v", F.explode(steps).alias("o"))
    moved = moved.select("image", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), (F.col("v") * F.col("o.k")).alias("v"))
    return moved.groupBy(*AT).agg(F.sum("v").alias("v")).join(pixels.select(*AT), AT, "left_semi").select(*AT, "v")


SOBEL_X = {(dy, dx): dx * (2 - abs(dy)) for dy in (-1, 0, 1) for dx in (-1, 0, 1)}
SOBEL_Y = {(dx, dy): k for (dy, dx), k in SOBEL_X.items()}


def sobel(pixels: DataFrame) -> DataFrame:
    gx, gy = convolve(pixels, SOBEL_X), convolve(pixels, SOBEL_Y).withColumnRenamed("v", "w")
    return gx.join(gy, AT).select(*AT, F.sqrt(F.col("v") * F.col("v") + F.col("w") * F.col("w")).alias("v"))


def box_mean(pixels: DataFrame, radius: int) -> DataFrame:
    """Mean over the part of the box within the image: sums along rows, then along columns (two windows)."""
    across = Window.partitionBy("image", "y").orderBy("x").rangeBetween(-radius, radius)
    down = Window.partitionBy("image", "x").orderBy("y").rangeBetween(-radius, radius)
    rows = pixels.select(*AT, F.sum("v").over(across).alias("s"), F.count("v").over(across).alias("n"))
    return rows.select(*AT, (F.sum("s").over(down) / F.sum("n").over(down)).alias("v"))


def integral(pixels: DataFrame) -> DataFrame:
    """Sum of all values at or before a pixel in both directions."""
    across = Window.partitionBy("image", "y").orderBy("x")
    down = Window.partitionBy("image", "x").orderBy("y")
    return pixels.select(*AT, F.sum("v").over(across).alias("s")).select(*AT, F.sum("s").over(down).alias("v"))


def project(pixels: DataFrame, how: str) -> DataFrame:
    """Over all images: maximum, minimum or mean (cut to a whole number) of each position."""
    f = {"max": F.max("v"), "min": F.min("v"), "mean": F.floor(F.avg("v"))}[how]
    return pixels.groupBy("y", "x").agg(f.cast("long").alias("v"))


def pyramid_mean(pixels: DataFrame) -> DataFrame:
    """Half the size: the mean of each 2 x 2 block, cut to a whole number; blocks at odd edges are smaller."""
    return pixels.groupBy("image", F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x")).agg(F.floor(F.avg("v")).alias("v"))


def pyramid_mode(pixels: DataFrame) -> DataFrame:
    """Half the size: the most frequent value of each 2 x 2 block, the largest of those that tie."""
    counts = pixels.groupBy("image", F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x"), "v").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*AT).agg(F.max(F.struct("n", "v"))["v"].alias("v"))


def flip(pixels: DataFrame, axis: str) -> DataFrame:
    size = pixels.groupBy("image").agg(F.max(axis).alias("_m"))
    return pixels.join(size, "image").withColumn(axis, F.col("_m") - F.col(axis)).select(*AT, "v")


def crop(pixels: DataFrame, y: tuple[int, int], x: tuple[int, int]) -> DataFrame:
    """Rows y[0] up to y[1], columns likewise, ends left out; positions count from 0 again."""
    inside = (F.col("y") >= y[0]) & (F.col("y") < y[1]) & (F.col("x") >= x[0]) & (F.col("x") < x[1])
    return pixels.filter(inside).select("image", (F.col("y") - y[0]).alias("y"), (F.col("x") - x[0]).alias("x"), "v")


def assemble(tiles: DataFrame, vector: DataFrame) -> DataFrame:
    """Tiles put at their places; where they overlap, the last in the vector's order shows."""
    placed = tiles.join(vector, tiles["image"] == vector["file"]).select((F.col("y") + F.col("pos_y")).alias("y"), (F.col("x") + F.col("pos_x")).alias("x"), F.struct("line", "v").alias("s"))
    return placed.groupBy("y", "x").agg(F.max("s")["v"].alias("v"))


def pyramid(pixels: DataFrame, levels: int, tile: int) -> DataFrame:
    """``level, ty, tx, image, y, x, v``: an image and its halves, each level cut into tiles, as they are stored."""
    out, now = None, pixels
    for level in range(levels):
        tiled = now.select(F.lit(level).cast("long").alias("level"), F.floor(F.col("y") / tile).alias("ty"), F.floor(F.col("x") / tile).alias("tx"), *AT, "v")
        out = tiled if out is None else out.unionByName(tiled)
        now = saved(pyramid_mean(now))  # each level is made once, from the one before
    return out


def write_pyramid(tiles: DataFrame, path: str) -> None:
    """A folder for each level and tile."""
    tiles.write.partitionBy("level", "ty", "tx").parquet(path)
