"""Filters and measures of whole images, over rasters ``image, y, x, v``.

Kernels are separated into rows and columns where they can be, and then are windows along one row or column of one image;
others are exploded offsets with partial sums.  What lies outside an image counts as nothing, or is left out of a mean.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.operators import objects, raster
from mosaiq.operators.iteration import written
from mosaiq.operators.raster import AT


def ellipse(size: int) -> list[tuple[int, int]]:
    """Offsets of an ellipse within a square of an odd size."""
    r = size // 2
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if abs(dx) <= (round(math.sqrt(r * r - dy * dy)) if r else 0)]


def repeated(pixels: DataFrame, step, offsets: list[tuple[int, int]], n: int) -> DataFrame:
    """A step of ``raster`` n times over."""
    for _ in range(n):
        pixels = step(pixels, offsets)
    return pixels


def inverted(pixels: DataFrame) -> DataFrame:
    """1 where a mask is 0."""
    return pixels.select(*AT, (F.col("v") <= 0.5).cast("long").alias("v"))


def mirrored(pixels: DataFrame) -> DataFrame:
    """The greatest value becomes the least and the other way round."""
    ends = pixels.groupBy("image").agg((F.max("v") + F.min("v")).alias("_s"))
    return pixels.join(ends, "image").select(*AT, (F.col("_s") - F.col("v")).alias("v"))


def quarter_turn(pixels: DataFrame) -> DataFrame:
    """Turned by 90 degrees against the clock."""
    width = pixels.groupBy("image").agg(F.max("x").alias("_m"))
    return pixels.join(width, "image").select("image", (F.col("_m") - F.col("x")).alias("y"), F.col("y").alias("x"), "v")


def padded(pixels: DataFrame, height: int, width: int, pad: int) -> DataFrame:
    """With a margin that mirrors the edge, the edge itself included."""
    places = lambda c, n: F.filter(F.array(F.col(c), -1 - F.col(c), 2 * n - 1 - F.col(c)), lambda p: (p >= -pad) & (p < n + pad))
    out = pixels.select("image", F.explode(places("y", height)).alias("y"), "x", "v").select("image", "y", F.explode(places("x", width)).alias("x"), "v")
    return out.select("image", (F.col("y") + pad).alias("y"), (F.col("x") + pad).alias("x"), "v")


def skeleton(mask: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """What each erosion loses that the opening would not bring back, until nothing is left to erode."""
    out, rest = None, written(mask)
    while True:
        eroded = written(raster.erode(rest, offsets))
        lost = raster.calculate(rest, raster.dilate(eroded, offsets), "subtract").filter("v > 0")
        out = lost if out is None else out.unionByName(lost)
        if eroded.filter("v > 0").isEmpty():
            break
        rest = eroded
    return mask.select(*AT).join(out.select(*AT).distinct().withColumn("v", F.lit(1).cast("long")), AT, "left").select(*AT, F.coalesce("v", F.lit(0)).alias("v"))


def holes_filled(mask: DataFrame, height: int, width: int) -> DataFrame:
    """Background that no path of neighbours ties to an edge becomes foreground."""
    background = objects.components(inverted(mask), width)
    holes = objects.clear_border(background, height, width).select(*AT, F.lit(1).cast("long").alias("hole"))
    return mask.join(holes, AT, "left").select(*AT, F.greatest("v", F.coalesce("hole", F.lit(0))).alias("v"))


def grown_labels(labels: DataFrame, pixels: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Each label dilated by itself, over background only; of several that reach a pixel the least has it."""
    spread = raster.spread(labels.select("image", "y", "x", F.col("label").alias("v")), offsets).groupBy(*AT).agg(F.min("v").alias("reached"))
    own = labels.select("image", "y", "x", F.col("label").alias("own"))
    found = spread.join(pixels.select(*AT), AT, "left_semi").join(own, AT, "left")
    return found.select(*AT, F.coalesce("own", "reached").alias("label"))


def local_normalised(pixels: DataFrame, radius: int, limit: float | None = None) -> DataFrame:
    """Distance from the mean of the box around each pixel in standard deviations of the box, cut at ``limit``."""
    across = Window.partitionBy("image", "y").orderBy("x").rangeBetween(-radius, radius)
    down = Window.partitionBy("image", "x").orderBy("y").rangeBetween(-radius, radius)
    rows = pixels.select(*AT, "v", F.sum("v").over(across).alias("s"), F.sum(F.col("v") * F.col("v")).over(across).alias("q"), F.count("v").over(across).alias("n"))
    sums = rows.select(*AT, "v", F.sum("s").over(down).alias("s"), F.sum("q").over(down).alias("q"), F.sum("n").over(down).alias("n"))
    mean = F.col("s") / F.col("n")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean))
    out = F.when(spread > 1e-9, (F.col("v") - mean) / spread).otherwise(0.0)
    return sums.select(*AT, (out if limit is None else F.greatest(F.lit(-limit), F.least(F.lit(limit), out))).alias("v"))


def gauss_weights(sigma: float, derivative: int = 0) -> list[float]:
    """Weights of a normal curve as far as three sigma, or of its first or second derivative."""
    r = max(1, math.ceil(3 * sigma))
    base = [math.exp(-i * i / (2 * sigma * sigma)) for i in range(-r, r + 1)]
    total = sum(base)
    factor = {0: lambda i: 1.0, 1: lambda i: -i / sigma**2, 2: lambda i: (i * i - sigma**2) / sigma**4}[derivative]
    return [b / total * factor(i) for i, b in zip(range(-r, r + 1), base, strict=True)]


def _along(pixels: DataFrame, by: str, order: str, weights: list[float]) -> DataFrame:
    """Sum of neighbours along one axis of a dense raster, the first weight for the farthest neighbour after."""
    r = len(weights) // 2
    w = Window.partitionBy("image", by).orderBy(order)
    terms = []
    for i, k in zip(range(-r, r + 1), weights, strict=True):
        near = F.col("v") if not i else (F.lag("v", i, 0).over(w) if i > 0 else F.lead("v", -i, 0).over(w))
        terms.append(near * k)
    return pixels.select(*AT, sum(terms[1:], terms[0]).alias("v"))


def separable(pixels: DataFrame, down: list[float], across: list[float]) -> DataFrame:
    """Convolution with the product of two kernels; outside the image is 0."""
    return _along(_along(pixels, "y", "x", across), "x", "y", down)


def gauss(pixels: DataFrame, sigma: float) -> DataFrame:
    return separable(pixels, gauss_weights(sigma), gauss_weights(sigma))


def gauss_derivative(pixels: DataFrame, sigma: float, down: int, across: int) -> DataFrame:
    return separable(pixels, gauss_weights(sigma, down), gauss_weights(sigma, across))


def difference_of_gauss(pixels: DataFrame, left: float, right: float) -> DataFrame:
    wide = gauss(pixels, right).withColumnRenamed("v", "w")
    return gauss(pixels, left).join(wide, AT).select(*AT, (F.col("v") - F.col("w")).alias("v"))


def partial_derivative(pixels: DataFrame, axis: str) -> DataFrame:
    """Half the difference of the next and the last pixel along an axis; at an edge the pixel itself stands in."""
    w = Window.partitionBy("image", "x" if axis == "y" else "y").orderBy(axis)
    return pixels.select(*AT, ((F.coalesce(F.lead("v").over(w), "v") - F.coalesce(F.lag("v").over(w), "v")) / 2).alias("v"))


def correlate(pixels: DataFrame, kernel: dict[tuple[int, int], float]) -> DataFrame:
    """Convolution with the kernel turned by half."""
    return raster.convolve(pixels, {(-dy, -dx): k for (dy, dx), k in kernel.items()})


def _curvatures(pixels: DataFrame, sigma: float) -> DataFrame:
    """The eigenvalues ``low``, ``high`` of the second derivatives, scaled by sigma squared."""
    part = lambda down, across, name: gauss_derivative(pixels, sigma, down, across).withColumnRenamed("v", name)
    h = part(2, 0, "yy").join(part(0, 2, "xx"), AT).join(part(1, 1, "xy"), AT)
    root = F.sqrt(F.pow((F.col("yy") - F.col("xx")) / 2, 2) + F.col("xy") * F.col("xy"))
    middle, scale = (F.col("yy") + F.col("xx")) / 2, sigma * sigma
    return h.select(*AT, ((middle - root) * scale).alias("low"), ((middle + root) * scale).alias("high"))


def tubeness(pixels: DataFrame, sigma: float) -> DataFrame:
    """How far the lower curvature is below 0: bright lines."""
    return _curvatures(pixels, sigma).select(*AT, F.greatest(F.lit(0.0), -F.col("low")).alias("v"))


def vesselness(pixels: DataFrame, sigma: float, beta: float = 0.5, c: float = 15.0) -> DataFrame:
    """Bright lines by the ratio and the size of both curvatures."""
    k = _curvatures(pixels, sigma)
    large, small = (F.when(F.abs("low") >= F.abs("high"), F.col(a)).otherwise(F.col(b)) for a, b in (("low", "high"), ("high", "low")))
    ratio, strength = small / large, small * small + large * large
    v = F.exp(-ratio * ratio / (2 * beta * beta)) * (1 - F.exp(-strength / (2 * c * c)))
    return k.select(*AT, F.when(large < 0, v).otherwise(0.0).alias("v"))


def richardson_lucy(pixels: DataFrame, kernel: dict[tuple[int, int], float], iterations: int) -> DataFrame:
    """Deconvolution: the estimate times the correlation of data over what the estimate would show."""
    data = written(pixels.select(*AT, F.col("v").cast("double").alias("v")))
    estimate = data
    for _ in range(iterations):
        shown = raster.convolve(estimate, kernel).withColumnRenamed("v", "w")
        ratio = data.join(shown, AT).select(*AT, F.when(F.col("w") > 1e-12, F.col("v") / F.col("w")).otherwise(0.0).alias("v"))
        factor = correlate(ratio, kernel).withColumnRenamed("v", "w")
        estimate = written(estimate.join(factor, AT).select(*AT, (F.col("v") * F.col("w")).alias("v")))
    return estimate


def flat_field(pixels: DataFrame, bright: DataFrame, dark: DataFrame | None = None) -> DataFrame:
    """(v - dark) / (bright + 1e-8) at each place; bright and dark are ``y, x, v``."""
    out = pixels.join(bright.withColumnRenamed("v", "_b"), ["y", "x"])
    if dark is not None:
        out = out.join(dark.withColumnRenamed("v", "_d"), ["y", "x"])
    return out.select(*AT, ((F.col("v") - (F.lit(0.0) if dark is None else F.col("_d"))) / (F.col("_b") + 1e-8)).alias("v"))


def value_bounds(pixels: DataFrame) -> DataFrame:
    """Greatest and least value of each image, and the least above 0 (null for a blank one)."""
    return pixels.groupBy("image").agg(F.max("v").alias("greatest"), F.min("v").alias("least"), F.min(F.when(F.col("v") > 0, F.col("v"))).alias("least_above_0"))


def without_blank(pixels: DataFrame) -> DataFrame:
    """Pixels of images with more than one value."""
    some = pixels.groupBy("image").agg(F.min("v").alias("a"), F.max("v").alias("b")).filter("a <> b").select("image")
    return pixels.join(some, "image", "left_semi")


def exact_tiles(pixels: DataFrame, size: int) -> DataFrame:
    """Square tiles, counted from 0 by ``ty``, ``tx``, that the image fills."""
    tiles = pixels.withColumns({"ty": F.floor(F.col("y") / size), "tx": F.floor(F.col("x") / size)}).groupBy("image", "ty", "tx").agg(F.count(F.lit(1)).alias("n"))
    return tiles.filter(F.col("n") == size * size).select("image", "ty", "tx")


def halo_tiles(shapes: DataFrame, size: int, halo: int) -> DataFrame:
    """``image, y0, y1, x0, x1`` of each tile and the same with its halo (``hy0`` ...), cut at the edges; shapes has
    ``image, height, width``."""
    starts = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(size).cast("long"))
    at = shapes.select("*", F.explode(starts("height")).alias("y0")).select("*", F.explode(starts("width")).alias("x0"))
    zero = F.lit(0).cast("long")
    at = at.withColumns({"y1": F.least(F.col("y0") + size, "height"), "x1": F.least(F.col("x0") + size, "width")})
    return at.select("image", "y0", "y1", "x0", "x1", F.greatest(zero, F.col("y0") - halo).alias("hy0"), F.least("height", F.col("y1") + halo).alias("hy1"), F.greatest(zero, F.col("x0") - halo).alias("hx0"), F.least("width", F.col("x1") + halo).alias("hx1"))


def tiles_under(views: DataFrame, size: int) -> DataFrame:
    """``file, ty, tx``: the tiles that each field of view covers; views has ``file, pos_y, pos_x, height, width``."""
    span = lambda at, n: F.sequence(F.floor(F.col(at) / size), F.floor((F.col(at) + F.col(n) - 1) / size))
    return views.select("file", F.explode(span("pos_y", "height")).alias("ty"), span("pos_x", "width").alias("c")).select("file", "ty", F.explode("c").alias("tx"))


def bin_entropy(pixels: DataFrame, keys: list[str], bins: int = 128) -> DataFrame:
    """Entropy (nats) of the values of each group in bins of equal width between the group's ends."""
    ends = pixels.groupBy(*keys).agg(F.min("v").alias("a"), F.max("v").alias("b"))
    share = (F.col("v") - F.col("a")) * bins / F.when(F.col("b") > F.col("a"), F.col("b") - F.col("a")).otherwise(1)
    binned = pixels.join(ends, keys).groupBy(*keys, F.least(F.floor(share), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return binned.groupBy(*keys).agg((F.ln(F.sum("n")) - F.sum(F.col("n") * F.ln("n")) / F.sum("n")).alias("entropy"))


def rolling_mean(rows: DataFrame, by: list[str], at: str, value: str, width: int) -> DataFrame:
    """|mean| of each ``width`` following values, for all places where so many follow; counted from 0 again."""
    w = Window.partitionBy(*by).orderBy(at)
    ahead = w.rowsBetween(1, width)
    out = rows.select(*by, at, F.sum(value).over(ahead).alias("s"), F.count(value).over(ahead).alias("n")).filter(F.col("n") == width)
    return out.select(*by, (F.row_number().over(w) - 1).cast("long").alias(at), (F.abs("s") / width).alias(value))


def smoothed_gradients(rows: DataFrame, by: list[str], at: str, value: str, width: int) -> DataFrame:
    """Differences of neighbouring rolling means, smoothed again."""
    smooth = rolling_mean(rows, by, at, value, width)
    step = F.lead(value).over(Window.partitionBy(*by).orderBy(at)) - F.col(value)
    return rolling_mean(smooth.withColumn(value, step).filter(F.col(value).isNotNull()), by, at, value, width)


def first_spike(rows: DataFrame, by: list[str], at: str, value: str, threshold: float) -> DataFrame:
    """The first place whose value reaches the threshold; groups without one have no row."""
    return rows.filter(F.col(value) >= threshold).groupBy(*by).agg(F.min(F.struct(at, value)).alias("m")).select(*by, f"m.{at}", f"m.{value}")


def percentile_bounds(pixels: DataFrame, share: float) -> DataFrame:
    """Values that at least a share of the pixels above 0 do not exceed, from both ends, by counting values."""
    counts = pixels.filter("v > 0").groupBy("image", "v").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("image")
    placed = counts.withColumns({"upto": F.sum("n").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(w)})
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.round(F.col("total") * q, 6)), F.col("v")))
    return placed.groupBy("image").agg(at(share).alias("low"), at(1 - share).alias("high"))


def well_intensity(pixels: DataFrame, wells: DataFrame, share: float = 0.05) -> DataFrame:
    """``image, well, intensity``: whole part of the mean of each well's square less the median of its darkest pixels.

    wells has ``well, cy, cx, r``; each is spread over the places of its square, so images and wells meet by place.
    """
    places = wells.select("well", F.explode(F.sequence(F.col("cy") - F.col("r"), F.col("cy") + F.col("r") - 1)).alias("y"), "cx", "r").select("well", "y", F.explode(F.sequence(F.col("cx") - F.col("r"), F.col("cx") + F.col("r") - 1)).alias("x"))
    patch = pixels.join(places, ["y", "x"])
    counts = patch.groupBy("image", "well", "v").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("image", "well")
    counts = counts.withColumns({"upto": F.sum("n").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(w)})
    dark = F.floor(F.col("total") * share)
    at = lambda p: F.min(F.when(F.col("upto") > p, F.col("v")))
    found = counts.groupBy("image", "well").agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("mean"), at(F.floor((dark - 1) / 2)).alias("a"), at(F.floor(dark / 2)).alias("b"))
    return found.select("image", "well", (F.col("mean") - (F.col("a") + F.col("b")) / 2.0).cast("long").alias("intensity"))


def disks(wells: DataFrame) -> DataFrame:
    """``y, x, well`` of the places nearer to a well's centre than its radius; the least well where two overlap."""
    square = wells.select("well", "cy", "cx", "r", F.explode(F.sequence(F.col("cy") - F.col("r"), F.col("cy") + F.col("r"))).alias("y")).select("*", F.explode(F.sequence(F.col("cx") - F.col("r"), F.col("cx") + F.col("r"))).alias("x"))
    inside = (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy")) + (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) < F.col("r") * F.col("r")
    return square.filter(inside).groupBy("y", "x").agg(F.min("well").alias("well"))


def framed(pixels: DataFrame, clusters: DataFrame, width: int) -> DataFrame:
    """The image with a frame of its cluster's number; clusters has ``image, cluster``."""
    size = pixels.groupBy("image").agg(F.max("y").alias("_h"), F.max("x").alias("_w"))
    edge = (F.col("y") < width) | (F.col("x") < width) | (F.col("y") > F.col("_h") - width) | (F.col("x") > F.col("_w") - width)
    return pixels.join(size, "image").join(clusters, "image").select(*AT, F.when(edge, F.col("cluster")).otherwise(F.col("v")).alias("v"))


def blended(pixels: DataFrame, colours: DataFrame) -> DataFrame:
    """``y, x, red, green, blue``: channels cut to their bounds, scaled to 255, tinted and added up to 255 at most.

    colours has ``image, low, high, red, green, blue`` (shares), one row for each channel.
    """
    level = F.greatest(F.lit(0.0), F.least(F.lit(255.0), 255.0 * (F.col("v") - F.col("low")) / (F.col("high") - F.col("low"))))
    sums = [F.least(F.lit(255), F.floor(F.round(F.sum(level * F.col(c)), 6))).cast("long").alias(c) for c in ("red", "green", "blue")]
    return pixels.join(colours, "image").groupBy("y", "x").agg(*sums)


def in_polygon(ring: Column) -> Column:
    """Whether ``y``, ``x`` lies in a closed ring of ``[x, y]`` corners, by the parity of its crossings."""
    edges = F.transform(F.slice(ring, 1, F.size(ring) - 1), lambda a, i: F.struct(a.alias("a"), F.get(ring, i + 1).alias("b")))
    above = lambda p: F.element_at(p, 2) > F.col("y")
    cross = lambda a, b: F.col("x") < (F.element_at(b, 1) - F.element_at(a, 1)) * (F.col("y") - F.element_at(a, 2)) / F.when(F.element_at(b, 2) != F.element_at(a, 2), F.element_at(b, 2) - F.element_at(a, 2)) + F.element_at(a, 1)
    return F.size(F.filter(edges, lambda e: (above(e["a"]) != above(e["b"])) & cross(e["a"], e["b"]))) % 2 == 1


def ball(radius: int) -> dict[tuple[int, int], float]:
    """Heights of the upper half of a ball over the places below it."""
    return {(dy, dx): math.sqrt(radius * radius - dy * dy - dx * dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy * dy + dx * dx <= radius * radius}


def _over_ball(pixels: DataFrame, radius: int, lowered: bool) -> DataFrame:
    """The greatest height that lets a ball centred at each place stay below the image, or how far up balls of such heights
    reach."""
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(h).alias("h")) for (dy, dx), h in ball(radius).items()])
    moved = pixels.select("image", "y", "x", "v", F.explode(steps).alias("o"))
    moved = moved.select("image", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), (F.col("v") - F.col("o.h") if lowered else F.col("v") + F.col("o.h")).alias("v"))
    return moved.groupBy(*AT).agg((F.min("v") if lowered else F.max("v")).alias("v")).join(pixels.select(*AT), AT, "left_semi").select(*AT, "v")


def without_background(pixels: DataFrame, radius: int) -> DataFrame:
    """The image above the surface that a ball rolled below it touches."""
    surface = _over_ball(_over_ball(pixels, radius, True), radius, False).withColumnRenamed("v", "_s")
    return pixels.join(surface, AT).select(*AT, (F.col("v") - F.col("_s")).alias("v"))


def autocrop(pixels: DataFrame, width: int, threshold: float, bins: int = 32) -> DataFrame:
    """``image, y1, x1, y2, x2``: from each side, the first place where the entropy of rows or columns changes by the
    threshold; an edge without one stays where it is."""
    out = pixels.groupBy("image").agg(F.max("y").alias("_y"), F.max("x").alias("_x"))
    for axis in ("y", "x"):
        strips = bin_entropy(pixels, ["image", axis], bins)
        for side in ("1", "2"):
            turned = strips if side == "1" else strips.join(out.select("image", f"_{axis}"), "image").select("image", (F.col(f"_{axis}") - F.col(axis)).alias(axis), "entropy")
            hit = first_spike(smoothed_gradients(turned, ["image"], axis, "entropy", width), ["image"], axis, "entropy", threshold).select("image", F.col(axis).alias("_hit"))
            at = F.coalesce("_hit", F.lit(0)).cast("long")
            out = out.join(hit, "image", "left").withColumn(f"{axis}{side}", at if side == "1" else F.col(f"_{axis}") - at).drop("_hit")
    return out.select("image", "y1", "x1", "y2", "x2")
