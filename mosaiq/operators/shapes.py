"""Outlines and hulls of objects in label rasters ``image, y, x, label``, and what follows from them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.operators import objects
from mosaiq.operators.iteration import saved

OBJECT = ["image", "label"]
#: Steps to the eight neighbours, clockwise from the one above; even ones share a side with the pixel.
AROUND = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]


#: Rows and columns of a tile, in which outlines are followed by arrays.
TILE = 256


def _tiled(labels: DataFrame) -> DataFrame:
    """Pixels of objects by tile (``ty, tx``), each tile with the pixels around it."""
    tiles = lambda c: F.explode(F.array_distinct(F.array(*[F.floor((F.col(c) + d) / TILE) for d in (-1, 0, 1)])))
    own = labels.filter("label > 0").select(*OBJECT, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))
    return own.withColumn("ty", tiles("y")).withColumn("tx", tiles("x"))


def _traced(pixels: pd.DataFrame) -> pd.DataFrame:
    """Sides of a tile's pixels that no pixel of their object is behind, each followed clockwise around the object (pixels that only
    touch at a corner are apart), as corners of outlines that are closed here (``kind`` 0; ``name`` the least side, ``at`` the
    corner's number), corners of pieces that go on in another tile (1; ``name`` their first side, ``at`` the steps from it), and
    these pieces (2; ``n`` sides, ``next`` the first side after them, ``least`` the least one, ``at`` steps from the first).  Sides
    are numbers in the order of rows, columns and sides."""
    width = TILE + 2
    y0, x0 = int(pixels["ty"].iloc[0]) * TILE - 1, int(pixels["tx"].iloc[0]) * TILE - 1
    numbers, code = np.unique(pixels["label"].to_numpy(), return_inverse=True)
    cells = np.unique((code * width + pixels["y"].to_numpy() - y0) * width + pixels["x"].to_numpy() - x0)
    row, column = cells // width % width, cells % width
    own = cells[(row > 0) & (row <= TILE) & (column > 0) & (column <= TILE)]
    steps = [dy * width + dx for dy, dx in AROUND]
    has = [cells[np.minimum(np.searchsorted(cells, own + step), len(cells) - 1)] == own + step for step in steps]
    found = []
    for s in range(4):
        ahead, across, back = has[(2 * s + 2) % 8], has[2 * s + 1], has[2 * s - 2] & ~has[2 * s - 1]
        after = np.where(~ahead, own * 4 + (s + 1) % 4, np.where(~across, (own + steps[(2 * s + 2) % 8]) * 4 + s, (own + steps[2 * s + 1]) * 4 + (s + 3) % 4))
        found.append(np.stack([own * 4 + s, after, ~back])[:, ~has[2 * s]])  # a side that goes on as the one before it begins at no corner
    side, after, corner = np.concatenate(found, axis=1)
    order = np.argsort(side)
    side, after, corner = side[order], after[order], corner[order].astype(bool)
    go = np.minimum(np.searchsorted(side, after), len(side) - 1)
    stays = side[go] == after
    to, far, least = np.where(stays, go, np.arange(len(side))), np.zeros(len(side), np.int64), np.arange(len(side))
    ahead = stays.astype(np.int64)
    for _ in range(len(side).bit_length() + 1):  # each side learns the least within 1, 2, 4, ... steps
        better = least[to] < least
        far, least = np.where(better, far[to] + ahead, far), np.where(better, least[to], least)
        ahead, to = ahead + ahead[to], to[to]

    def named(c: np.ndarray) -> np.ndarray:
        cell = c >> 2
        return ((((cell // width % width + y0) << 31) + cell % width + x0 + (1 << 30)) << 2) + (c & 3)

    def rows(kind: int, of: np.ndarray, **columns: np.ndarray) -> pd.DataFrame:
        cell, s = side[of] >> 2, side[of] & 3
        place = {"y": cell // width % width + y0 + (s >= 2), "x": cell % width + x0 + ((s == 1) | (s == 2))}
        return pd.DataFrame({"image": pixels["image"].iloc[0], "label": numbers[cell // width // width], "kind": kind, **place, "next": 0, "least": 0, **columns})

    open_ = ~stays[to]
    at = np.flatnonzero(~open_ & corner)
    long = np.bincount(least[~open_], minlength=len(side))
    at = at[np.lexsort(((long[least[at]] - far[at]) % long[least[at]], least[at]))]
    turn = np.arange(len(at)) - np.searchsorted(least[at], least[at])
    closed = rows(0, at, name=named(side[least[at]]), n=long[least[at]], at=turn)
    begun = np.zeros(len(side), bool)
    begun[go[stays]] = True
    first = np.flatnonzero(open_ & ~begun)
    firsts = np.zeros(len(side), np.int64)
    firsts[to[first]] = first
    at = np.flatnonzero(open_ & corner)
    begin = firsts[to[at]]
    loose = rows(1, at, name=named(side[begin]), n=0, at=ahead[begin] - ahead[at])
    pieces = rows(2, first, name=named(side[first]), n=ahead[first] + 1, at=far[first], next=named(after[to[first]]), least=named(side[least[first]]))
    return pd.concat([closed, loose, pieces])


def contours(labels: DataFrame, rounds: int = 60) -> DataFrame:
    """``image, label, ring, k, y, x``: the corners of each outline in order, clockwise around an object and the other way round its
    holes; ``ring`` numbers an object's outlines by their first sides (row by row), from which ``k`` counts the corners.

    Outlines are followed in tiles.  Pieces of those that cross tiles learn the least side within 1, 2, 4, ... pieces ahead and how
    far it is, until nothing changes; that names the outline and ranks its pieces in as many rounds as the logarithm of their number."""
    kind, number = (labels.schema[c].dataType.simpleString() for c in OBJECT)
    schema = f"image {kind}, label {number}, kind int, y long, x long, next long, least long, name long, n long, at long"
    found = saved(_tiled(labels).groupBy("image", "ty", "tx").applyInPandas(lambda p: _traced(p)[[c.split()[0] for c in schema.split(", ")]], schema))
    turns = found.filter("kind = 0").select(*OBJECT, F.col("name").alias("least"), F.col("at").alias("k"), "y", "x")
    outlines = turns.filter("k = 0").select(*OBJECT, "least")
    pieces = saved(found.filter("kind = 2").select(*OBJECT, "name", "next", "least", F.col("at").alias("far"), F.col("n").alias("span"), "n"))
    if not pieces.isEmpty():
        for _ in range(rounds):
            ahead = pieces.select(*OBJECT, F.col("name").alias("next"), F.col("next").alias("next2"), F.col("least").alias("least2"), F.col("far").alias("far2"), F.col("span").alias("span2"))
            better = F.col("least2") < F.col("least")
            both = pieces.join(ahead, [*OBJECT, "next"])
            pieces = saved(both.select(*OBJECT, "name", F.col("next2").alias("next"), F.least("least", "least2").alias("least"), F.when(better, F.col("span") + F.col("far2")).otherwise(F.col("far")).alias("far"), (F.col("span") + F.col("span2")).alias("span"), "n", better.alias("changed")))
            if pieces.filter("changed").isEmpty():
                break
        else:
            raise RuntimeError(f"outlines are in more than 2 ** {rounds} pieces")
        lengths = pieces.groupBy(*OBJECT, "least").agg(F.sum("n").alias("n"))
        placed = pieces.select(*OBJECT, "name", "least", "far").join(lengths, [*OBJECT, "least"])
        loose = found.filter("kind = 1").select(*OBJECT, "name", "at", "y", "x").join(placed, [*OBJECT, "name"])
        k = F.row_number().over(Window.partitionBy(*OBJECT, "least").orderBy(F.pmod(F.col("at") - F.col("far"), F.col("n")))).cast("long") - 1
        turns = turns.unionByName(loose.select(*OBJECT, "least", k.alias("k"), "y", "x"))
        outlines = outlines.unionByName(lengths.select(*OBJECT, "least"))
    outlines = outlines.withColumn("ring", F.row_number().over(Window.partitionBy(*OBJECT).orderBy("least")).cast("long") - 1)
    return turns.join(outlines, [*OBJECT, "least"]).select(*OBJECT, "ring", "k", "y", "x")


def areas(outlines: DataFrame) -> DataFrame:
    """``image, label, ring, area`` by the shoelace formula: positive for outer outlines, negative for holes."""
    n = outlines.groupBy(*OBJECT, "ring").agg(F.count(F.lit(1)).alias("n"))
    rows = outlines.join(n, [*OBJECT, "ring"])
    ahead = rows.select(*OBJECT, "ring", F.pmod(F.col("k") - 1, F.col("n")).alias("k"), F.col("y").alias("y2"), F.col("x").alias("x2"))
    term = F.col("x") * F.col("y2") - F.col("x2") * F.col("y")
    return rows.join(ahead, [*OBJECT, "ring", "k"]).groupBy(*OBJECT, "ring").agg((F.sum(term) / 2).alias("area"))


def polygons(outlines: DataFrame) -> DataFrame:
    """``image, label, ring, coordinates``: closed rings of [x, y], as documents of features have them; one row holds a ring."""
    points = F.array_sort(F.collect_list(F.struct("k", F.array("x", "y").alias("at"))))
    rings = outlines.groupBy(*OBJECT, "ring").agg(F.transform(points, lambda p: p["at"]).alias("c"))
    return rings.select(*OBJECT, "ring", F.concat("c", F.slice("c", 1, 1)).alias("coordinates"))


def _chain(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The lower envelope of points in order of their first number."""
    kept: list[tuple[int, int]] = []
    for p in points:
        while len(kept) > 1 and (kept[-1][0] - kept[-2][0]) * (p[1] - kept[-2][1]) <= (kept[-1][1] - kept[-2][1]) * (p[0] - kept[-2][0]):
            kept.pop()
        kept.append(p)
    return kept


def hulls(labels: DataFrame) -> DataFrame:
    """``image, label, hull`` (corners of the convex hull of the middles of the pixels' sides, doubled: ``y2, x2``, in order of y2 along
    its left side and back along its right one), ``hull_area``, and ``convex_area``: pixels whose middle is in or on the hull.

    Only the ends of each row of an object can be corners, so an object is at most as long in its task as its image is high."""
    ends = labels.filter("label > 0").groupBy(*OBJECT, "y").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    one = F.struct(F.col("y").cast("long").alias("y"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    rows = ends.groupBy(*OBJECT).agg(F.array_sort(F.collect_list(one)).alias("r")).select(*OBJECT, *[F.col(f"r.{c}").alias(c) for c in "yab"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            corners, sizes, counts = [], [], []
            for ys, lefts, rights in zip(frame["y"], frame["a"], frame["b"], strict=True):
                least: dict[int, int] = {}
                most: dict[int, int] = {}
                for y, a, b in zip(ys.tolist(), lefts.tolist(), rights.tolist(), strict=True):
                    for at, low, high in ((2 * y - 1, 2 * a, 2 * b), (2 * y, 2 * a - 1, 2 * b + 1), (2 * y + 1, 2 * a, 2 * b)):
                        least[at] = min(low, least.get(at, low))
                        most[at] = max(high, most.get(at, high))
                left = _chain(sorted(least.items()))
                right = [(y, -x) for y, x in _chain(sorted((y, -x) for y, x in most.items()))]
                ring = left + right[::-1]
                twice = sum(p[1] * q[0] - q[1] * p[0] for p, q in zip(ring, ring[1:] + ring[:1], strict=True))
                inside, i, j = 0, 0, 0
                for y in range(int(ys[0]), int(ys[-1]) + 1):
                    while left[i + 1][0] < 2 * y:
                        i += 1
                    while right[j + 1][0] < 2 * y:
                        j += 1
                    # the hull's ends in this row as fractions, halved: whole numbers between them are pixels
                    (y0, x0), (y1, x1) = left[i], left[i + 1]
                    first = -((-(x0 * (y1 - y0) + (x1 - x0) * (2 * y - y0))) // (2 * (y1 - y0)))
                    (y0, x0), (y1, x1) = right[j], right[j + 1]
                    last = (x0 * (y1 - y0) + (x1 - x0) * (2 * y - y0)) // (2 * (y1 - y0))
                    inside += last - first + 1
                corners.append([{"y2": y, "x2": x} for y, x in ring])
                sizes.append(abs(twice) / 8)
                counts.append(inside)
            yield frame[OBJECT].assign(hull=corners, hull_area=sizes, convex_area=counts)

    kind, number = (labels.schema[c].dataType.simpleString() for c in OBJECT)
    return rows.mapInPandas(run, f"image {kind}, label {number}, hull array<struct<y2: bigint, x2: bigint>>, hull_area double, convex_area long")


def solidity(labels: DataFrame) -> DataFrame:
    """``image, label, area, convex_area, solidity``."""
    found = objects.sizes(labels).join(hulls(labels).drop("hull", "hull_area"), OBJECT)
    return found.withColumn("solidity", F.col("area") / F.col("convex_area"))


def _agreement(df: DataFrame, values: str) -> DataFrame:
    """Mean and sample variance (``{values}_mean``, ``{values}_var``) of 1 - |1 - a / b| over all values a, each with all b behind it.
    Each step is a column of its own, or all pairs would be made anew for each pair."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    df = df.withColumn("_p", F.flatten(F.transform(values, lambda a, i: F.transform(F.slice(values, i + 2, F.size(values)), lambda b: 1 - F.abs(1 - a / b)))))
    df = df.withColumn(f"{values}_mean", total("_p") / F.size("_p"))
    spread = F.transform("_p", lambda x: (x - F.col(f"{values}_mean")) * (x - F.col(f"{values}_mean")))
    return df.withColumn(f"{values}_var", total(spread) / (F.size("_p") - 1)).drop("_p")


def polygonality(shapes: DataFrame) -> DataFrame:
    """Scores of ``image, label, area, perimeter, neighbours, solidity, feret_min, feret_max``: how near an object is to a regular polygon
    of as many sides as it has neighbours, and to a regular hexagon (10 for one, no lower bound), and the spread of the latter's
    parts.  Null with fewer than three neighbours or without a perimeter.

    A hexagon's side and apothem are estimated from the perimeter, the least and greatest widths and the hull; each two estimates
    of its area and of its size are compared."""
    n, area, rim = F.col("neighbours"), F.col("area").cast("double"), F.col("perimeter")
    cot = 1 / F.tan(F.lit(math.pi) / n)
    side = rim / n
    size_ratio = 1 - F.abs(1 - side / F.sqrt(4 * area / (n * cot)))
    area_ratio = 1 - F.abs(1 - area / (0.25 * n * side * side * cot))
    root = math.sqrt(3)
    hull = area / F.col("solidity")
    hull_rim = 6 * F.sqrt(hull / (1.5 * root))
    wide, narrow = F.col("feret_max"), F.col("feret_min")
    sides = {"rim": rim / 6, "wide": wide / 2, "narrow": narrow / root, "hull": hull_rim / 6}
    apothems = {"rim": root * rim / 12, "wide": root * wide / 4, "narrow": narrow / 2, "hull": root * hull_rim / 12, "area": F.sqrt(4 * hull / (4.5 * root))}
    regular = [1.5 * root * sides[k] * sides[k] for k in ("rim", "wide", "narrow")]
    mixed = [3 * sides[s] * apothems[a] for s, a in (("rim", "wide"), ("rim", "narrow"), ("wide", "narrow"), ("hull", "rim"), ("hull", "wide"), ("hull", "narrow"))]
    rims = [F.sqrt(24 * area / root), F.sqrt(24 * hull / root), rim, hull_rim, 3 * wide, 6 * narrow / root]
    rims += [2 * area / apothems[k] for k in ("rim", "wide", "narrow", "hull", "area")] + [2 * hull / apothems[k] for k in ("rim", "wide", "narrow")]
    known = (n > 2) & (rim > 0)
    estimates = F.array(*regular, *mixed, hull, area)
    found = shapes.select(*OBJECT, *[F.when(known, c).alias(k) for k, c in {"polygonality": 10 * (size_ratio + area_ratio) / 2, "areas": estimates, "sizes": F.array(*rims)}.items()])
    found = _agreement(_agreement(found, "areas"), "sizes")
    return found.select(*OBJECT, "polygonality", (10 * (F.col("areas_mean") + F.col("sizes_mean")) / 2).alias("hexagonality"), F.sqrt((F.col("areas_var") + F.col("sizes_var")) / 2).alias("hexagonality_sd"))
