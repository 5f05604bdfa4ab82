"""Shading that all images of a collection share, and light that one channel takes from others."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.operators.iteration import saved


@dataclass(frozen=True)
class Fit:
    #: Side of the field that is fitted; images are averaged to it, so it bounds what meets at the driver.
    size: int = 64
    #: Cosine terms of the field below this share of the greatest (but for the constant one) are left out.
    smooth: float = 0.0005
    #: With a dark field, whose fit is less certain at each place: the highest sum of both orders of a cosine term.
    order_with_dark: int = 6
    #: What a residue weighs: 1 / (its share of the mean + this).
    softness: float = 0.005
    settled: float = 1e-5
    rounds: int = 100
    #: Rounds after which the terms that the field is made of stay the same, so that it can settle.
    choosing: int = 10


def cosines(n: int) -> np.ndarray:
    """The orthonormal cosine transform of n values."""
    k, x = np.mgrid[:n, :n]
    c = np.cos(np.pi * k * (2 * x + 1) / (2 * n)) * np.sqrt(2 / n)
    c[0] /= np.sqrt(2)
    return c


def large_terms(field: np.ndarray, share: float) -> np.ndarray:
    """Which cosine terms of a field have at least a share of the greatest; the constant one always counts."""
    rows, columns = (cosines(n) for n in field.shape)
    size = np.abs(rows @ field @ columns.T)
    size[0, 0] = 0
    kept = size >= share * size.max() if size.any() else np.zeros(field.shape, bool)
    kept[0, 0] = True
    return kept


def smoothed(field: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """The field by some of its cosine terms."""
    rows, columns = (cosines(n) for n in field.shape)
    return rows.T @ np.where(kept, rows @ field @ columns.T, 0) @ columns


def averaged(pixels: DataFrame, height: int, width: int, size: int) -> tuple[DataFrame, tuple[int, int]]:
    """``image, v``: each image as one row of means over equal blocks, and the shape that these have.  An image that lacks a block is
    left out."""
    h, w = min(size, height), min(size, width)
    at = [F.expr(f"cast(y * {h} div {height} as bigint)").alias("by"), F.expr(f"cast(x * {w} div {width} as bigint)").alias("bx")]
    blocks = pixels.groupBy("image", *at).agg(F.avg("v").alias("v"))
    rows = blocks.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("by", "bx", "v"))).alias("a"))
    return rows.filter(F.size("a") == h * w).select("image", F.transform("a", lambda p: p["v"].cast("double")).alias("v")), (h, w)


def flat_field(pixels: DataFrame, height: int, width: int, dark: bool = False, how: Fit = Fit()) -> tuple[np.ndarray, np.ndarray]:
    """The shading (mean 1) and, with ``dark``, the light that is there without any, of dense images ``image, y, x, v``.

    Each image is a brightness times the shading, plus the dark field, plus few pixels of objects.  Steps in turn: brightness of each
    image, then for each place the weighted line through all images, then the shading's large cosine terms.  What is far from
    the fit weighs little in the next step.  Each task sums its images; the driver has fields of bounded size only.  A fit that
    does not settle is an error, as are images without any light.
    """
    rows, shape = averaged(pixels, height, width, how.size)
    rows = saved(rows)
    s, d = np.ones(shape), np.zeros(shape)
    kept = np.add.outer(np.arange(shape[0]), np.arange(shape[1])) <= how.order_with_dark
    if rows.isEmpty():
        raise ValueError("there is no whole image")

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((5, s.size))
        flat, without = s.ravel(), d.ravel()
        for frame in frames:
            for v in frame["v"]:
                weight = np.ones(s.size)
                for _ in range(4):
                    b = (weight * (v - without) * flat).sum() / (weight * flat * flat).sum()
                    weight = 1 / (np.abs(v - without - b * flat) / max(abs(v.mean()), 1e-12) + how.softness)
                total += weight * np.stack([np.ones(s.size), np.full(s.size, b), np.full(s.size, b * b), v, b * v])
        yield pd.DataFrame({"place": np.arange(s.size), **{c: total[i] for i, c in enumerate(("w", "wb", "wbb", "wv", "wbv"))}})

    for turn in range(how.rounds):
        found = rows.select("v").mapInPandas(sums, "place long, w double, wb double, wbb double, wv double, wbv double")
        met = found.groupBy("place").agg(*[F.sum(c).alias(c) for c in ("w", "wb", "wbb", "wv", "wbv")]).toPandas().sort_values("place")
        w, wb, wbb, wv, wbv = (met[c].to_numpy().reshape(shape) for c in ("w", "wb", "wbb", "wv", "wbv"))
        if dark:
            spread = np.maximum(w * wbb - wb * wb, 1e-12)
            slope = (w * wbv - wb * wv) / spread
            base = smoothed((wv - slope * wb) / w, kept)
        else:
            slope, base = wbv / np.maximum(wbb, 1e-300), d
            kept = large_terms(slope, how.smooth) if turn < how.choosing else kept
        slope = smoothed(slope, kept)
        if not slope.mean() > 0:
            raise ValueError("the images have no light in common")
        new = slope / slope.mean()
        if dark:
            base = base - (base / np.maximum(new, 1e-6)).min() * new
        change = max(np.abs(new - s).max(), np.abs(base - d).max() / max(1.0, np.abs(base).max()))
        s, d = new, base
        if change < how.settled:
            return s, d
    raise RuntimeError(f"the shading did not settle within {how.rounds} rounds")


def field_table(pixels: DataFrame, field: np.ndarray, name: str) -> DataFrame:
    """``y, x`` and the values of a small field."""
    y, x = np.mgrid[: field.shape[0], : field.shape[1]]
    return pixels.sparkSession.createDataFrame(pd.DataFrame({"y": y.ravel(), "x": x.ravel(), name: field.ravel()}))


def normal_equations(pixels: DataFrame, channels: list[int], radius: int = 1) -> DataFrame:
    """``target, i, j, s, n``: sums of products of what a regression of channel ``target`` on the others' surroundings needs, over pixels whose
    surroundings are whole.

    ``pixels`` are ``image, y, x, channel, v``.  Term 0 is the constant, then each other channel's window row by row, and the last the
    target itself; i <= j.  Each task sums its pixels' products first."""
    side = 2 * radius + 1
    wide = pixels.groupBy("image", "y", "x").agg(*[F.max(F.when(F.col("channel") == c, F.col("v").cast("double"))).alias(f"c{k}") for k, c in enumerate(channels)])
    values = F.array(*[F.col(f"c{k}") for k in range(len(channels))])
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)])
    near = wide.select("image", "y", "x", values.alias("a"), F.explode(steps).alias("o")).filter(~F.exists("a", lambda v: v.isNull()))
    near = near.select("image", (F.col("y") - F.col("o.dy")).alias("y"), (F.col("x") - F.col("o.dx")).alias("x"), F.struct("o", "a").alias("p"))
    windows = near.groupBy("image", "y", "x").agg(F.array_sort(F.collect_list("p")).alias("w")).filter(F.size("w") == side * side)
    flat = windows.select(F.flatten(F.transform("w", lambda p: p["a"])).alias("a"))
    n_channels, middle = len(channels), side * side // 2

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = None, 0
        for frame in frames:
            if len(frame):
                x = np.stack(frame["a"].to_numpy()).reshape(len(frame), side * side, n_channels)
                each = []
                for t in range(n_channels):
                    others = [x[:, :, k] for k in range(n_channels) if k != t]
                    z = np.column_stack([np.ones(len(x)), *others, x[:, middle, t]])
                    each.append(z.T @ z)
                total = np.stack(each) if total is None else total + np.stack(each)
                count += len(x)
        if total is not None:
            i, j = np.triu_indices(total.shape[1])
            for t, c in enumerate(channels):
                yield pd.DataFrame({"target": c, "i": i, "j": j, "s": total[t][i, j], "n": count})

    found = flat.mapInPandas(partial, "target long, i long, j long, s double, n long")
    return found.groupBy("target", "i", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def bleed_through(pixels: DataFrame, channels: list[int], radius: int = 1, ridge: float = 1e-6) -> dict[int, np.ndarray]:
    """For each channel the constant and the share that it takes from each place around in each other channel (other, row, column): the
    ridge solution, whose size is that of a window of all channels.  Channels without whole windows are left out."""
    side = 2 * radius + 1
    sums: dict[int, list] = {}
    for r in normal_equations(pixels, channels, radius).toLocalIterator():
        sums.setdefault(r["target"], []).append(r)
    found = {}
    for t, rows in sums.items():
        m = 1 + max(r["j"] for r in rows)
        a = np.zeros((m, m))
        for r in rows:
            a[r["i"], r["j"]] = a[r["j"], r["i"]] = r["s"] / r["n"]
        terms = a[:-1, :-1]
        damp = ridge * np.trace(terms) / len(terms) * np.eye(len(terms))
        damp[0, 0] = 0
        found[t] = np.linalg.solve(terms + damp, a[:-1, -1])
    return {t: np.concatenate([x[:1], x[1:].reshape(len(channels) - 1, side, side).ravel()]) for t, x in found.items()}
