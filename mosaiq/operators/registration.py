"""Projective maps between images from matched points of which many are wrong."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.operators.iteration import saved
from mosaiq.operators.skew import looked_up

POINTS = ["x1", "y1", "x2", "y2"]


@dataclass(frozen=True)
class Consensus:
    #: Maps that are tried for each pair of images, each from four matches.
    hypotheses: int = 300
    #: Matches of a pair that these are taken from, those of the least hashes; all matches are counted.
    sample: int = 1000
    #: How far a match may be from where a map puts it.
    tolerance: float = 2.0
    #: Times that the best map is fitted anew to all matches that agree with it.
    refits: int = 3
    #: Matches of a pair that meet its maps as one row.
    block: int = 256


def equations(p: np.ndarray) -> np.ndarray:
    """Two equations for the nine numbers of a map from each match (x1, y1, x2, y2)."""
    x, y, u, v = p.T
    zero, one = np.zeros_like(x), np.ones_like(x)
    first = np.stack([x, y, one, zero, zero, zero, -u * x, -u * y, -u], axis=1)
    second = np.stack([zero, zero, zero, x, y, one, -v * x, -v * y, -v], axis=1)
    return np.concatenate([first, second])


def _least(a: np.ndarray) -> np.ndarray:
    """The direction in which a sum of squares is least."""
    return np.linalg.eigh(a)[1][:, 0]


def errors(maps: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Distance of each match from where each map (a row of nine) puts it; infinite where it puts it nowhere."""
    at = np.stack([p[:, 0], p[:, 1], np.ones(len(p))])
    out = maps.reshape(-1, 3, 3) @ at
    with np.errstate(divide="ignore", invalid="ignore"):
        far = np.hypot(out[:, 0] / out[:, 2] - p[:, 2], out[:, 1] / out[:, 2] - p[:, 3])
    return np.where(np.isfinite(far), far, np.inf)


def homographies(matches: DataFrame, how: Consensus = Consensus()) -> DataFrame:
    """``pair, h, agreeing, n``: for each pair of images the nine numbers (row by row, the last is 1) of the map that most matches agree with,
    how many do, and how many there are.

    ``matches`` are ``pair, m, x1, y1, x2, y2``.  Each pair's trial maps are one row; all matches meet them in blocks, by a join that
    splits pairs with many matches off, and each task counts for each map before the counts meet.  The best (of equals the first) is fitted anew
    by sums of squares, whose size is fixed.  Pairs with fewer than four matches are left out, as are matches with a null.
    """
    keep = saved(matches.select("pair", "m", *[F.col(c).cast("double") for c in POINTS]).dropna())
    kind = matches.schema["pair"].dataType.simpleString()
    # coordinates are moved and shrunk to about 1, so that the equations are even
    scale = keep.groupBy("pair").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in POINTS], *[(F.stddev_pop(c)).alias(f"s_{c}") for c in POINTS]).filter("n >= 4")
    scale = saved(scale.withColumns({f"s_{c}": F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0) for c in POINTS}))
    scales = [f"{a}_{c}" for a in "ms" for c in POINTS]

    def even(frame: pd.DataFrame) -> np.ndarray:
        return np.stack([(frame[c] - frame[f"m_{c}"]) / frame[f"s_{c}"] for c in POINTS], axis=1)

    few = F.row_number().over(Window.partitionBy("pair").orderBy(F.xxhash64("pair", "m"), "m"))
    drawn = keep.withColumn("few", few).filter(F.col("few") <= how.sample).join(F.broadcast(scale) if scale.count() <= 10_000 else scale, "pair")

    def back(h: np.ndarray, row: pd.Series) -> np.ndarray:
        """A map between even coordinates as one between those of the images."""
        one = np.array([[1 / row["s_x1"], 0, -row["m_x1"] / row["s_x1"]], [0, 1 / row["s_y1"], -row["m_y1"] / row["s_y1"]], [0, 0, 1]])
        two = np.array([[row["s_x2"], 0, row["m_x2"]], [0, row["s_y2"], row["m_y2"]], [0, 0, 1]])
        return (two @ h.reshape(3, 3) @ one).ravel()

    def tries(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("few")
        p, chance = even(part), np.random.default_rng(0)
        maps = []
        for _ in range(how.hypotheses):
            q = equations(p[chance.choice(len(p), 4, replace=False)])
            maps.append(back(_least(q.T @ q), part.iloc[0]))
        return pd.DataFrame({"pair": [part["pair"].iloc[0]], "maps": [np.concatenate(maps)]})

    maps = saved(drawn.groupBy("pair").applyInPandas(tries, f"pair {kind}, maps array<double>"))

    def in_blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for pair, part in frame.groupby("pair", sort=False):
                rows = [part[POINTS].to_numpy()[a : a + how.block].ravel() for a in range(0, len(part), how.block)]
                yield pd.DataFrame({"pair": [pair] * len(rows), "points": pd.Series(rows, dtype=object)})

    # the trial maps of a pair are larger than a match by far, so they meet blocks of matches
    blocks = saved(keep.select("pair", *POINTS).mapInPandas(in_blocks, f"pair {kind}, points array<double>"))

    def added(one: Callable[[pd.Series, np.ndarray, np.ndarray], np.ndarray], value: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        """What ``one`` gives for the blocks of each pair, summed within a task: a row for each number."""

        def told(sums: dict) -> Iterator[pd.DataFrame]:
            for pair, s in sums.items():
                yield pd.DataFrame({"pair": pair, "k": np.arange(len(s)), value: s})

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums: dict = {}
            for frame in frames:
                for _, row in frame.iterrows():
                    s = one(row, row["points"].reshape(-1, 4), row["maps"].reshape(-1, 9))
                    sums[row["pair"]] = sums[row["pair"]] + s if row["pair"] in sums else s
                    if len(sums) >= 1000:
                        yield from told(sums)
                        sums = {}
            yield from told(sums)

        return run

    def near(_: pd.Series, p: np.ndarray, tried: np.ndarray) -> np.ndarray:
        return (errors(tried, p) <= how.tolerance).sum(axis=1)

    def squares(row: pd.Series, p: np.ndarray, now: np.ndarray) -> np.ndarray:
        p = p[errors(now, p)[0] <= how.tolerance]
        if not len(p):
            return np.zeros(81)
        q = equations(np.stack([(p[:, k] - row[f"m_{c}"]) / row[f"s_{c}"] for k, c in enumerate(POINTS)], axis=1))
        return (q.T @ q).ravel()

    counted, summed = added(near, "n"), added(squares, "s")
    counts = looked_up(blocks, maps, "pair").mapInPandas(counted, f"pair {kind}, k long, n long").groupBy("pair", "k").agg(F.sum("n").alias("n"))
    best = counts.groupBy("pair").agg(F.max_by("k", F.struct("n", -F.col("k"))).alias("k"))
    best = saved(maps.join(best, "pair").select("pair", F.expr("slice(maps, cast(9 * k + 1 as int), 9)").alias("maps")))

    def fitted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"pair": frame["pair"], "maps": pd.Series([back(_least(np.reshape(row["s"], (9, 9))), row) for _, row in frame.iterrows()], frame.index, object)})

    for _ in range(how.refits):
        sums = looked_up(blocks, best.join(scale, "pair"), "pair").mapInPandas(summed, f"pair {kind}, k long, s double").groupBy("pair", "k").agg(F.sum("s").alias("s"))
        whole = sums.groupBy("pair").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda x: x["s"]).alias("s"))
        best = saved(whole.join(scale, "pair").select("pair", "s", *scales).mapInPandas(fitted, f"pair {kind}, maps array<double>"))
    agreeing = looked_up(blocks, best, "pair").mapInPandas(counted, f"pair {kind}, k long, n long").groupBy("pair").agg(F.sum("n").alias("agreeing"))
    out = best.join(agreeing, "pair").join(scale.select("pair", "n"), "pair")
    return out.select("pair", F.transform("maps", lambda x: x / F.get("maps", F.lit(8))).alias("h"), "agreeing", "n")
