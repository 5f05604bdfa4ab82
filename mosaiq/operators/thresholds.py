"""Automatic thresholds from histograms.

A histogram has one row for each image and value; running sums over it give all candidate thresholds of an image at
once.  Pixels above the threshold are foreground.  ``rosin`` is the corner of a histogram with one peak, which is the
triangle from that peak to the last value.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image", "v").agg(F.count(F.lit(1)).alias("n"))


def candidates(hist: DataFrame) -> DataFrame:
    """Numbers, sums and means at or below (0) and above (1) each value."""
    every = Window.partitionBy("image")
    upto = every.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    out = hist.select("image", "v", "n", F.sum("n").over(upto).alias("n0"), F.sum(F.col("n") * F.col("v")).over(upto).alias("s0"), F.sum("n").over(every).alias("total"), F.sum(F.col("n") * F.col("v")).over(every).alias("sum"))
    out = out.withColumns({"n1": F.col("total") - F.col("n0"), "s1": F.col("sum") - F.col("s0")})
    return out.withColumns({"m0": F.col("s0") / F.col("n0"), "m1": F.when(F.col("n1") > 0, F.col("s1") / F.greatest("n1", F.lit(1)))})


def otsu(hist: DataFrame) -> DataFrame:
    """Greatest variance between classes; the least value of those that tie."""
    score = F.round(F.col("n0") * F.col("n1") * (F.col("m0") - F.col("m1")) * (F.col("m0") - F.col("m1")) / (F.col("total") * F.col("total")), 9)
    found = candidates(hist).filter("n1 > 0").groupBy("image").agg(F.max(F.struct(score.alias("s"), (-F.col("v")).alias("k")))["k"].alias("k"))
    return found.select("image", (-F.col("k")).alias("threshold"))


def mean(hist: DataFrame) -> DataFrame:
    return hist.groupBy("image").agg(F.floor(F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("threshold"))


def isodata(hist: DataFrame) -> DataFrame:
    """The least value that is no less than the midpoint of the class means it makes."""
    able = candidates(hist).filter((F.col("n1") > 0) & (F.col("v") >= (F.col("m0") + F.col("m1")) / 2))
    return able.groupBy("image").agg(F.min("v").alias("threshold"))


def max_entropy(hist: DataFrame) -> DataFrame:
    """Greatest sum of the entropies of both classes."""
    every = Window.partitionBy("image")
    upto = every.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    nlogn = F.col("n") * F.ln("n")
    sums = hist.select("image", "v", F.sum("n").over(upto).alias("n0"), F.sum(nlogn).over(upto).alias("e0"), F.sum("n").over(every).alias("total"), F.sum(nlogn).over(every).alias("e"))
    n1 = F.col("total") - F.col("n0")
    entropy = F.ln("n0") - F.col("e0") / F.col("n0") + F.ln(n1) - (F.col("e") - F.col("e0")) / n1
    found = sums.filter(n1 > 0).groupBy("image").agg(F.max(F.struct(F.round(entropy, 9).alias("s"), (-F.col("v")).alias("k")))["k"].alias("k"))
    return found.select("image", (-F.col("k")).alias("threshold"))


def triangle(hist: DataFrame) -> DataFrame:
    """The value farthest below the line from the highest bar to the last one (the least of those that tie)."""
    every = Window.partitionBy("image")
    peak = F.max(F.struct("n", (-F.col("v")).alias("k"))).over(every)
    end = F.max(F.struct("v", "n")).over(every)
    line = hist.select("image", "v", "n", peak["n"].alias("pn"), (-peak["k"]).alias("pv"), end["v"].alias("ev"), end["n"].alias("en")).filter("v >= pv")
    below = F.when(F.col("ev") > F.col("pv"), F.col("pn") + (F.col("en") - F.col("pn")) * (F.col("v") - F.col("pv")) / (F.col("ev") - F.col("pv")) - F.col("n")).otherwise(0.0)
    found = line.groupBy("image").agg(F.max(F.struct(F.round(below, 9).alias("s"), (-F.col("v")).alias("k")))["k"].alias("k"))
    return found.select("image", (-F.col("k")).alias("threshold"))


def _least(scored: DataFrame, score: Column) -> DataFrame:
    """The value of the least score, rounded so that equal ones tie; then the least value."""
    found = scored.filter(score.isNotNull()).groupBy("image").agg(F.min(F.struct(F.round(score, 9).alias("s"), "v"))["v"].alias("threshold"))
    return found.select("image", "threshold")


def _running(hist: DataFrame, **terms: Column) -> DataFrame:
    """Sums of terms at or below (``{name}0``) and above (``{name}1``) each value."""
    every = Window.partitionBy("image")
    upto = every.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    out = hist.withColumns({f"{k}0": F.sum(t).over(upto) for k, t in terms.items()} | {f"{k}_all": F.sum(t).over(every) for k, t in terms.items()})
    return out.withColumns({f"{k}1": F.col(f"{k}_all") - F.col(f"{k}0") for k in terms})


def li(hist: DataFrame) -> DataFrame:
    """Least cross entropy between the image and its two class means."""
    part = lambda k: F.when(F.col(f"s{k}") > 0, F.col(f"s{k}") * F.ln(f"m{k}")).otherwise(0.0)
    c = candidates(hist).filter("n1 > 0")
    return _least(c, -(part(0) + part(1)) / F.col("total"))


def min_error(hist: DataFrame) -> DataFrame:
    """Least classification error of two normal distributions."""
    c = _running(hist.withColumn("n", F.col("n").cast("double")), n=F.col("n"), s=F.col("n") * F.col("v"), q=F.col("n") * F.col("v") * F.col("v")).filter("n1 > 0")
    share = lambda k: F.col(f"n{k}") / F.col("n_all")
    spread = lambda k: F.col(f"q{k}") / F.col(f"n{k}") - F.pow(F.col(f"s{k}") / F.col(f"n{k}"), 2)
    error = lambda k: share(k) * F.ln(F.when(spread(k) > 1e-9, spread(k))) - 2 * share(k) * F.ln(share(k))
    return _least(c, 1 + error(0) + error(1))


def percentile(hist: DataFrame, share: float = 0.5) -> DataFrame:
    """The value at or below which nearest to ``share`` of the pixels lie."""
    return _least(candidates(hist), F.abs(F.col("n0") / F.col("total") - share))


def yen(hist: DataFrame) -> DataFrame:
    """Greatest correlation between the classes."""
    c = _running(hist.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("image"))), p=F.col("p"), q=F.col("p") * F.col("p")).filter("q1 > 1e-15")
    return _least(c, F.ln(F.col("q0") * F.col("q1")) - 2 * F.ln(F.col("p0") * F.col("p1")))


def moments(hist: DataFrame) -> DataFrame:
    """The share of dark pixels in the two-valued image that has the same first three moments."""
    w = F.col("n") / F.sum("n").over(Window.partitionBy("image"))
    m = hist.withColumn("w", w).groupBy("image").agg(*[F.sum(F.col("w") * F.pow("v", F.lit(k))).alias(f"m{k}") for k in (1, 2, 3)])
    cd = F.col("m2") - F.col("m1") * F.col("m1")
    m = m.withColumns({"c0": (F.col("m1") * F.col("m3") - F.col("m2") * F.col("m2")) / cd, "c1": (F.col("m1") * F.col("m2") - F.col("m3")) / cd})
    root = F.sqrt(F.col("c1") * F.col("c1") - 4 * F.col("c0"))
    z0, z1 = (-F.col("c1") - root) / 2, (-F.col("c1") + root) / 2
    m = m.select("image", ((z1 - F.col("m1")) / (z1 - z0)).alias("dark"))
    return candidates(hist).join(m, "image").filter(F.round(F.col("n0") / F.col("total") - F.col("dark"), 9) > 0).groupBy("image").agg(F.min("v").alias("threshold"))


def ij1(hist: DataFrame) -> DataFrame:
    """Fixed point of the mean of the class means, sought from the darkest value upwards one step at a time."""
    following = F.lead("v").over(Window.partitionBy("image").orderBy("v"))
    c = candidates(hist).withColumn("after", following).filter("n1 > 0").withColumn("mid", (F.col("m0") + F.col("m1")) / 2)
    found = c.filter(F.col("after") + 1 > F.col("mid")).groupBy("image").agg(F.min(F.struct("v", "mid"))["mid"].alias("mid"))
    return found.select("image", F.floor(F.round(F.col("mid"), 9) + 0.5).alias("threshold"))


def _each_pair(hist: DataFrame) -> DataFrame:
    """Each value as a threshold ``v`` beside every value ``u``; a histogram has a bounded number of bins."""
    own = hist.select("image", F.col("v").alias("u"), F.col("n").alias("nu"))
    c = candidates(hist).filter("n1 > 0").select("image", "v", "n0", "n1", "m0", "m1", "total")
    return c.join(own, "image")


def huang(hist: DataFrame) -> DataFrame:
    """Least fuzziness: how near each value is to the mean of its class, relative to the range."""
    span = hist.groupBy("image").agg((F.max("v") - F.min("v")).alias("span"))
    mean = F.when(F.col("u") <= F.col("v"), F.col("m0")).otherwise(F.col("m1"))
    belongs = 1 / (1 + F.abs(F.col("u") - mean) / F.col("span"))
    entropy = F.when(belongs < 1 - 1e-12, -belongs * F.ln(belongs) - (1 - belongs) * F.ln(1 - belongs)).otherwise(0.0)
    each = _each_pair(hist).join(span, "image").groupBy("image", "v").agg((F.sum(F.col("nu") * entropy) / F.first("total")).alias("s"))
    return _least(each, F.col("s"))


def shanbhag(hist: DataFrame) -> DataFrame:
    """Least difference of the information that the two classes hold, each value weighted by how far it lies within."""
    w = Window.partitionBy("image").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    own = hist.select("image", F.col("v").alias("u"), F.col("n").alias("nu"), F.sum("n").over(w).alias("cu"))
    pairs = candidates(hist).filter("n1 > 0").select("image", "v", "n0", "n1", "total").join(own, "image")
    dark = F.when(F.col("u") <= F.col("v"), -F.col("nu") / F.col("n0") * F.ln(1 - 0.5 * (F.col("cu") - F.col("nu")) / F.col("n0")))
    light = F.when(F.col("u") > F.col("v"), -F.col("nu") / F.col("n1") * F.ln(1 - 0.5 * (F.col("total") - F.col("cu")) / F.col("n1")))
    each = pairs.groupBy("image", "v").agg(F.abs(F.sum(dark) - F.sum(light)).alias("s"))
    return _least(each, F.col("s") / 2)


def renyi(hist: DataFrame) -> DataFrame:
    """Blend of the thresholds of greatest Renyi entropy of orders 1/2, 1 and 2."""
    p = hist.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("image")))
    c = _running(p, p=F.col("p"), r=F.sqrt("p"), q=F.col("p") * F.col("p"), e=F.col("p") * F.ln("p")).filter("p1 > 1e-12 and q1 > 1e-15")
    half = 2 * F.ln(F.col("r0") * F.col("r1") / F.sqrt(F.col("p0") * F.col("p1")))
    one = F.ln("p0") - F.col("e0") / F.col("p0") + F.ln("p1") - F.col("e1") / F.col("p1")
    two = -F.ln(F.col("q0") * F.col("q1") / F.pow(F.col("p0") * F.col("p1"), 2))
    best = lambda score: F.max(F.struct(F.round(score, 9).alias("s"), (-F.col("v")).alias("k"), "p0"))
    found = c.groupBy("image").agg(F.sort_array(F.array(*[F.struct((-best(x)["k"]).alias("v"), best(x)["p0"].alias("p")) for x in (half, one, two)])).alias("t"))
    at = lambda i, k: F.col("t")[i][k]
    low, high = at(1, "v") - at(0, "v") <= 5, at(2, "v") - at(1, "v") <= 5
    b1, b2, b3 = (F.when(low == high, same).when(low, first).otherwise(last) for same, first, last in ((1, 0, 3), (2, 1, 1), (1, 3, 0)))
    omega = at(2, "p") - at(0, "p")
    blend = at(0, "v") * (at(0, "p") + 0.25 * omega * b1) + 0.25 * at(1, "v") * omega * b2 + at(2, "v") * (1 - at(2, "p") + 0.25 * omega * b3)
    return found.select("image", F.floor(F.round(blend, 9)).alias("threshold"))


def _bins(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts of each whole value from the least to the greatest."""
    return np.bincount((values - values.min()).astype(np.int64), counts).astype(float)


def _peaks(bins: np.ndarray) -> np.ndarray:
    return np.flatnonzero((bins[1:-1] > bins[:-2]) & (bins[1:-1] > bins[2:])) + 1


def two_modes(bins: np.ndarray, most_steps: int = 10_000) -> tuple[np.ndarray, np.ndarray]:
    """Bins smoothed by three-point means until no more than two peaks are left, and the peaks."""
    bins = np.concatenate([[0.0], bins, [0.0]])
    for _ in range(most_steps):
        peaks = _peaks(bins)
        if len(peaks) <= 2:
            return bins[1:-1], peaks - 1
        bins[1:-1] = (bins[:-2] + bins[1:-1] + bins[2:]) / 3
    raise RuntimeError(f"the histogram has more than two modes after {most_steps} steps")


def _intermodes(bins: np.ndarray) -> float:
    _, peaks = two_modes(bins)
    return float(peaks.sum() // 2) if len(peaks) == 2 else float(peaks[0])


def _minimum(bins: np.ndarray) -> float:
    smooth, peaks = two_modes(bins)
    return float(peaks[0] + smooth[peaks[0] : peaks[1] + 1].argmin()) if len(peaks) == 2 else float(peaks[0])


def _max_likelihood(bins: np.ndarray, most_steps: int = 10_000) -> float:
    """Where two normal distributions, fitted by expectation and maximisation from both sides of the mean, are alike."""
    at = np.arange(len(bins), dtype=float)
    total, mean = bins.sum(), (bins * at).sum() / bins.sum()
    dark = (at <= mean).astype(float)
    before = None
    for _ in range(most_steps):
        weights = np.array([(bins * dark).sum(), (bins * (1 - dark)).sum()])
        if weights.min() <= 0:
            return float(np.floor(mean))
        means = np.array([(bins * dark * at).sum(), (bins * (1 - dark) * at).sum()]) / weights
        spread = np.maximum(np.array([(bins * dark * (at - means[0]) ** 2).sum(), (bins * (1 - dark) * (at - means[1]) ** 2).sum()]) / weights, 1 / 12)
        logs = [np.log(weights[k] / total) - np.log(spread[k]) / 2 - (at - means[k]) ** 2 / (2 * spread[k]) for k in (0, 1)]
        dark = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -700, 700)))
        now = np.concatenate([means, spread])
        if before is not None and np.abs(now - before).max() < 1e-9:
            break
        before = now
    inside = np.flatnonzero((at >= means[0]) & (dark >= 0.5))
    return float(inside.max()) if len(inside) else float(np.floor(mean))


def _each_histogram(rule: Callable[[np.ndarray], float]) -> Callable[[DataFrame], DataFrame]:
    """A rule over whole histograms: one row for each value of an image comes to its task, not its pixels."""

    def run(hist: DataFrame) -> DataFrame:
        def one(part: pd.DataFrame) -> pd.DataFrame:
            found = rule(_bins(part["v"].to_numpy(), part["n"].to_numpy()))
            return pd.DataFrame({"image": part["image"].iloc[:1], "threshold": [int(found + part["v"].min())]})

        kind = hist.schema["image"].dataType.simpleString()
        return hist.groupBy("image").applyInPandas(one, f"image {kind}, threshold long")

    return run


METHODS = {
    "otsu": otsu, "mean": mean, "isodata": isodata, "maxentropy": max_entropy, "triangle": triangle, "rosin": triangle, "li": li, "minerror": min_error, "percentile": percentile,
    "yen": yen, "moments": moments, "ij1": ij1, "huang": huang, "shanbhag": shanbhag, "renyi": renyi,
    "intermodes": _each_histogram(_intermodes), "minimum": _each_histogram(_minimum), "maxlikelihood": _each_histogram(_max_likelihood),
}


def apply(pixels: DataFrame, thresholds: DataFrame) -> DataFrame:
    """1 above the image's threshold, else 0."""
    return pixels.join(thresholds, "image").select("image", "y", "x", (F.col("v") > F.col("threshold")).cast("long").alias("v"))
