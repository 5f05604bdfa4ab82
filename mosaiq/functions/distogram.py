"""A histogram of bounded size that takes values one batch at a time and merges with others."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


@dataclass
class Distogram:
    """At most ``most`` bins, each the mean of its values and their number; the ends are kept as they are."""

    most: int = 32
    at: np.ndarray = field(default_factory=lambda: np.zeros(0))
    n: np.ndarray = field(default_factory=lambda: np.zeros(0))
    low: float = np.inf
    high: float = -np.inf

    def update(self, values: np.ndarray) -> Distogram:
        values = np.asarray(values, float)
        values = values[~np.isnan(values)]
        if not len(values):
            return self
        at, n = np.unique(values, return_counts=True)
        return self.merge(Distogram(self.most, at, n.astype(float), float(at[0]), float(at[-1])))

    def merge(self, other: Distogram) -> Distogram:
        at, inverse = np.unique(np.concatenate([self.at, other.at]), return_inverse=True)
        n = np.bincount(inverse, np.concatenate([self.n, other.n]), len(at))
        return Distogram(self.most, at, n, min(self.low, other.low), max(self.high, other.high)).trimmed()

    def trimmed(self) -> Distogram:
        """The nearest bins made one until no more than ``most`` are left; while there are many more, all of the narrowest
        quarter of the gaps that do not touch."""
        at, n = self.at, self.n
        while len(at) > self.most:
            gaps = np.diff(at)
            take = max(1, min(len(at) - self.most, len(gaps) // 4))
            chosen = np.zeros(len(gaps), bool)
            for g in np.argsort(gaps, kind="stable")[: 2 * take]:
                if chosen.sum() < take and not (g and chosen[g - 1]) and not (g + 1 < len(gaps) and chosen[g + 1]):
                    chosen[g] = True
            first = np.flatnonzero(chosen)
            at[first] = (at[first] * n[first] + at[first + 1] * n[first + 1]) / (n[first] + n[first + 1])
            n[first] += n[first + 1]
            keep = np.ones(len(at), bool)
            keep[first + 1] = False
            at, n = at[keep], n[keep]
        return Distogram(self.most, at, n, self.low, self.high)

    def quantile(self, share: float) -> float:
        """Between the middles of neighbouring bins, and from the ends to the outer ones, in proportion."""
        if not len(self.at):
            return float("nan")
        middle = np.cumsum(self.n) - self.n / 2
        return float(np.interp(share * self.n.sum(), np.concatenate([[0.0], middle, [self.n.sum()]]), np.concatenate([[self.low], self.at, [self.high]])))

    def moments(self) -> tuple[float, float]:
        """Mean and variance."""
        mean = float((self.at * self.n).sum() / self.n.sum())
        return mean, float((self.n * (self.at - mean) ** 2).sum() / self.n.sum())


def sketches(df: DataFrame, key: str, column: str, bins: int = 32, shares: dict[str, float] | None = None) -> DataFrame:
    """``key, at, n, low, high`` of each group and its quantiles by name: every task sketches its own rows, and only
    sketches meet."""
    kind, shares = df.schema[key].dataType.simpleString(), shares or {}
    schema = f"{key} {kind}, at array<double>, n array<double>, low double, high double"

    def row(name, d: Distogram) -> dict:
        return {key: name, "at": d.at.tolist(), "n": d.n.tolist(), "low": d.low, "high": d.high}

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for frame in frames:
            for name, part in frame.groupby(key, sort=False)[column]:
                held[name] = held.get(name, Distogram(bins)).update(part.to_numpy())
        yield pd.DataFrame([row(k, d) for k, d in held.items() if len(d.at)], columns=[key, "at", "n", "low", "high"])

    def merged(part: pd.DataFrame) -> pd.DataFrame:
        whole = Distogram(bins)
        for r in part.itertuples(index=False):
            whole = whole.merge(Distogram(bins, np.array(r.at), np.array(r.n), r.low, r.high))
        return pd.DataFrame([row(part[key].iloc[0], whole) | {name: whole.quantile(q) for name, q in shares.items()}])

    more = "".join(f", {name} double" for name in shares)
    return df.select(key, column).filter(df[key].isNotNull()).mapInPandas(partial, schema).groupBy(key).applyInPandas(merged, schema + more)
