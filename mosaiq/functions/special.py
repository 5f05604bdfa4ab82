"""Special functions and curves, as columns where they meet data."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from mosaiq.functions.distances import total


def log_gamma(x: Column) -> Column:
    """Series for the logarithm of the gamma function; 0 up to 1."""
    return F.when(x - 1 < 1e-6, 0.0).otherwise(x * F.ln(x) - x + 0.5 * F.ln(F.lit(2 * math.pi) / x) + 1 / (12 * x))


def log_beta(x: Column, y: Column) -> Column:
    """Logarithm of the beta function; a product where the smaller argument is below 5, as it then is taken whole."""
    low, high = F.least(x, y), F.greatest(x, y)
    steps = F.filter(F.sequence(F.lit(1), F.lit(5)), lambda i: i < F.floor(low))
    product = F.aggregate(steps, -F.ln(high), lambda s, i: s + F.ln(i) - F.ln(high + i))
    return F.when(low < 5, product).otherwise(log_gamma(x) + log_gamma(y) - log_gamma(x + y))


def log_single_beta(x: Column) -> Column:
    return F.lit(math.log(2.0)) * (-2 * x + 0.5) + 0.5 * F.ln(F.lit(2 * math.pi) / x) + 0.125 / x


def dirichlet(a: Column, b: Column) -> Column:
    """Distance of two vectors of counts as draws of one Dirichlet-multinomial; components up to 0.9 count as absent."""
    n1, n2 = total(a, b, lambda x, y: x), total(a, b, lambda x, y: y)
    both = lambda x, y: x * y > 0.9
    shared = total(a, b, lambda x, y: F.when(both(x, y), log_beta(x, y)).otherwise(0.0))
    own1 = total(a, b, lambda x, y: F.when(both(x, y) | (x > 0.9), log_single_beta(x)).otherwise(0.0))
    own2 = total(a, b, lambda x, y: F.when(both(x, y) | (y > 0.9), log_single_beta(y)).otherwise(0.0))
    joint = log_beta(n1, n2)
    return F.sqrt(F.greatest(F.lit(0.0), (shared - joint - (own2 - log_single_beta(n2))) / n2 + (shared - joint - (own1 - log_single_beta(n1))) / n1))


def count_distance(a: Column, b: Column, rate: float = 1.0, scale: float = 1.0) -> Column:
    """Sum of Poisson log likelihoods from the lower to the higher first component, the logarithm of the factorial growing
    step by step from that of the lower one."""
    x, y = (F.floor(F.get(v, F.lit(0)).cast("double")) for v in (a, b))
    low, high = F.least(x, y), F.greatest(x, y)
    below = F.filter(F.sequence(F.lit(2), F.lit(9)), lambda k: k < low)
    first = F.when(low < 2, 0.0).when(low < 10, F.aggregate(below, F.lit(0.0), lambda s, k: s + F.ln(k))).otherwise(log_gamma(low + 1.0))
    steps = F.when(high > low, F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>"))
    state = F.struct(F.lit(0.0).alias("s"), first.alias("f"))
    walked = F.aggregate(steps, state, lambda z, k: F.struct((z["s"] + k * math.log(rate) - rate - z["f"]).alias("s"), (z["f"] + F.when(k > 0, F.ln(k)).otherwise(0.0)).alias("f")))
    return walked["s"] / scale


def curve(spread: float, least: float, points: int = 300) -> tuple[float, float]:
    """a, b so that 1 / (1 + a x^2b) is nearest to 1 up to ``least`` and exp((least - x) / spread) beyond, on points up to
    three spreads; damped Gauss-Newton steps."""
    x = np.linspace(0, 3 * spread, points + 1)[1:]
    wanted = np.where(x <= least, 1.0, np.exp((least - x) / spread))
    p, damping = np.array([1.8, 0.7]), 1e-3
    value = lambda p: 1 / (1 + p[0] * x ** (2 * p[1]))
    error = lambda p: float(((value(p) - wanted) ** 2).sum())
    for _ in range(500):
        f, power = value(p), x ** (2 * p[1])
        slope = np.stack([-f * f * power, -f * f * p[0] * power * 2 * np.log(x)], axis=1)
        normal = slope.T @ slope
        step = np.linalg.solve(normal + damping * np.diag(np.diag(normal)), slope.T @ (wanted - f))
        if error(p + step) < error(p):
            p, damping = p + step, damping / 3
            if np.abs(step).max() < 1e-12:
                break
        else:
            damping *= 3
            if damping > 1e12:
                break
    return float(p[0]), float(p[1])


def membership(distance: Column, rho: Column, sigma: Column) -> Column:
    """How strongly a neighbour at a distance belongs: 1 up to rho, then falling by sigma."""
    return F.when(distance <= rho, 1.0).otherwise(F.exp(-(distance - rho) / sigma))
