"""Statistics by name, scaling and rounding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def skewness(x: str | Column) -> Column:
    """Population skewness; null if all values are equal."""
    return F.when(F.stddev_pop(_c(x)) > 0, F.skewness(_c(x)))


def kurtosis(x: str | Column) -> Column:
    """Population excess kurtosis; null if all values are equal."""
    return F.when(F.stddev_pop(_c(x)) > 0, F.kurtosis(_c(x)))


METHODS: dict[str, Callable[[str | Column], Column]] = {
    "mean": lambda x: F.avg(_c(x)),
    "count": lambda x: F.count(_c(x)),
    "var": lambda x: F.var_pop(_c(x)),
    "std": lambda x: F.stddev_pop(_c(x)),
    #: Keeps a group's distinct values in one buffer: for small groups; ``tables.quantile`` is for any.
    "median": lambda x: F.percentile(_c(x), 0.5),
    "skewness": skewness,
    "kurtosis": kurtosis,
    "kurtosis_pearson": lambda x: kurtosis(x) + 3,
}


def significant(x: str | Column, digits: int = 6) -> Column:
    """Rounded to so many significant digits."""
    x = _c(x)
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, 0.0).otherwise(F.round(x * scale) / scale)


def levels(x: str | Column, low: str | Column, high: str | Column, top: int = 254) -> Column:
    """Level 1 to top + 1 of a value within its range (half to even); 1 where the range is empty."""
    x, low, high = _c(x), _c(low), _c(high)
    return F.when(high > low, F.bround((x - low) / (high - low) * top + 1)).otherwise(1).cast("long")


def z_score(x: str | Column, mean: str | Column, std: str | Column, most: float | None = None) -> Column:
    z = F.when(_c(std) > 0, (_c(x) - _c(mean)) / _c(std)).otherwise(0.0)
    return z if most is None else F.greatest(F.lit(-most), F.least(F.lit(most), z))
