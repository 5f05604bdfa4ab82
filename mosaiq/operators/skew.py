"""Equi-joins of many rows with one row for each key, some of which may have a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.operators.iteration import saved

#: Keys that are broadcast, at most.
HOT = 1000


def looked_up(rows: DataFrame, lookup: DataFrame, key: str, hot: int = HOT) -> DataFrame:
    """``rows`` with the columns of ``lookup``, which has one row for each ``key``.

    Keys that more than one of ``hot`` shares of the rows have are fewer than ``hot``: these rows meet a broadcast, the others
    meet by hash, where no key has more than that share.  ``rows`` are read three times, so write them before."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = rows.count()
    often = saved(counts.filter(F.col("_n") > max(1, total // hot)).drop("_n"))
    there = saved(lookup.join(F.broadcast(often), key, "left_semi"))
    rest = rows.join(F.broadcast(often), key, "left_anti").join(lookup, key)
    return rows.join(F.broadcast(there), key).unionByName(rest)
