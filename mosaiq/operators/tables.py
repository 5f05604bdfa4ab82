"""Feature tables: group statistics, scaling, reshaping."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.functions import statistics


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")]


#: Ranges of equal width that the values of a group are counted in before single values are.
RANGES = 1024


def order_values(df: DataFrame, keys: list[str], column: str, places: Callable[[Column], dict[str, Column]]) -> DataFrame:
    """``keys``, the values at some places (from 0) of each group's sorted values, and their number ``n``; ``places`` tells
    the places from that number.

    Values are first counted by ranges between the group's ends, so a group has at most ``RANGES`` rows there.  Only the
    ranges in which a place lies are then counted by value, each by itself.
    """
    named = [f"_key{i}" for i in range(len(keys))] or ["_key"]
    own = [F.col(k).alias(n) for k, n in zip(keys, named, strict=True)] if keys else [F.lit(1).alias("_key")]
    rows = df.filter(F.col(column).isNotNull()).select(*own, F.col(column).alias("_v"))
    met = lambda a, b, *more: a.join(b.select(*[F.col(n).alias(f"_o{n}") for n in named], *[c for c in b.columns if c not in named]), reduce(lambda p, q: p & q, [*more, *[F.col(n).eqNullSafe(F.col(f"_o{n}")) for n in named]]))
    ends = rows.groupBy(*named).agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"), F.count(F.lit(1)).alias("_n"))
    share = (F.col("_v").cast("double") - F.col("_a").cast("double")) / (F.col("_b").cast("double") - F.col("_a").cast("double"))
    placed = met(rows, ends).select(*named, "_v", "_n", F.when(F.col("_b") > F.col("_a"), F.floor(share * (RANGES - 1))).otherwise(0).alias("_range"))
    before = F.sum("_k").over(Window.partitionBy(*named).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    counts = placed.groupBy(*named, "_range").agg(F.count(F.lit(1)).alias("_k"), F.first("_n").alias("_n")).withColumn("_before", F.coalesce(before, F.lit(0)))
    wanted = places(F.col("_n"))
    holds = [(F.col("_before") <= p) & (p < F.col("_before") + F.col("_k")) for p in wanted.values()]
    hit = counts.filter(reduce(lambda p, q: p | q, holds)).select(*named, F.col("_range").alias("_r"), "_before")
    values = met(placed, hit, F.col("_range") == F.col("_r")).groupBy(*named, "_range", "_v").agg(F.count(F.lit(1)).alias("_k"), F.first("_before").alias("_before"), F.first("_n").alias("_n"))
    upto = F.sum("_k").over(Window.partitionBy(*named, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before")
    values = values.withColumn("_upto", upto)
    at = [F.min(F.when((F.col("_upto") > p) & (F.col("_upto") - F.col("_k") <= p), F.col("_v"))).alias(name) for name, p in wanted.items()]
    found = values.groupBy(*named).agg(*at, F.first("_n").alias("n"))
    return found.select(*[F.col(n).alias(k) for k, n in zip(keys, named, strict=False)], *wanted, "n")


def quantile(df: DataFrame, keys: list[str], column: str, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles of each group, between two values where the place is no whole number."""
    place = lambda n, q: F.lit(q) * (n - 1)
    found = order_values(df, keys, column, lambda n: {f"_{name}_{side}": f(F.round(place(n, q), 9)) for name, q in shares.items() for side, f in (("low", F.floor), ("high", F.ceil))})
    part = lambda q: place(F.col("n"), q) - F.floor(F.round(place(F.col("n"), q), 9))
    value = lambda name, q: F.col(f"_{name}_low") + (F.col(f"_{name}_high") - F.col(f"_{name}_low")) * part(q)
    return found.select(*keys, *[value(name, q).cast("double").alias(name) for name, q in shares.items()])


def group_statistics(df: DataFrame, keys: list[str], columns: list[str], methods: list[str]) -> DataFrame:
    """``{column}_{method}`` for each group: all but medians in one pass, each of these by ``quantile``."""
    direct = [statistics.METHODS[m](c).alias(f"{c}_{m}") for c in columns for m in methods if m != "median"]
    parts = [df.groupBy(*keys).agg(*direct)] if direct else []
    if "median" in methods:
        parts += [quantile(df, keys, c, {f"{c}_median": 0.5}) for c in columns]
    return reduce(lambda a, b: a.join(b, keys, "left"), parts)


def hinge_iqr(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Distance of the medians of the lower and the upper half of each group (the middle of an odd number in neither)."""
    def places(n: Column) -> dict[str, Column]:
        half = F.floor(n / 2)
        low, high = F.floor((half - 1) / 2), F.floor(half / 2)
        return {"a": low, "b": high, "c": n - half + low, "d": n - half + high, "first": F.lit(0)}

    found = order_values(df, keys, column, places)
    return found.select(*keys, F.coalesce((F.col("c") + F.col("d")) / 2.0 - (F.col("a") + F.col("b")) / 2.0, F.lit(0.0)).alias(f"{column}_iqr"))


def group_mean_join_back(df: DataFrame, key: Column, columns: list[str], name: str = "group", bounds: list[str] | None = None) -> DataFrame:
    """Every row with its group's means, and the least and greatest value of some columns, all of one aggregate."""
    keyed = df.withColumn(name, key)
    ends = [f(c).alias(f"{c}_{n}") for c in bounds or [] for n, f in (("min", F.min), ("max", F.max))]
    return keyed.join(keyed.groupBy(name).agg(*[F.avg(c).alias(f"{c}_mean") for c in columns], *ends), name)


def value_range(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the least and greatest value of each column."""
    return df.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("min", F.min), ("max", F.max))])


def drop_null_columns(df: DataFrame) -> DataFrame:
    """Without the columns that have no value at all (one pass of counts)."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if counts[c]])


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``; a struct minimum, so keys are reduced in each task."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    first = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("f"))
    return first.select(*keys, *[F.col(f"f.{c}").alias(c) for c in (*order, *rest)])


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key; every task keeps k of its own before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def gap_groups(df: DataFrame, keys: list[str], position: str, radius: float) -> DataFrame:
    """Sorted positions in groups that a gap of ``radius`` or more parts; ``group`` counts from 0."""
    w = Window.partitionBy(*keys).orderBy(position)
    gap = F.when(F.col(position) - F.lag(position).over(w) >= radius, 1).otherwise(0)
    return df.withColumn("gap", gap).withColumn("group", F.sum("gap").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("gap")


def merged_positions(df: DataFrame, keys: list[str], position: str, radius: float) -> DataFrame:
    """``keys``, ``position``, ``n``: sorted positions made one as long as each lies within ``radius`` of the mean of those
    before it.  A group is the few positions of one image, such as the centres of its wells."""
    return merged_within(df.withColumn("_within", F.lit(radius)), keys, position, "_within")


def merged_within(df: DataFrame, keys: list[str], position: str, within: str) -> DataFrame:
    """As ``merged_positions``, the radius of each group being a column."""
    sorted_list = F.array_sort(F.collect_list(F.col(position).cast("double")))
    start = F.struct(F.array().cast("array<struct<position:double,n:bigint>>").alias("done"), F.lit(0.0).alias("s"), F.lit(0).cast("bigint").alias("n"))
    closed = lambda z: F.when(z["n"] > 0, F.concat(z["done"], F.array(F.struct((z["s"] / z["n"]).alias("position"), z["n"].alias("n"))))).otherwise(z["done"])

    def step(z: Column, x: Column) -> Column:
        near = (z["n"] > 0) & (x - z["s"] / F.greatest(z["n"], F.lit(1)) < F.col("_r"))
        return F.struct(F.when(near, z["done"]).otherwise(closed(z)).alias("done"), F.when(near, z["s"] + x).otherwise(x).alias("s"), F.when(near, z["n"] + 1).otherwise(F.lit(1).cast("bigint")).alias("n"))

    each = df.groupBy(*keys).agg(sorted_list.alias("_l"), F.max(within).alias("_r"))
    return each.select(*keys, F.inline(F.aggregate("_l", start, step, closed)))
