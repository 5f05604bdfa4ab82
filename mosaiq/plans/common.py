"""What the registered queries share."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.operators import raster
from mosaiq.operators.iteration import by_rows

Query = Callable[[SparkSession, str], DataFrame]
SIDE = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Plans:
    """Queries and their SQL by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(query: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"two queries named {name}")
            self.queries[name] = query
            if sql is not None:
                self.oracle[name] = sql
            return query

        return keep


def lines_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three images of 24 x 24 pixels: line items counted by flag and by two keys modulo the side."""
    lines = table(spark, sf_dir, "lineitem")
    counts = lines.groupBy(F.col("l_returnflag").alias("image"), (F.col("l_orderkey") % SIDE).alias("y"), (F.col("l_partkey") % SIDE).alias("x")).agg(F.count(F.lit(1)).alias("v"))
    return raster.dense(counts, SIDE, SIDE)


RASTER = f"""raw AS (SELECT l_returnflag AS image, l_orderkey % {SIDE} AS y, l_partkey % {SIDE} AS x, count(*) AS v FROM lineitem GROUP BY ALL),
px AS (SELECT i.image AS image, a.range AS y, b.range AS x, coalesce(v, 0) AS v FROM (SELECT DISTINCT image FROM raw) AS i, range({SIDE}) AS a, range({SIDE}) AS b
  LEFT JOIN raw ON raw.image = i.image AND raw.y = a.range AND raw.x = b.range)"""


def grown_raster(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Three images whose side grows as the root of the table, some ten line items a pixel, and that side."""
    lines = table(spark, sf_dir, "lineitem")
    side = max(SIDE, math.isqrt(lines.count() // 30))
    counts = lines.groupBy(F.col("l_returnflag").alias("image"), (F.col("l_orderkey") % side).alias("y"), (F.col("l_partkey") % side).alias("x")).agg(F.count(F.lit(1)).alias("v"))
    return raster.dense(by_rows(counts), side, side), side


GROWN = f"""sd AS (SELECT greatest({SIDE}, CAST(floor(sqrt(count(*) // 30)) AS BIGINT)) AS side FROM lineitem),
raw AS (SELECT l_returnflag AS image, l_orderkey % side AS y, l_partkey % side AS x, count(*) AS v FROM lineitem, sd GROUP BY ALL),
px AS (SELECT i.image AS image, a.y AS y, b.x AS x, coalesce(v, 0) AS v FROM (SELECT DISTINCT image FROM raw) AS i, (SELECT unnest(range(side)) AS y FROM sd) AS a, (SELECT unnest(range(side)) AS x FROM sd) AS b
  LEFT JOIN raw ON raw.image = i.image AND raw.y = a.y AND raw.x = b.x)"""
