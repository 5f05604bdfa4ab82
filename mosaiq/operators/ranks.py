"""Ranks over whole tables, without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.operators.iteration import written


def ranked(values: DataFrame, order: list[str | Column], name: str = "rank") -> DataFrame:
    """Distinct rows numbered from 0 in an order: sorted by ranges, one beside the other, then each range begins where those
    before it end.  Only one row for each range meets in one task."""
    placed = values.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(placed.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return placed.join(bases, "_part").withColumn(name, F.col("_base") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_base")
