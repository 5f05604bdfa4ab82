"""Stitching vectors: text lines that place files on a grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.operators.ranks import ranked

#: The line format (fixed value).
LINE = r"^file: (.*?); corr: (-?[0-9.]+); position: \((-?[0-9]+), (-?[0-9]+)\); grid: \((-?[0-9]+), (-?[0-9]+)\);?$"
FIELDS = [("file", "string"), ("corr", "double"), ("pos_x", "long"), ("pos_y", "long"), ("grid_x", "long"), ("grid_y", "long")]


def format_line(file: Column, corr: Column, pos_x: Column, pos_y: Column, grid_x: Column, grid_y: Column) -> Column:
    whole = [c.cast("string") for c in (corr, pos_x, pos_y, grid_x, grid_y)]
    return F.concat(F.lit("file: "), file, F.lit("; corr: "), whole[0], F.lit("; position: ("), whole[1], F.lit(", "), whole[2], F.lit("); grid: ("), whole[3], F.lit(", "), whole[4], F.lit(");"))


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """The fields of every line that has the format."""
    return lines.filter(F.col(column).rlike(LINE)).select(*[F.regexp_extract(column, LINE, i).cast(kind).alias(name) for i, (name, kind) in enumerate(FIELDS, 1)])


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path))


def write(vector: DataFrame, path: str) -> None:
    vector.select(format_line(*[F.col(n) for n, _ in FIELDS]).alias("value")).write.text(path)


def montage(files: DataFrame, row: str, column: str, height: int, width: int, spacing: int = 0) -> DataFrame:
    """Grid places from two variables: their dense ranks, times the tile size and spacing."""
    ranks = {variable: ranked(files.filter(F.col(variable).isNotNull()).select(variable).distinct(), [variable], name) for name, variable in (("grid_y", row), ("grid_x", column))}
    out = files.join(ranks[row], row).join(ranks[column], column)
    return out.withColumns({"pos_y": F.col("grid_y") * (height + spacing), "pos_x": F.col("grid_x") * (width + spacing)})


def merge(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All lines of several vectors, with the number of the vector they came from."""
    out = first.withColumn("vector", F.lit(1).cast("long"))
    for i, other in enumerate(others, 2):
        out = out.unionByName(other.withColumn("vector", F.lit(i).cast("long")))
    return out
