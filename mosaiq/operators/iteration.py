"""What loops over DataFrames share: each round is written to the checkpoint folder, so a lost executor costs a reread."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"


def by_rows(df: DataFrame) -> DataFrame:
    """For a join by sorting.  Spark sends what has few bytes as a file to the driver and from there to all, but rows of small numbers take
    many times their file there."""
    return df.hint("merge")


def written(df: DataFrame) -> DataFrame:
    """The rows, computed once, with no lineage behind them."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(_folder(spark))
    return df.checkpoint()


def saved(df: DataFrame) -> DataFrame:
    """As ``written``, but as a Parquet table, which is read by column.  A checkpoint hands on what is known of its columns, and in loops
    that give the same names again and again this grows with each round; a table starts anew."""
    spark = df.sparkSession
    path = f"{_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
