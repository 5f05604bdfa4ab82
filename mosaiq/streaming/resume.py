"""Fetching what is new since the last time, as a batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def last_fetched(spark: SparkSession, state: str):
    """The greatest date of all fetches so far; None before the first."""
    try:
        return spark.read.schema("upto string").json(state).agg(F.max("upto").alias("m")).first()["m"]
    except Exception as problem:  # the folder is made by the first fetch
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return None


def fetch(source: DataFrame, date: str, target: str, state: str) -> int:
    """Appends the source's rows of later dates than those fetched before to ``target``, and tells how many.

    Dates are text that sorts as time does (``2024-01-31``).  The rows are written before the date is: a run that fails
    between the two is repeated whole, so a reader keeps one of rows that come twice.
    """
    spark = source.sparkSession
    since = last_fetched(spark, state)
    new = source if since is None else source.filter(F.col(date) > F.lit(since))
    seen = new.agg(F.count(F.lit(1)).alias("n"), F.max(date).alias("upto")).first()
    if seen["n"]:
        new.filter(F.col(date) <= F.lit(seen["upto"])).write.mode("append").parquet(target)
        spark.createDataFrame([(seen["upto"],)], "upto string").write.mode("append").json(state)
    return seen["n"]


def follow(spark: SparkSession, folder: str, schema: str, target: str, checkpoint: str, keys: list[str]) -> None:
    """Takes every file of a folder once, however often it is called: new files are appended to ``target``, one row for each
    key of a batch.  The checkpoint remembers which files are done."""

    def store(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(keys).write.mode("overwrite").parquet(f"{target}/batch={number}")

    files = spark.readStream.schema(schema).json(folder)
    files.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(store).start().awaitTermination()
