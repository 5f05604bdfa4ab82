"""Windows over event time; every function takes a batch or a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATS = {"n": lambda v: F.count(F.lit(1)), "total": F.sum, "least": F.min, "greatest": F.max}


def _watermarked(events: DataFrame, time: str, late: str) -> DataFrame:
    """A stream with its watermark, for which the time must have a zone: the session's is taken."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events


def tumbling(events: DataFrame, width: str, keys: list[str], time: str = "ts", value: str = "value", late: str = "1 hour") -> DataFrame:
    stats = [f(F.col(value)).alias(n) for n, f in STATS.items()]
    out = _watermarked(events, time, late).groupBy(F.window(time, width).alias("w"), *keys).agg(*stats)
    return out.select(F.col("w.start").alias("window_start"), *keys, *STATS)


def sliding(events: DataFrame, width: str, slide: str, keys: list[str], time: str = "ts", value: str = "value", late: str = "1 hour") -> DataFrame:
    stats = [f(F.col(value)).alias(n) for n, f in STATS.items()]
    out = _watermarked(events, time, late).groupBy(F.window(time, width, slide).alias("w"), *keys).agg(*stats)
    return out.select(F.col("w.start").alias("window_start"), *keys, *STATS)


def sessions(events: DataFrame, gap: str, keys: list[str], time: str = "ts", value: str = "value", late: str = "1 hour") -> DataFrame:
    out = _watermarked(events, time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("session_start"), *keys, "n", "total")


def deduplicated(events: DataFrame, keys: list[str], time: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first event of each key; in a stream, within the watermark."""
    if events.isStreaming:
        return _watermarked(events, time, late).dropDuplicatesWithinWatermark(keys)
    rest = [c for c in events.columns if c not in keys and c != time]
    first = events.groupBy(*keys).agg(F.min(F.struct(time, *rest)).alias("f"))
    return first.select(*keys, *[F.col(f"f.{c}").alias(c) for c in (time, *rest)])


def value_histogram(events: DataFrame, width: str, bin_width: float, keys: list[str], time: str = "ts", value: str = "value", late: str = "1 hour") -> DataFrame:
    """Counts of value bins in each window: histograms that merge by addition."""
    binned = _watermarked(events, time, late).withColumn("bin", F.floor(F.col(value) / bin_width).cast("long"))
    out = binned.groupBy(F.window(time, width).alias("w"), *keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "bin", "n")
