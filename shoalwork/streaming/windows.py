"""Counts over unbounded tables of mails or events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table as a stream of its files, with the schema that it has now."""
    return spark.readStream.schema(spark.read.parquet(f"{folder}/{name}.parquet").schema).parquet(f"{folder}/{name}.parquet*")


def windowed(events: DataFrame, ts: str, by: list[str], length: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """(start, *by, n) in tumbling or sliding windows; rows later than `late` are dropped."""
    window = F.window(ts, length, slide) if slide else F.window(ts, length)
    return events.withWatermark(ts, late).groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sessions(events: DataFrame, ts: str, by: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(by, start, end, n) of runs without a pause of `gap`."""
    return events.withWatermark(ts, late).groupBy(by, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once_each(events: DataFrame, ts: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first row of each key within the time that rows may be late."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
