"""Readers for the parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shoalwork.plans.ship import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` of the folder; columns are pruned and filters pushed by the caller's plan."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
