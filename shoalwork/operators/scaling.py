"""Scaling of numeric columns and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def zscore(df: DataFrame, columns: list[str], least: float = 1e-6) -> DataFrame:
    """The columns minus their mean over the sample deviation, which counts as `least` if smaller; of a single row zeros."""
    stats = df.agg(*(x for c in columns for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}"))))
    scaled = [((F.col(c) - F.col(f"_m_{c}")) / F.greatest(F.col(f"_s_{c}"), F.lit(least))).alias(c) for c in columns]
    return df.crossJoin(F.broadcast(stats)).select(*(c for c in df.columns if c not in columns), *scaled)  # one row on the right


def robust(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns minus their median over the distance of their quartiles, 1 if that is 0. Quartiles are exact and interpolated."""
    stats = df.agg(*(F.percentile(c, F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias(f"_q_{c}") for c in columns))
    width = lambda c: F.element_at(f"_q_{c}", 3) - F.element_at(f"_q_{c}", 1)
    scaled = [((F.col(c) - F.element_at(f"_q_{c}", 2)) / F.when(width(c) == 0, 1.0).otherwise(width(c))).alias(c) for c in columns]
    return df.crossJoin(F.broadcast(stats)).select(*(c for c in df.columns if c not in columns), *scaled)  # one row on the right


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n) over [low, high]; the last bin includes high, values outside are left out."""
    inside = df.where(F.col(column).between(low, high))
    return inside.groupBy(F.least(F.floor((F.col(column) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
