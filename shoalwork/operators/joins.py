"""Joins whose strategy follows from checked sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1_000  # a key with more than 1 / HOT_SHARE of the rows is hot; there are fewer than HOT_SHARE of them


def small_side_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", max_rows: int = 50_000, hot_rows: int = 100_000) -> DataFrame:
    """Join with a side that is expected to be small. Only inner and left joins are offered; `on` is a list of names.

    Up to `max_rows` rows of `right` (at most one more is looked at) it is broadcast. Beyond that the hot keys of `left`
    are found by a count: their rows, which may be a third of all, meet a broadcast of the few rows of `right` that have
    those keys (up to `hot_rows`, checked), and the others are joined by a shuffle that no key dominates.
    """
    if how not in ("inner", "left"):
        raise ValueError("how is inner or left")
    if right.limit(max_rows + 1).count() <= max_rows:
        return left.join(F.broadcast(right), on, how)
    counts = left.groupBy(*on).count()
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    hot = counts.where(F.col("count") > max(1, total // HOT_SHARE)).select(*on)
    few = right.join(F.broadcast(hot), on, "left_semi")
    if few.limit(hot_rows + 1).count() > hot_rows:
        return left.join(right, on, how)  # adaptive execution splits what is skewed
    crowded = left.join(F.broadcast(hot), on, "left_semi").join(F.broadcast(few), on, how)
    return crowded.unionByName(left.join(F.broadcast(hot), on, "left_anti").join(right, on, how))
