"""Aggregates whose ties are settled by order: mode, medians and percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mode_first_seen(rows: DataFrame, keys: list[str], value: str, order: list[str], name: str = "mode") -> DataFrame:
    """The most frequent value of each group; among equals the one seen first in ``order``. Nulls don't count.

    Counts combine before both shuffles, so a group of any size is fine.
    """
    place = F.struct(*order)
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"), F.min(place).alias("__first"))
    best = F.min(F.struct((-F.col("__n")).alias("n"), F.col("__first").alias("first"), F.col(value).alias("v")))
    return counted.groupBy(*keys).agg(best.alias("__best")).select(*keys, F.col("__best.v").alias(name))


def upper_median(value: str) -> Column:
    """Of n sorted values the one with n / 2, rounded down, before it: the middle from above. Counts combine before the shuffle."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value} DESC)")


def middle_median(value: Column) -> Column:
    """The mean of the two middle values; 0 of nothing."""
    return F.coalesce(F.percentile(value, 0.5), F.lit(0.0))


def nearest_rank(value: str, percent: int) -> Column:
    """The value at rank ``percent`` of n hundredths, rounded up; the first at least."""
    return F.expr(f"percentile_disc({percent / 100}) WITHIN GROUP (ORDER BY {value})")
