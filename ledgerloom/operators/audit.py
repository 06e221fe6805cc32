"""Counters over status columns, in one pass, wide or long."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counters(df: DataFrame, conditions: dict[str, Column], keys: tuple[str, ...] = ()) -> DataFrame:
    """A column of counts per condition; nulls count as false."""
    aggregates = [F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in conditions.items()]
    return df.groupBy(*keys).agg(*aggregates) if keys else df.agg(*aggregates)


def long_counters(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """metric, value."""
    wide = counters(df, conditions)
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in conditions])).alias("m")).select("m.metric", "m.value")
