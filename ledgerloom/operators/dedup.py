"""First, best and top rows per key, in a stated order. An order without ties makes results repeatable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key. Spark limits the groups before the shuffle (window group limit)."""
    return top_k(df, keys, order, 1).drop("rank")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def collapse_runs(df: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    """Drops rows whose value equals the row's before."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_before", before).where(~F.col(value).eqNullSafe(F.col("_before")) | F.col("_before").isNull()).drop("_before")


def merge_upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and rows of old whose key new doesn't have."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def next_versions(df: DataFrame, key: Column, version: Column) -> DataFrame:
    """key, next_version: one more than the largest version of the key."""
    return df.groupBy(key.alias("key")).agg((F.max(version) + 1).alias("next_version"))


def unique_names(df: DataFrame, name: str, order: list[Column]) -> DataFrame:
    """unique_name: the name for its first row, then name_2, name_3 and so on. One name's rows are numbered by key and block."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return df.withColumn("_n", n).withColumn("unique_name", F.when(F.col("_n") == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_"), F.col("_n").cast("string")))).drop("_n")
