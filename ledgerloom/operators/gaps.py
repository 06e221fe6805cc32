"""Completeness of roles per key: which keys have all roles, and which lack what."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def roles_by_key(df: DataFrame, keys: list[str], role: str, roles: list[str]) -> DataFrame:
    """keys, present: sorted array of the roles found. Partial aggregation keeps one small set per key and task."""
    return df.where(F.col(role).isin(roles)).groupBy(*keys).agg(F.array_sort(F.collect_set(role)).alias("present"))


def complete_keys(df: DataFrame, keys: list[str], role: str, roles: list[str]) -> DataFrame:
    return roles_by_key(df, keys, role, roles).where(F.size("present") == len(roles)).select(*keys)


def missing_roles(df: DataFrame, keys: list[str], role: str, roles: list[str]) -> DataFrame:
    """keys, missing: labels of absent roles in the order of `roles`; incomplete keys only."""
    every = F.array(*[F.lit(r) for r in roles])
    return roles_by_key(df, keys, role, roles).select(*keys, F.array_except(every, "present").alias("missing")).where(F.size("missing") > 0)


def with_fallback(target: DataFrame, source: DataFrame, keys: list[str], value: str) -> DataFrame:
    """target LEFT JOIN source; source's value wins, else target's."""
    other = source.select(*keys, F.col(value).alias("_other"))
    return target.join(other, keys, "left").withColumn(value, F.coalesce("_other", value)).drop("_other")
