"""Similarity of two strings that SQL lacks: the gestalt ratio, in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

TITLE_THRESHOLD = 0.58  # fixed value


def gestalt_ratio(a: Column, b: Column) -> Column:
    """difflib's ratio; the order of arguments matters. Null if one side is null."""

    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([None if p is None or q is None else SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y, strict=True)], dtype="float64")

    return F.pandas_udf(ratio, DoubleType())(a, b)


def best_gestalt_ratio(many: Column, b: Column) -> Column:
    """The best of the ratios of each of many to b; null if one side is null or many is empty."""

    def best(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([None if p is None or q is None or not len(p) else max(SequenceMatcher(None, a, q).ratio() for a in p) for p, q in zip(x, y, strict=True)], dtype="float64")

    return F.pandas_udf(best, DoubleType()).asNondeterministic()(many, b)  # so that no filter on it moves into a join


def title_similarity(candidate: Column, expected: Column) -> Column:
    """1 for equal keys, 0.9 if one of two longer keys holds the other, else the gestalt ratio."""
    long_ = (F.length(candidate) >= 6) & (F.length(expected) >= 6)
    cheap = F.when(candidate == expected, 1.0).when(long_ & (F.contains(candidate, expected) | F.contains(expected, candidate)), 0.9)
    return F.when(cheap.isNotNull(), cheap).otherwise(gestalt_ratio(candidate, expected))
