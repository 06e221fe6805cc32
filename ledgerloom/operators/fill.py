"""Forward fills within a partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def forward_fill(df: DataFrame, keys: list[str], order: list[Column], columns: dict[str, Column]) -> DataFrame:
    """Each column gets the last value that wasn't null up to the row. Levels are filled apart and never reset."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({name: F.last(value, ignorenulls=True).over(w) for name, value in columns.items()})


def numbered_with_first(df: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    """sequence within the key, and the first row's value (null stays null)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({"sequence": F.row_number().over(w), f"first_{value}": F.first(value).over(w)})
