"""Revision dates, kept as text because a date may lack its month or day (YYYY-00-00)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = r"^\s*(\d{4})\s*(?:[-./년\s]\s*(\d{1,2}))?\s*(?:[-./월\s]\s*(\d{1,2}))?\s*[일.]?\s*$"


def revision_date(value: Column) -> Column:
    """YYYY-MM-DD with 00 for what is missing; text of another form comes back with its separators as hyphens."""
    part = lambda i: F.lpad(F.coalesce(F.nullif(F.regexp_extract(value, PARTS, i), F.lit("")), F.lit("0")), 2, "0")
    full = F.concat_ws("-", F.regexp_extract(value, PARTS, 1), part(2), part(3))
    return F.when(value.rlike(PARTS), full).otherwise(F.regexp_replace(F.trim(value), r"[./\s]+", "-"))


def size_class(n: Column, small: int, medium: int) -> Column:
    return F.when(n <= small, "small").when(n <= medium, "medium").otherwise("large")
