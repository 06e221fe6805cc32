"""Results as JSON and reports as lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nested_json(df: DataFrame, keys: list[str], items: list[str], order: list[str], most: int | None = None) -> DataFrame:
    """keys, json: {keys..., count, items: [...]}; items in order, the first `most` of them, count always of all."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.struct(*items).alias("_item")))), lambda x: x["_item"])
    grouped = df.groupBy(*keys).agg(listed.alias("items"), F.count(F.lit(1)).alias("count"))
    shown = grouped if most is None else grouped.withColumn("items", F.slice("items", 1, most))
    return shown.select(*keys, F.to_json(F.struct(*keys, "count", "items")).alias("json"))


def report_lines(counters: DataFrame, title: str, order: Column) -> DataFrame:
    """pos, line of a Markdown report from rows metric, value."""
    from pyspark.sql import Window

    body = counters.select((F.row_number().over(Window.orderBy(order)) + 1).alias("pos"), F.concat(F.lit("- "), "metric", F.lit(": "), F.col("value").cast("string")).alias("line"))  # a few metrics
    head = counters.sparkSession.createDataFrame([(0, f"# {title}"), (1, "")], "pos int, line string")
    return head.union(body)


def ordered_union(parts: list[DataFrame], key: str, pos: str) -> DataFrame:
    """Distinct by key over several tables; an earlier table's row wins, then the earlier row."""
    out = None
    for n, part in enumerate(parts):
        own = part.withColumn("_part", F.lit(n))
        out = own if out is None else out.unionByName(own)
    columns = [c for c in parts[0].columns if c != key]
    return out.groupBy(key).agg(F.min_by(F.struct(*columns), F.struct("_part", pos)).alias("_r")).select(key, "_r.*")
