"""Paths against path templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contiguous_runs(parts: Column) -> Column:
    """All contiguous runs of an array of parts, each joined by slashes."""
    n = F.size(parts)
    starts = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    runs = F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.array_join(F.slice(parts, i, k), "/")))
    return F.array_distinct(F.flatten(runs))


def longest_templates(files: DataFrame, keys: list[str], parts: str, templates: DataFrame, template: str, order: str, all_longest: bool = False) -> DataFrame:
    """files joined to the longest template whose parts stand in a row in the path; the first of equals, or all of them.

    An equi-join on the runs of a path (a handful), not a comparison of every path with every template. Of templates with
    equal parts only the first can be wanted, unless all are, so a run meets one row however many templates share it.
    """
    keyed = templates.withColumn("_run", F.array_join(template, "/")).withColumn("_n", F.size(template)).where("_n > 0")
    if not all_longest:
        first = F.min_by(F.struct(*templates.columns), F.struct(order))
        keyed = keyed.groupBy("_run", "_n").agg(first.alias("_t")).select("_t.*", "_run", "_n")
    pairs = files.withColumn("_run", F.explode(contiguous_runs(F.col(parts)))).join(keyed, "_run")
    w = Window.partitionBy(*keys)
    if all_longest:
        return pairs.withColumn("_r", F.rank().over(w.orderBy(F.desc("_n")))).where("_r = 1").drop("_r", "_run", "_n")
    return pairs.withColumn("_r", F.row_number().over(w.orderBy(F.desc("_n"), order))).where("_r = 1").drop("_r", "_run", "_n")


def records_for_names(names: DataFrame, keys: list[str], records: DataFrame, record: str, pairs: DataFrame) -> DataFrame:
    """Of the record names that a file name holds (`pairs`: keys and record), those of the greatest length, with their rows."""
    w = Window.partitionBy(*keys).orderBy(F.desc(F.length(record)))
    best = pairs.withColumn("_r", F.rank().over(w)).where("_r = 1").drop("_r")
    return names.join(best, keys).join(records, record)
