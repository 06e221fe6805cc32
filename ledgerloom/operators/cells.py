"""Sheets as cell tables: path, sheet_pos, sheet, row, col, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def right_of_label(cells: DataFrame, keys: list[str], is_label: Column, reach: int = 5) -> DataFrame:
    """keys, row, col, label, value: the nearest filled cell at most `reach` columns right of a label cell."""
    w = Window.partitionBy(*keys, "row").orderBy("col")
    rows = cells.withColumns({"_col": F.lead("col").over(w), "value": F.lead("text").over(w)})
    return rows.where(is_label & (F.col("_col") - F.col("col") <= reach)).select(*keys, "row", "col", F.col("text").alias("label"), "value")


def below_label(cells: DataFrame, keys: list[str], is_label: Column, reach: int = 5) -> DataFrame:
    """The same downwards."""
    w = Window.partitionBy(*keys, "col").orderBy("row")
    rows = cells.withColumns({"_row": F.lead("row").over(w), "value": F.lead("text").over(w)})
    return rows.where(is_label & (F.col("_row") - F.col("row") <= reach)).select(*keys, "row", "col", F.col("text").alias("label"), "value")


def cover_sheet(cells: DataFrame, path: str, name_part: str) -> DataFrame:
    """path, sheet_pos: the first sheet whose name holds name_part, else the first."""
    rank = F.struct((~F.contains("sheet", F.lit(name_part))).alias("other"), F.col("sheet_pos"))
    return cells.groupBy(path).agg(F.min_by("sheet_pos", rank).alias("sheet_pos"))


def sheet_text(cells: DataFrame, keys: list[str], max_rows: int, max_chars: int) -> DataFrame:
    """Distinct cell texts in reading order, of the first rows, cut to so many characters."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("row", "col", "text"))), lambda c: c["text"])
    return cells.where(F.col("row") <= max_rows).groupBy(*keys).agg(F.left(F.array_join(F.array_distinct(ordered), "\n"), F.lit(max_chars)).alias("text"))


def header_records(cells: DataFrame, keys: list[str], is_header: Column, needed: int = 2) -> DataFrame:
    """keys, row, record (map header -> text): rows below the first row with at least `needed` header cells."""
    head = cells.groupBy(*keys, "row").agg(F.count_if(is_header).alias("n")).where(F.col("n") >= needed).groupBy(*keys).agg(F.min("row").alias("_head"))
    rows = cells.join(head, keys)
    names = rows.where("row = _head").select(*keys, "col", F.col("text").alias("_name"))
    body = rows.where("row > _head").join(names, [*keys, "col"], "left").withColumn("_name", F.coalesce("_name", F.concat(F.lit("Col_"), F.col("col").cast("string"))))
    once = body.groupBy(*keys, "row", "_name").agg(F.max_by("text", "col").alias("text"))  # the last of equal headers
    return once.groupBy(*keys, "row").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_name", "text")))).alias("record"))


def sliding_four(cells: DataFrame, keys: list[str], code: str, version: str, date: str) -> DataFrame:
    """First run of four neighbour cells that reads code, version, date, author; any but the first may be empty, not all three."""
    w = Window.partitionBy(*keys, "row").orderBy("col")
    rows = cells.withColumns({"_2": F.lead("text", 1).over(w), "_3": F.lead("text", 2).over(w), "_4": F.lead("text", 3).over(w)})
    ok = lambda c, p: (F.coalesce(c, F.lit("")) == "") | c.rlike(p)
    filled = F.concat(*[F.coalesce(c, F.lit("")) for c in ("_2", "_3", "_4")]) != ""
    hit = rows.where(F.col("text").rlike(code) & ok(F.col("_2"), version) & ok(F.col("_3"), date) & F.col("_4").isNotNull() & ~F.col("_4").rlike(date) & filled)
    return hit.groupBy(*keys).agg(F.min_by(F.struct("row", "col", F.col("text").alias("code"), F.col("_2").alias("version"), F.col("_3").alias("date"), F.col("_4").alias("author")), F.struct("row", "col")).alias("h")).select(*keys, "h.*")
