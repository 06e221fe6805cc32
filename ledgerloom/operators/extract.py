"""Lines, labels, sections and numbered items out of text columns. Line tables are (keys, pos, line)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import compact_space


def text_lines(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, pos, line: lines that have something, compacted; pos is the place in the text."""
    lines = df.select(*keys, F.posexplode(F.split(text, r"\r?\n")).alias("pos", "_line"))
    return lines.withColumn("line", compact_space(F.col("_line"))).where("line <> ''").drop("_line")


def labelled_values(lines: DataFrame, keys: list[str], labels: list[str]) -> DataFrame:
    """keys, label, value: what stands behind the first `label:` of each text, else the line below a bare label."""
    w = Window.partitionBy(*keys).orderBy("pos")
    any_label = "|".join(rf"\Q{x}\E" for x in labels)
    found = lines.withColumn("_next", F.lead("line").over(w)).withColumn("label", F.regexp_extract("line", rf"(?i)^({any_label})\s*(?::|$)", 1)).where("label <> ''")
    own = F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1))
    value = F.when(own != "", own).otherwise(F.col("_next"))
    return found.groupBy(*keys, F.lower("label").alias("label")).agg(F.min_by(value, F.col("pos")).alias("value"))


def section(text: Column, start: str, ends: list[str]) -> Column:
    """From the first start pattern to the nearest end pattern behind it, else to the end; empty without a start."""
    begin = F.regexp_instr(text, F.lit(start))
    rest = F.when(begin > 0, F.substring(text, begin, F.length(text))).otherwise(F.lit(""))
    stops = [F.when(F.regexp_instr(F.substring(rest, F.lit(2), F.length(rest)), F.lit(e)) > 0, F.regexp_instr(F.substring(rest, F.lit(2), F.length(rest)), F.lit(e))) for e in ends]
    first = F.least(*stops, F.length(rest)) if stops else F.length(rest)
    return F.when(F.length(rest) > 0, F.left(rest, first)).otherwise(F.lit(""))


def numbered_items(text: Column) -> Column:
    """Items of circled numbers if there are any, else of numbered lines, without their markers."""
    circled = F.transform(F.regexp_extract_all(text, F.lit(r"[①-⑳]\s*([^①-⑳\n]+)"), F.lit(1)), lambda x: F.trim(x))
    lines = F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^\s*\d{1,3}[.)]\s*(.+)$"), F.lit(1)), lambda x: F.trim(x))
    return F.when(F.size(circled) > 0, circled).otherwise(lines)


def field_value(text: Column, field: str, others: list[str]) -> Column:
    """The value behind `field`, up to the next of the other labels or the end of the line."""
    stop = "|".join([r"\n", *[rf"\Q{o}\E\s*:" for o in others], "$"])
    return F.trim(F.regexp_extract(text, rf"\Q{field}\E\s*:\s*(.*?)(?:{stop})", 1))


def adjacent_pairs(lines: DataFrame, keys: list[str], is_name: Column, is_id: str) -> DataFrame:
    """Name lines with the id on the next line, or on the one after it when the name is wrapped over two lines."""
    w = Window.partitionBy(*keys).orderBy("pos")
    rows = lines.withColumns({"_1": F.lead("line", 1).over(w), "_2": F.lead("line", 2).over(w), "_before": F.lag("line").over(w)})
    direct, wrapped = F.col("_1").rlike(is_id), ~F.col("_1").rlike(is_id) & F.col("_2").rlike(is_id)
    name = F.when(direct, F.col("line")).when(wrapped, F.concat_ws(" ", "line", "_1"))
    tail = F.coalesce(F.lag(wrapped).over(w), F.lit(False))  # the second half of a wrapped name is no name
    rows = rows.withColumns({"name": name, "id": F.when(direct, F.col("_1")).otherwise(F.col("_2")), "_tail": tail & direct})
    return rows.where(is_name & ~F.col("line").rlike(is_id) & F.col("name").isNotNull() & ~F.col("_tail")).select(*keys, "pos", "name", "id")


def nearest_before(lines: DataFrame, keys: list[str], marker: Column, wanted: Column, reach: int = 4) -> DataFrame:
    """For each marker line the nearest wanted line of the `reach` lines before it."""
    w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(-reach, -1)
    return lines.withColumn("found", F.last(F.when(wanted, F.col("line")), ignorenulls=True).over(w)).where(marker & F.col("found").isNotNull()).select(*keys, "pos", "line", "found")


def without_spans(lines: DataFrame, keys: list[str], start: Column, end: Column, longest: int = 10) -> DataFrame:
    """Lines without those from a start line to the nearest end line within `longest` lines (page headers)."""
    ahead = Window.partitionBy(*keys).orderBy("pos").rowsBetween(0, longest)
    behind = Window.partitionBy(*keys).orderBy("pos").rowsBetween(-longest, 0)
    rows = lines.withColumn("_end", F.when(start, F.first(F.when(end, F.col("pos")), ignorenulls=True).over(ahead)))
    return rows.withColumn("_to", F.max("_end").over(behind)).where(F.col("_to").isNull() | (F.col("_to") < F.col("pos"))).drop("_end", "_to")
