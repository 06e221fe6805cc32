"""Authors, dates and revision tables that documents carry in cells, lines and headers.

Cells are rows path, sheet_pos, sheet, row, col, text, with rows and columns from 1. Null texts count as empty cells, and
empty cells as missing ones; of repeated cells at one place the least text counts; documents without a value have null;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.keys import label_key
from .checks import revision_columns, text_of

# Fixed values.
DATE_LABEL_KEYS = ("개정일자",)
AUTHOR_LABEL_KEYS = ("작성자",)
LABEL_KEYS = ("문서번호", "문서버전", "개정일자", "변경일", "변경일자", "작성자", "버전", "개정사유", "개정내역", "승인", "승인자")
NOT_AUTHORS = ("작성자", "승인자")
VERSION = r"\A[vV]?\d+(?:\.\d+)*\z"
DATE = r"\A\d{4}(?:[-./]\d{1,2}[-./]\d{1,2}|\s+\d{1,2}\s+\d{1,2})\z"
HISTORY_SHEET = "개정이력"
COVER_SHEET = "표지"
STANDARD_AUTHOR = r"작성\s*자\s+([^\s<>|]+)"
TEXT_AUTHOR = r"<\s*(?:작성자|작\s*성\s*자)\s*>\s*<\s*([^<>]+)\s*>"
TEXT_DATE = r"<\s*개정일자\s*>\s*<\s*([^<>]+)\s*>"
LINE_END = r"\R|[\x1C-\x1E]"


def filled(cells: DataFrame, path: str) -> DataFrame:
    """path, sheet_pos, sheet, row, col, text of cells that hold something, one for each place."""
    rows = cells.select(path, "sheet_pos", "sheet", "row", "col", text_of(F.col("text")).alias("text")).where("text <> ''")
    return rows.groupBy(path, "sheet_pos", "sheet", "row", "col").agg(F.min("text").alias("text"))


def is_label(text: Column) -> Column:
    return label_key(text).isin(*LABEL_KEYS)


def place() -> Column:
    return F.struct("sheet_pos", "row", "col")


def header_values(cells: DataFrame, path: str) -> DataFrame:
    """path, revision_date, author: what stands right beside the first label of a kind and is no label itself."""
    across = Window.partitionBy(path, "sheet_pos", "row").orderBy("col")
    beside = filled(cells, path).withColumns({"_at": F.lead("col").over(across), "_value": F.lead("text").over(across)})
    value = F.when((F.col("_at") == F.col("col") + 1) & ~is_label(F.col("_value")), F.col("_value"))
    first = lambda keys: F.min_by(value, F.when(label_key("text").isin(*keys) & value.isNotNull(), place()))
    return beside.groupBy(path).agg(first(DATE_LABEL_KEYS).alias("revision_date"), first(AUTHOR_LABEL_KEYS).alias("author"))


def revision_history(cells: DataFrame, path: str) -> DataFrame:
    """path, revision_history_date, revision_author: first version row below the header of the first history sheet.

    The header is the first row that names a version, a date and an author; a version row begins with a version in column
    1. A cell that is missing there gives null. Documents without such rows are missing.
    """
    history = F.startswith(label_key(F.col("sheet")), F.lit(HISTORY_SHEET))
    own = cells.where(history)
    sheets = own.groupBy(path).agg(F.min("sheet_pos").alias("sheet_pos"))
    own = filled(own.join(sheets, [path, "sheet_pos"]), path)
    rows = own.groupBy(path, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", label_key("text").alias("label")))).alias("_labels"), F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("_texts"))
    label = lambda i: F.coalesce(F.try_element_at("_labels", i.cast("int")), F.lit(""))
    found = revision_columns(F.transform(F.sequence(F.lit(1), F.array_max(F.map_keys("_labels")).cast("int")), label))
    rows = rows.withColumns({"_found": F.when(F.size("_labels") >= 3, found), "_version": F.coalesce(F.try_element_at("_texts", F.lit(1)).rlike(VERSION), F.lit(False))})
    header = rows.where("_found is not null").groupBy(path).agg(F.min("row").alias("_head"), F.min_by("_found", "row").alias("_columns"))
    below = rows.where("_version").join(header, path).where("row > _head")
    first = below.groupBy(path).agg(F.min_by(F.struct("_texts", "_columns"), "row").alias("_r"))
    at = lambda kind: F.try_element_at(F.col("_r._texts"), (F.col(f"_r._columns.{kind}") + 1).cast("int"))
    return first.select(path, at("date").alias("revision_history_date"), at("author").alias("revision_author"))


def inspected_sheets(cells: DataFrame, path: str) -> DataFrame:
    """path, revision_date, author, revision_history_date, revision_author of every document with a filled cell."""
    return header_values(cells, path).join(revision_history(cells, path), path, "left")


def sheet_authors(cells: DataFrame, path: str, reach: int = 6) -> DataFrame:
    """path, author: the next filled cell right of an author label on a cover sheet, else the next one below a label anywhere.

    Below means at most `reach` rows down in the same column. Documents without an author are missing.
    """
    across = Window.partitionBy(path, "sheet_pos", "row").orderBy("col")
    down = Window.partitionBy(path, "sheet_pos", "col").orderBy("row")
    near = filled(cells, path).withColumns({"_right": F.lead("text").over(across), "_below": F.lead("text").over(down), "_row": F.lead("row").over(down)})
    labels = near.where(label_key("text").isin(*AUTHOR_LABEL_KEYS))
    right = F.when(F.contains("sheet", F.lit(COVER_SHEET)) & F.col("_right").isNotNull(), F.struct(F.lit(0).alias("way"), "sheet_pos", "row", "col", F.col("_right").alias("author")))
    below = F.when(F.col("_row") <= F.col("row") + reach, F.struct(F.lit(1).alias("way"), "sheet_pos", "row", "col", F.col("_below").alias("author")))
    return labels.groupBy(path).agg(F.least(F.min(right), F.min(below)).alias("_best")).where("_best is not null").select(path, "_best.author")


def author_below_label(text: Column, lines: int | None = 80, reach: int = 4) -> Column:
    """The first line of up to `reach` below an author label that is no such label; labels count in the first `lines` lines.

    Empty lines don't count. Null without one; lines None reads all.
    """
    filled_lines = F.filter(F.transform(F.split(text, LINE_END), lambda x: F.trim(x)), lambda x: x != "")

    def author(all_lines: Column) -> Column:
        n = F.size(all_lines) if lines is None else F.least(F.size(all_lines), F.lit(lines))
        labels = F.filter(F.sequence(F.lit(1), n), lambda i: label_key(F.get(all_lines, i - 1)).isin(*AUTHOR_LABEL_KEYS))
        values = F.transform(labels, lambda i: F.get(F.filter(F.slice(all_lines, i + 1, reach), lambda v: ~label_key(v).isin(*NOT_AUTHORS)), F.lit(0)))
        return F.when(F.size(all_lines) > 0, F.get(F.array_compact(values), F.lit(0)))

    return F.when(text.rlike(r"작\s*성\s*자"), let(filled_lines, author))


def standard_author(text: Column, chars: int | None = 3000) -> Column:
    """The word behind an author label in the first `chars` characters (None: in all); null without one."""
    found = F.regexp_extract(text if chars is None else F.left(text, F.lit(chars)), STANDARD_AUTHOR, 1)
    return F.when(found != "", found)


def bracketed_metadata(text: Column, chars: int | None = 6000) -> Column:
    """Struct author, revision_date of values in angle brackets behind bracketed labels; null where there is none."""
    part = text if chars is None else F.left(text, F.lit(chars))
    found = lambda pattern: F.nullif(F.trim(F.regexp_extract(part, pattern, 1)), F.lit(""))
    return F.struct(found(TEXT_AUTHOR).alias("author"), found(TEXT_DATE).alias("revision_date"))


def unlabelled_header_at(values: Column) -> Column:
    """First place (from 0) of four neighbours that read code, version, date, author without labels; null without one.

    Each of the four may be empty, but not version, date and author together.
    """

    def fits(v: Column, i: Column) -> Column:
        code, version, date, author = (F.get(v, i + k) for k in range(4))
        empty = lambda x: x == ""
        no_labels = ~is_label(code) & ~is_label(version) & ~is_label(date) & ~is_label(author)
        shapes = ~code.rlike(DATE) & (empty(version) | version.rlike(VERSION)) & (empty(date) | date.rlike(DATE)) & ~author.rlike(VERSION) & ~author.rlike(DATE)
        return no_labels & shapes & ~(empty(version) & empty(date) & empty(author))

    clean = F.transform(values, text_of)
    found = let(clean, lambda v: F.get(F.filter(F.sequence(F.lit(0), F.size(v) - 4), lambda i: fits(v, i)), F.lit(0)))
    return F.when(F.size(values) >= 4, found)
