"""Catalog entries and folder paths out of the text of a standard: line tables (keys, pos, line) and single lines.

Null lines give nothing; of equal candidates the first counts; repeated rows stay. Windows run over one document's lines
in their order, so a document is one group: these are tables of lines of standards, not of whole corpora.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.titles import NUMBER_ID, OUTPUT_ID, composed_key, composed_text, id_and_name

# Fixed values.
TABLE_HEADER = r"구분|프로세스|산출물명|산출물ID|폴더명|활동명|작업명"
HEADER_OR_FOOTER = r"V\d+\.\d+|\d{4}\.\d{2}\.\d{2}"
GENERIC_STAGES = ("프로젝트", "착수", "시작", "실행", "종료", "관리", "분석", "설계", "구현", "시험", "인도")
ID_IN_LINE = rf"\b(?:{OUTPUT_ID}|{NUMBER_ID})(?:-[^\s]+)?(?![A-Za-z0-9])"
NUMBERED = r"\A\d{2}\.(.+)\z"
RUN = r"\S(?:.*?\S)?(?=\s{2,}\S|\s*$)"
LEVEL_COLUMNS = (6, 25, 44)


def is_table_header(line: Column) -> Column:
    return line.rlike(TABLE_HEADER)


def is_page_or_table_header(line: Column) -> Column:
    """A page header or footer (by version and date), or a table header without an output id."""
    return (line.rlike(HEADER_OR_FOOTER) & ~is_table_header(line)) | (is_table_header(line) & ~F.contains(line, F.lit("MFDS-")))


def is_generic_stage(value: Column) -> Column:
    return composed_key(value).isin(*GENERIC_STAGES)


def is_wrapped_part(value: Column) -> Column:
    """A parenthesis with Hangul on a line of its own: the rest of the name above."""
    return value.rlike(r"\A\([^)]*[가-힣][^)]*\)\z")


def is_sequential_id(value: Column) -> Column:
    named = value.rlike(r"\d|(?i)ID") | F.startswith(F.upper(value), F.lit("MFDS-"))
    return (value != "") & ~is_table_header(value) & (F.length(value) <= 100) & named


def is_sequential_name(value: Column) -> Column:
    return (value != "") & ~is_table_header(value) & ~is_wrapped_part(value) & ~is_generic_stage(value) & ~is_sequential_id(value) & (value.rlike("[가-힣]") | (composed_key(value) == "wbs"))


def is_loose_id(value: Column) -> Column:
    return (value != "") & ~is_table_header(value) & ~value.rlike(r"\A\d{1,3}\z") & (F.length(value) <= 80) & ~value.rlike("[가-힣]") & value.rlike(r"\d")


def is_loose_name(value: Column) -> Column:
    return (value != "") & ~is_table_header(value) & ~is_generic_stage(value) & ~is_loose_id(value) & value.rlike("[가-힣]")


def sequential_output(raw: Column, order: WindowSpec, name_from_id: bool = False) -> Column:
    """Struct output_id, output_name of a name line with its id on the next line, or behind a wrapped part of the name; null for other lines."""
    line, first, second = composed_text(raw), composed_text(F.lead(raw).over(order)), composed_text(F.lead(raw, 2).over(order))
    wrapped = ~is_sequential_id(first) & is_wrapped_part(first) & is_sequential_id(second)
    parts = F.struct(F.when(wrapped, F.concat(line, first)).otherwise(line).alias("name"), F.when(wrapped, second).otherwise(first).alias("id"))

    def of(p: Column) -> Column:
        output_id, own = id_and_name(p["id"])
        name = F.when(own != "", own).otherwise(p["name"]) if name_from_id else p["name"]
        return F.when(is_sequential_name(p["name"]) & is_sequential_id(p["id"]), F.struct(output_id.alias("output_id"), name.alias("output_name")))

    return let(parts, of)


def sequential_outputs(lines: DataFrame, keys: list[str], name_from_id: bool = False) -> DataFrame:
    """keys, pos, output_id, output_name of sequential_output.

    name_from_id takes the name that stands in the id, if there is one.
    """
    order = Window.partitionBy(*keys).orderBy("pos")
    return lines.withColumn("_o", sequential_output(F.col("line"), order, name_from_id)).where("_o is not null").select(*keys, "pos", "_o.*")


def split_columns(line: Column) -> Column:
    """Table cells: what two or more spaces part."""
    return F.filter(F.transform(F.split(line, r"\s{2,}"), composed_text), lambda x: x != "")


def line_output(line: Column) -> Column:
    """Struct output_id, output_name, folder_name of a table line with an output id; null for other lines.

    The name is the one in the id, else the cell before the id, else the first cell behind it that is no id.
    """
    text = F.trim(F.replace(line, F.lit("⦁"), F.lit(" ")))
    found = F.regexp_extract(text, ID_IN_LINE, 0)
    at = F.instr(text, found)
    before = split_columns(F.substring(text, F.lit(1), at - 1))
    after = split_columns(F.substring(text, at + F.length(found), F.length(text)))
    output_id, in_id = id_and_name(found)
    behind = F.get(F.filter(after, lambda x: ~x.rlike(rf"\A(?:{TABLE_HEADER})\z") & ~x.rlike(ID_IN_LINE)), 0)
    cell = F.when(F.size(before) > 0, F.element_at(before, -1))
    good_cell = F.when(~cell.rlike(rf"\A(?:{TABLE_HEADER})\z"), cell)
    name = F.coalesce(F.when(in_id != "", in_id), good_cell, behind)
    folder = F.when(F.size(after) > 0, F.array_join(after, " "))
    out = F.struct(output_id.alias("output_id"), name.alias("output_name"), folder.alias("folder_name"))
    return F.when((found != "") & ~is_page_or_table_header(composed_text(text)) & name.isNotNull(), out)


def loose_line_output(line: Column) -> Column:
    """The same for any id with a digit: the next name behind the first id that has one, else the nearest before it."""
    text = F.trim(F.replace(line, F.lit("⦁"), F.lit(" ")))

    def of_cells(cells: Column) -> Column:
        names = lambda a: F.filter(a, is_loose_name)
        pick = lambda i: F.coalesce(F.get(names(F.slice(cells, i + 2, F.size(cells))), 0), F.get(F.reverse(names(F.slice(cells, F.lit(1), i))), 0))
        outputs = F.transform(cells, lambda x, i: F.when(is_loose_id(x), F.struct(x.alias("output_id"), pick(i).alias("output_name"))))
        return F.when(F.size(cells) > 1, F.get(F.filter(outputs, lambda o: o["output_name"].isNotNull()), 0))

    cells = let(split_columns(text), lambda wide: F.when(F.size(wide) > 1, wide).otherwise(F.filter(F.split(text, r"\s+"), lambda x: x != "")))
    return F.when(~is_page_or_table_header(composed_text(text)), let(cells, of_cells))


def runs(line: Column) -> Column:
    """Array of struct start, value: what single spaces hold together, and where it begins (from 0)."""
    before = lambda a, i: F.aggregate(F.slice(a, F.lit(1), i), F.lit(0), lambda n, x: n + x)
    lengths = lambda a: F.transform(a, lambda x: F.length(x))

    def placed(values: Column, gaps: Column, widths: Column) -> Column:
        return F.transform(values, lambda v, i: F.struct((before(gaps, i + 1) + before(widths, i)).alias("start"), composed_text(v).alias("value")))

    found = let(F.regexp_extract_all(line, F.lit(RUN), F.lit(0)), lambda v: let(lengths(F.split(line, RUN, -1)), lambda g: let(lengths(v), lambda w: placed(v, g, w))))
    return F.filter(found, lambda r: r["value"] != "")


def header_columns(line: Column) -> Column:
    """Struct name_start, name_end, id_start, id_end of a header line with a name and an id column; null for other lines."""

    def start(headers: Column, names: tuple[str, ...]) -> Column:
        holds = lambda k: k.rlike("|".join(names))
        return F.coalesce(F.get(F.filter(headers, lambda h: h["key"].isin(*names)), 0)["start"], F.get(F.filter(headers, lambda h: holds(h["key"])), 0)["start"])

    def columns(headers: Column) -> Column:
        end = lambda at: F.array_min(F.transform(F.filter(headers, lambda h: h["start"] > at), lambda h: h["start"]))
        of = lambda name, id_: F.when(name.isNotNull() & id_.isNotNull(), F.struct(name.alias("name_start"), end(name).alias("name_end"), id_.alias("id_start"), end(id_).alias("id_end")))
        return let(start(headers, ("산출물명", "문서명")), lambda name: let(start(headers, ("산출물id", "관리문서id", "문서id", "id")), lambda id_: of(name, id_)))

    return let(F.transform(runs(line), lambda r: F.struct(r["start"].alias("start"), composed_key(r["value"]).alias("key"))), columns)


def value_in_column(placed: Column, start: Column, end: Column) -> Column:
    """The runs that begin in a column, with two characters of play at both sides."""
    inside = lambda r: (r["start"] >= F.greatest(start - 2, F.lit(0))) & (end.isNull() | (r["start"] < F.greatest(end - 2, start)))
    return composed_text(F.array_join(F.transform(F.filter(placed, inside), lambda r: r["value"]), " "))


def column_output(line: Column, columns: Column) -> Column:
    """Struct output_id, output_name of a line by a header's columns; null for other lines, or without columns."""
    value = lambda placed, of: value_in_column(placed, columns[f"{of}_start"], columns[f"{of}_end"])
    found = let(runs(line), lambda placed: F.struct(value(placed, "id").alias("output_id"), value(placed, "name").alias("output_name")))
    return F.when(columns.isNotNull() & ~is_page_or_table_header(composed_text(line)), let(found, lambda o: F.when(is_loose_id(o["output_id"]) & is_loose_name(o["output_name"]), o)))


def column_outputs(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos, output_id, output_name of the lines of each text by the columns of its first header line."""
    w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = lines.withColumn("_c", F.first(header_columns(F.col("line")), ignorenulls=True).over(w))
    return rows.withColumn("_o", column_output(F.col("line"), F.col("_c"))).where("_o is not null").select(*keys, "pos", "_o.*")


def section_outputs(lines: DataFrame, keys: list[str], loose_id: bool = True, name_from_id: bool = False) -> DataFrame:
    """keys, pos, output_id, output_name, folder_name, parser of each text by the first parser that finds outputs in it.

    With loose ids that is names with their ids on the next line ('sequential'); without any, each line is read by the columns of the text's
    header ('columns'), else by loose ids ('loose'), else by output ids ('line'); without loose ids only the last. All parsers
    are columns of one pass: the lines of a text are sorted once.
    """
    line = F.col("line")
    order = Window.partitionBy(*keys).orderBy("pos")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def named(found: Column, parser: str, folder: Column | None = None) -> Column:
        folder = F.lit(None).cast("string") if folder is None else folder
        return F.when(found.isNotNull(), F.struct(found["output_id"].alias("output_id"), found["output_name"].alias("output_name"), folder.alias("folder_name"), F.lit(parser).alias("parser")))

    by_line = let(line_output(line), lambda o: named(o, "line", o["folder_name"]))
    if not loose_id:
        return lines.withColumn("_o", by_line).where("_o is not null").select(*keys, "pos", "_o.*")
    rows = lines.withColumns({"_s": sequential_output(line, order, name_from_id), "_c": F.first(header_columns(line), ignorenulls=True).over(whole)})
    rows = rows.withColumn("_any", F.max(F.col("_s").isNotNull()).over(whole))
    others = F.coalesce(let(column_output(line, F.col("_c")), lambda o: named(o, "columns")), let(loose_line_output(line), lambda o: named(o, "loose")), by_line)
    return rows.withColumn("_o", F.when(F.col("_any"), named(F.col("_s"), "sequential")).otherwise(others)).where("_o is not null").select(*keys, "pos", "_o.*")


def layout_templates(lines: DataFrame, keys: list[str], noise: str = HEADER_OR_FOOTER) -> DataFrame:
    """keys, pos, output_name, template_path (array): leaves of an indented folder table with the folders open at their line.

    A run's column says its level; numbered runs open a folder there and keep it till the next of that level; deeper
    levels stay as they were. Lines up to the table's head, and lines with noise (page headers), don't count.
    """
    w = Window.partitionBy(*keys).orderBy("pos")
    head = F.contains("line", F.lit("구분")) & F.contains("line", F.lit("폴더명/문서명"))
    rows = lines.withColumn("_in", F.max(head.cast("int")).over(w)).where((F.col("_in") == 1) & ~head & ~F.col("line").rlike(noise) & (F.trim("line") != ""))
    rows = rows.withColumn("_runs", runs(F.rtrim("line")))
    bounds = (0, *LEVEL_COLUMNS)

    def level(k: int) -> Column:
        own = F.filter("_runs", lambda r: (r["start"] >= bounds[k]) & (r["start"] < bounds[k + 1]) & r["value"].rlike(NUMBERED))
        return F.last(F.when(F.size(own) > 0, F.element_at(own, -1)["value"]), ignorenulls=True).over(w)

    leaves = F.transform(F.filter("_runs", lambda r: r["start"] >= LEVEL_COLUMNS[-1]), lambda r: composed_text(F.regexp_replace(r["value"], NUMBERED, "$1")))
    rows = rows.withColumns({"template_path": F.filter(F.array(*[level(k) for k in range(3)]), lambda x: x.isNotNull()), "_leaves": F.filter(leaves, lambda x: x != "")})
    return rows.where(F.size("template_path") > 0).select(*keys, "pos", F.explode("_leaves").alias("output_name"), "template_path")


def outputs_with_templates(outputs: DataFrame, templates: DataFrame) -> DataFrame:
    """output_key, output_name, pos of outputs whose name or alias a template has, in the templates' order, each name once.

    outputs: output_key (order), output_name, aliases; templates: pos, output_name. An equi-join on keys.
    """
    names = F.concat(F.array("output_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    keyed = outputs.select("output_key", "output_name", F.explode(F.transform(names, composed_key)).alias("_key")).where("_key <> ''")
    index = keyed.groupBy("_key").agg(F.min_by(F.struct("output_key", "output_name"), "output_key").alias("o"))
    first = templates.select(composed_key(F.col("output_name")).alias("_key"), "pos").join(index, "_key").groupBy(composed_key(F.col("o.output_name")).alias("_name")).agg(F.min_by(F.struct("o", "pos"), "pos").alias("f"))
    return first.select("f.o.output_key", "f.o.output_name", "f.pos")
