"""Queries of the extraction, cell and state operators, over tables read as lines, cells and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.completion import completion_limits
from ..operators.cells import below_label, cover_sheet, header_records, right_of_label, sheet_text
from ..operators.extract import adjacent_pairs, field_value, labelled_values, nearest_before, numbered_items, section, text_lines, without_spans
from ..operators.status import block_key, interrupt_queued
from .common import Book, table

book = Book()


def part_cells(spark, d):
    """Parts as a workbook: a brand is a file, ten parts a row."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select(F.col("p_brand").alias("path"), (k % 3).cast("int").alias("sheet_pos"), F.concat(F.lit("S"), (k % 3).cast("string")).alias("sheet"), F.floor(k / 10).cast("bigint").alias("row"), (k % 10).alias("col"), F.col("p_name").alias("text"))


CELLS = "c AS (SELECT p_brand AS path, p_partkey // 10 AS row, p_partkey % 10 AS col, p_name AS text, CAST(p_partkey % 3 AS INTEGER) AS sheet_pos FROM part)"


@book.query(f"WITH {CELLS}, n AS (SELECT *, lead(col) OVER w AS c2, lead(text) OVER w AS value FROM c WINDOW w AS (PARTITION BY path, row ORDER BY col)) SELECT path, row, col, text AS label, value FROM n WHERE starts_with(text, 'red') AND c2 - col <= 5")
def label_right_neighbour(spark, d):
    """The value right of a label cell."""
    return right_of_label(part_cells(spark, d), ["path"], F.startswith("text", F.lit("red")))


@book.query(f"WITH {CELLS}, n AS (SELECT *, lead(row) OVER w AS r2, lead(text) OVER w AS value FROM c WINDOW w AS (PARTITION BY path, col ORDER BY row)) SELECT path, row, col, text AS label, value FROM n WHERE starts_with(text, 'red') AND r2 - row <= 5")
def label_below_neighbour(spark, d):
    return below_label(part_cells(spark, d), ["path"], F.startswith("text", F.lit("red")))


@book.query(f"WITH {CELLS} SELECT path, arg_min(sheet_pos, (sheet_pos <> 2, sheet_pos)) AS sheet_pos FROM c GROUP BY 1")
def cover_sheet_choice(spark, d):
    """The sheet with the cover's name, else the first."""
    return cover_sheet(part_cells(spark, d), "path", "S2")


@book.query(f"""WITH {CELLS}, o AS (SELECT path, row, col, text, row_number() OVER (PARTITION BY path, text ORDER BY row, col) r FROM c WHERE row <= 100)
SELECT path, left(string_agg(text, chr(10) ORDER BY row, col), 200) AS text FROM o WHERE r = 1 GROUP BY 1""")
def cover_text(spark, d):
    """Distinct texts of the first rows in reading order."""
    return sheet_text(part_cells(spark, d), ["path"], 100, 200)


@book.query(f"""WITH {CELLS}, h AS (SELECT path, min(row) AS head FROM (SELECT path, row FROM c GROUP BY ALL HAVING count(*) FILTER (contains(text, 'ring') OR contains(text, 'bolt')) >= 1) GROUP BY 1),
n AS (SELECT c.path, col, text AS name FROM c JOIN h ON c.path = h.path AND row = head),
b AS (SELECT c.path, c.row, coalesce(name, 'Col_' || c.col) AS name, arg_max(text, c.col) AS text FROM c JOIN h ON c.path = h.path AND c.row > head LEFT JOIN n ON n.path = c.path AND n.col = c.col GROUP BY ALL)
SELECT path, row, string_agg(name || '=' || text, ';' ORDER BY name) AS record FROM b GROUP BY ALL""")
def header_row_records(spark, d):
    """Rows as maps under the header row that was found."""
    records = header_records(part_cells(spark, d), ["path"], F.contains("text", F.lit("ring")) | F.contains("text", F.lit("bolt")), 1)
    return records.select("path", "row", F.array_join(F.transform(F.array_sort(F.map_entries("record")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("record"))


@book.query("SELECT p_partkey, p_type AS value, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END AS owner FROM part")
def labelled_field_values(spark, d):
    """Values behind labels of a text, by line."""
    text = F.concat(F.lit("Name: "), "p_name", F.lit("\nType: "), "p_type", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("\nOwner:\n"), "p_brand")).otherwise(""))
    lines = text_lines(table(spark, d, "part").withColumn("_t", text), ["p_partkey"], "_t")
    found = labelled_values(lines, ["p_partkey"], ["Type", "Owner"])
    wide = found.groupBy("p_partkey").agg(F.max(F.when(F.col("label") == "type", F.col("value"))).alias("value"), F.max(F.when(F.col("label") == "owner", F.col("value"))).alias("owner"))
    return wide.withColumn("owner", F.coalesce("owner", F.lit("")))


@book.query("SELECT p_partkey, p_name || ' ' || p_type AS body, p_brand AS field FROM part")
def section_and_field(spark, d):
    """A section between two headings and a field in it."""
    text = F.concat(F.lit("intro\n# Outputs\n"), "p_name", F.lit(" "), "p_type", F.lit("\nOwner: "), "p_brand", F.lit(" Date: 2024\n# Next\nx"))
    t = table(spark, d, "part").withColumn("_s", section(text, "# Outputs", ["# Next", "# Last"]))
    return t.select("p_partkey", F.get(F.split("_s", "\n"), 1).alias("body"), field_value(F.col("_s"), "Owner", ["Date"]).alias("field"))


@book.query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name || '|' || p_type WHEN p_size % 3 = 1 THEN p_brand || '|' || p_name ELSE '' END AS steps FROM part")
def step_extraction(spark, d):
    """Numbered steps of three spellings."""
    k = F.col("p_size") % 3
    text = F.when(k == 0, F.concat(F.lit("flow ① "), "p_name", F.lit(" ② "), "p_type")).when(k == 1, F.concat(F.lit("1. "), "p_brand", F.lit("\n 2) "), "p_name", F.lit("\nend"))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", F.array_join(numbered_items(text), "|").alias("steps"))


@book.query("""WITH l AS (SELECT doc_id, pos, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)),
n AS (SELECT * FROM l WHERE line <> ''),
w AS (SELECT *, last_value(CASE WHEN length(line) > 100 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS found FROM n)
SELECT doc_id, pos, line, found FROM w WHERE length(line) <= 60 AND found IS NOT NULL""".replace("\\\\", "\\"))
def nearest_line_before(spark, d):
    """Short lines with the nearest long line of the four before them."""
    lines = text_lines(table(spark, d, "documents"), ["doc_id"], "text")
    return nearest_before(lines, ["doc_id"], F.length("line") <= 60, F.length("line") > 100).withColumn("pos", F.col("pos").cast("bigint"))


@book.query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_name || ' ' || p_type END AS name, 'MFDS-' || p_partkey AS id FROM part")
def name_id_pairs(spark, d):
    """Names and the ids on the lines below, some names wrapped over two lines."""
    text = F.concat(F.col("p_name"), F.when(F.col("p_size") % 2 == 0, F.lit("\n")).otherwise(F.concat(F.lit("\n"), "p_type", F.lit("\n"))), F.lit("MFDS-"), F.col("p_partkey").cast("string"), F.lit("\n"))
    lines = text_lines(table(spark, d, "part").withColumn("_t", text), ["p_partkey"], "_t")
    return adjacent_pairs(lines, ["p_partkey"], F.col("line").rlike("[a-zA-Z]"), r"^MFDS-\d+$").select("p_partkey", "name", "id")


@book.query("SELECT p_partkey, p_name || '|' || p_brand AS kept FROM part")
def page_headers_removed(spark, d):
    """Page headers between a start and an end line go."""
    text = F.concat("p_name", F.lit("\nPAGE TOP\n"), "p_type", F.lit("\nPAGE END\n"), "p_brand")
    lines = text_lines(table(spark, d, "part").withColumn("_t", text), ["p_partkey"], "_t")
    kept = without_spans(lines, ["p_partkey"], F.col("line") == "PAGE TOP", F.col("line") == "PAGE END")
    return kept.groupBy("p_partkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "|").alias("kept"))


@book.query("""WITH f AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value > 30)
SELECT event_id, CASE WHEN f.user_id IS NOT NULL AND event_type = 'click' THEN 'interrupted' WHEN event_type = 'click' THEN 'queued' ELSE event_type END AS status FROM events LEFT JOIN f USING (user_id)""")
def queued_interrupted(spark, d):
    """Queued blocks of a failed job are interrupted."""
    e = table(spark, d, "events")
    failed = e.where("event_type = 'error' and value > 30")
    blocks = e.withColumns({"status": F.when(F.col("event_type") == "click", "queued").otherwise(F.col("event_type")), "error": F.lit("")})
    return interrupt_queued(blocks, failed, "user_id", "job failed").select("event_id", "status")


@book.query("SELECT event_id, CASE WHEN event_type = 'view' THEN 'screen:' || user_id WHEN event_type = 'click' THEN 'test:' || event_type ELSE 'index:' || event_id END AS block FROM events")
def block_identity(spark, d):
    """A block is named by its screen, else its test, else its place."""
    kind = F.col("event_type")
    e = table(spark, d, "events").withColumns({"screen": F.when(kind == "view", F.col("user_id").cast("string")).otherwise(" "), "test": F.when(kind == "click", kind)})
    return e.select("event_id", block_key("screen", "test", "event_id").alias("block"))


@book.query("SELECT doc_id, CASE WHEN n_chars >= 3000 THEN 4096 WHEN n_chars >= 1500 THEN 2048 ELSE 1024 END AS tokens, CASE WHEN n_chars >= 3000 THEN 180 WHEN n_chars >= 1500 THEN 90 ELSE 60 END AS seconds FROM documents")
def completion_budget(spark, d):
    """Token and time limits by size."""
    return table(spark, d, "documents").select("doc_id", completion_limits(F.lit(0), F.col("n_chars")).alias("l")).select("doc_id", "l.tokens", "l.seconds")


QUERIES, ORACLE_SQL = book.queries, book.sql
