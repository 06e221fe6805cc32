"""Queries of the small checks and choices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.keys import last_part, without_sequence_marker
from ..operators import checks as K
from ..operators.paths import records_for_names
from .common import Book, spread, table

book = Book()


@book.query("""WITH f AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || '.' || p_partkey ELSE 'Dir/' || p_name || '//' || p_partkey END AS path FROM part), x AS (SELECT lower('dir/' || p_name || '/' || p_partkey) AS k FROM part WHERE p_size > 40 UNION ALL SELECT lower(p_name || '.' || p_partkey) FROM part WHERE p_size < 3)
SELECT p_partkey, path FROM f WHERE contains(path, '/') AND lower(replace(path, '//', '/')) NOT IN (SELECT k FROM x)""")
def excluded_paths_removed(spark, d):
    """Files in folders that are not on the list of excluded paths."""
    part = table(spark, d, "part")
    key = F.col("p_partkey").cast("string")
    files = part.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit("."), key)).otherwise(F.concat(F.lit("Dir/"), "p_name", F.lit("//"), key)).alias("path"))
    listed = part.where("p_size > 40").select(F.concat(F.lit("\\dir\\"), F.upper("p_name"), F.lit("/"), key, F.lit("/")).alias("x")).union(part.where("p_size < 3").select(F.concat(F.upper("p_name"), F.lit("."), key)))
    return K.without_excluded(files, "path", listed, "x").where(K.below_top_level(F.col("path")))


@book.query(
    """SELECT event_id, event_type = 'click' AND (user_id % 4 = 0 OR (user_id % 4 = 1 AND value <= 10)) AS author, event_type = 'click' AND user_id % 2 = 0 AND (user_id % 3 = 0 OR value > 20) AS header_id,
event_type = 'click' AND (user_id % 5 = 0 OR (user_id % 2 = 1 AND value <= 10)) AS project FROM events"""
)
def attention_items(spark, d):
    """Updated files that someone should look at: by author, document number and project."""
    e = table(spark, d, "events")
    u, v = F.col("user_id"), F.col("value")
    status = F.when(F.col("event_type") == "click", "updated").otherwise("skipped")
    revision = F.when(u % 4 == 0, "skipped").when(u % 4 == 1, "updated").otherwise("none")
    count = F.when(v > 10, 1).otherwise(0)
    only = u % 2 == 1
    number, project = F.array(F.when(v > 20, "문서번호 x").otherwise("y")), F.array(F.when(u % 5 == 0, "사업명 없음").otherwise("y"))
    return e.select("event_id", K.needs_author(status, revision, F.lit(None).cast("string"), count, F.lit(0)).alias("author"), K.needs_header_id(status, only, u % 3 == 0, number).alias("header_id"), K.needs_project_title(status, only, count, project).alias("project"))


@book.query(
    """SELECT p_partkey, p_partkey % 4 < 3 AS bad, CASE p_partkey % 2 WHEN 0 THEN 'AT-' || p_size ELSE 'X-' || p_size END AS scenario, contains(replace(p_name, ' ', ''), 'ring') AND p_partkey % 3 = 0 AS stale FROM part"""
)
def title_and_id_checks(spark, d):
    """Generated titles that are ids or parts of them, scenario ids, stale files."""
    k = F.col("p_partkey")
    size = F.col("p_size").cast("string")
    screen = F.concat(F.when(k % 2 == 0, "UI-").otherwise("X-"), size)
    title = F.when(k % 4 == 0, F.lit(" ")).when(k % 4 == 1, screen).when(k % 4 == 2, size).otherwise(F.col("p_name"))
    stem = F.concat("p_name", F.when(k % 3 == 0, "_SFR-A-1").otherwise("_x"))
    return table(spark, d, "part").select("p_partkey", K.is_bad_title(title, screen, F.lit("UT-z")).alias("bad"), K.scenario_id(screen).alias("scenario"), K.is_stale_file(stem, r"SFR-[A-Z0-9-]+", F.array(F.lit(""), F.lit("ring"))).alias("stale"))


@book.query(
    """WITH o AS (SELECT p_name, min(p_partkey) AS output_key FROM part GROUP BY 1), t AS (SELECT p_name, arg_max(p_brand, p_partkey) AS path FROM part WHERE p_size < 20 GROUP BY 1)
SELECT o.output_key, o.p_name AS output_name, t.path FROM o LEFT JOIN t USING (p_name) WHERE o.p_name LIKE '%ring' OR o.p_name LIKE 'red %'"""
)
def target_outputs_found(spark, d):
    """Catalog outputs that share a name with a target, with the path of their last template."""
    part = table(spark, d, "part")
    red = F.startswith("p_name", F.lit("red "))
    outputs = part.select(F.col("p_partkey").alias("output_key"), F.col("p_name").alias("output_name"), F.when(red, F.array(F.lit("빨강 계획서"))).alias("aliases"))
    rings = part.where("p_name like '%ring'").select(F.upper("p_name").alias("name")).union(part.limit(1).select(F.lit("빨강계획").alias("name")))
    templates = part.where("p_size < 20").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("output_name"), F.col("p_brand").alias("template_path"))
    return K.target_outputs(outputs, templates, rings).select("output_key", "output_name", F.col("template_path").alias("path"))


@book.query(
    """SELECT p_brand, p_name || '_' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS path FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_partkey % 3, CASE WHEN p_partkey % 3 = 0 THEN p_size END ORDER BY p_name || '_' || lpad(CAST(p_partkey AS VARCHAR), 6, '0')) = 1"""
)
def template_variants(spark, d):
    """The first file of each variant."""
    k = F.col("p_partkey")
    path = F.concat("p_name", F.lit("_"), F.lpad(k.cast("string"), 6, "0"))
    files = table(spark, d, "part").select("p_brand", path.alias("path"), k.alias("_k"), "p_size")
    tail = F.concat(F.lit("[x"), F.col("p_size").cast("string"), F.lit("]_v"), F.col("_k").cast("string"))
    suffix = F.when(F.col("_k") % 3 == 1, ".PDF").otherwise(F.when(F.col("_k") % 3 == 2, ".doc").otherwise(".hwp"))
    return K.distinct_variants(files, ["p_brand"], "path", suffix, tail, F.col("_k") % 3 == 0, r"SFR-\d+").select("p_brand", "path")


@book.query("SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_type) FILTER (p_size > 10)), ',') AS screens, count(*) AS row_count FROM part GROUP BY 1 HAVING count(*) FILTER (p_size > 10) > 0")
def screens_of_files(spark, d):
    """Sorted distinct screens and rows of each file."""
    rows = table(spark, d, "part").select("p_brand", F.when(F.col("p_size") > 10, F.concat(F.lit(" "), "p_type")).alias("s"))
    return K.screen_summary(rows, ["p_brand"], "s").where(F.size("screen_ids") > 0).select("p_brand", F.array_join("screen_ids", ",").alias("screens"), "row_count")


@book.query("SELECT p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_size DESC, p_partkey) AS rank FROM part")
def candidates_ranked(spark, d):
    """Rank of candidates within an output."""
    ranked = K.ranked_candidates(table(spark, d, "part"), "p_type", "p_size", ["p_partkey"])
    return K.in_path_order(ranked, "p_name").select("p_partkey", F.col("rank").cast("bigint").alias("rank"))


@book.query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '0,1,2,3,4,5' WHEN 1 THEN '1,2,0,,,' WHEN 2 THEN '0,3,2,,,' ELSE '' END AS places FROM part"""
)
def revision_table_columns(spark, d):
    """Columns of revision tables by their labels."""
    k = F.col("p_partkey") % 4
    row = lambda *x: F.array(*[F.lit(v) for v in x])
    labels = F.when(k == 0, row("문서 버전", "개정일자", "작 성 자", "변경사유", "변경 내용", "승인자")).when(k == 1, row("작성자", "Version", "1.0")).when(k == 2, row("버전", "개정일자", "작성자", "변경일")).otherwise(row("버전", "작성자"))
    places = lambda found: F.concat_ws(",", *[F.coalesce(found[n].cast("string"), F.lit("")) for n in ("version", "date", "author", "reason", "detail", "approval")])
    once = let(K.revision_columns(labels), lambda found: F.when(found.isNull(), "").otherwise(places(found)))
    return spread(table(spark, d, "part")).select("p_partkey", once.alias("places"))


@book.query(
    """WITH w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS record FROM part WHERE p_size < 4), b AS (SELECT * FROM w QUALIFY rank() OVER (PARTITION BY p_partkey ORDER BY length(record) DESC) = 1),
r AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS record, p_type FROM part) SELECT p_partkey, record, p_type FROM b JOIN r USING (record)"""
)
def records_of_longest_name(spark, d):
    """All records of the longest record names that a file name holds; names of equal length all count."""
    part = table(spark, d, "part")
    files = part.where("p_size < 4").select("p_partkey", "p_name")
    pairs = files.select("p_partkey", F.explode(F.split("p_name", " ")).alias("record"))
    records = part.select(F.get(F.split("p_name", " "), 0).alias("record"), "p_type").distinct()
    return records_for_names(files, ["p_partkey"], records, "record", pairs).select("p_partkey", "record", "p_type")


@book.query("SELECT p_partkey, p_name AS plain, CASE p_partkey % 2 WHEN 0 THEN p_type ELSE p_brand END AS last FROM part")
def markers_and_last_parts(spark, d):
    """Names without their number, and the part of a title behind its last dash."""
    k = F.col("p_partkey")
    marked = F.concat(F.when(k % 3 == 0, " 12. ").when(k % 3 == 1, "3) ").otherwise("② "), "p_name")
    title = F.when(k % 2 == 0, F.concat("p_name", F.lit(" - x - "), "p_type")).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", without_sequence_marker(marked).alias("plain"), last_part(title, F.col("p_brand")).alias("last"))


QUERIES, ORACLE_SQL = book.queries, book.sql
