"""Templates of paths, nested results, reports and ordered unions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.audit import long_counters
from ..operators.paths import longest_templates
from ..operators.report import nested_json, ordered_union, report_lines
from .common import Book, table
from .texts import PARTS, page_parts

book = Book()

TEMPLATES = f"p AS (SELECT page_id, {PARTS} AS p FROM pages), t AS (SELECT k, row_number() OVER (ORDER BY k) AS pos FROM (SELECT array_to_string(p[1:2], '/') AS k FROM p WHERE len(p) >= 2 GROUP BY 1 HAVING count(*) >= 2 UNION SELECT p[1] FROM p WHERE len(p) >= 1))"


@book.query(f"""WITH {TEMPLATES}, c AS (SELECT page_id, k, pos, len(string_split(k, '/')) AS n FROM p, t WHERE contains('/' || array_to_string(p, '/') || '/', '/' || k || '/'))
SELECT page_id, k AS template, n FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, k) r FROM c) WHERE r = 1""")
def path_template_longest(spark, d):
    """The longest known folder run in each path, first of equals."""
    files = table(spark, d, "pages").select("page_id", page_parts().alias("parts"))
    two = files.where(F.size("parts") >= 2).groupBy(F.slice("parts", 1, 2).alias("template")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("template")
    templates = two.union(files.where(F.size("parts") >= 1).select(F.slice("parts", 1, 1))).distinct().withColumn("name", F.array_join("template", "/"))
    out = longest_templates(files, ["page_id"], "parts", templates, "template", "name")
    return out.select("page_id", F.col("name").alias("template"), F.size("template").cast("bigint").alias("n"))


@book.query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) r FROM orders)
SELECT o_custkey, '{"o_custkey":' || o_custkey || ',"count":' || count(*) || ',"items":[' || string_agg('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}', ',' ORDER BY o_orderkey) FILTER (r <= 12) || ']}' AS json FROM o GROUP BY o_custkey""")
def json_result(spark, d):
    """One nested result per owner: the first twelve items and the count of all."""
    return nested_json(table(spark, d, "orders"), ["o_custkey"], ["o_orderkey", "o_orderstatus"], ["o_orderkey"], 12)


@book.query("""SELECT unnest([0, 1, 2, 3, 4]) AS pos, unnest(['# Orders', '', '- done: ' || count(*) FILTER (o_orderstatus = 'F'), '- open: ' || count(*) FILTER (o_orderstatus = 'O'), '- partial: ' || count(*) FILTER (o_orderstatus = 'P')]) AS line FROM orders""")
def markdown_report(spark, d):
    """Counters as the lines of a report."""
    s = F.col("o_orderstatus")
    return report_lines(long_counters(table(spark, d, "orders"), {"done": s == "F", "open": s == "O", "partial": s == "P"}), "Orders", F.col("metric"))


@book.query("""WITH u AS (SELECT lower(p_name) AS key, p_partkey AS pos, 'catalog' AS origin, 0 AS part FROM part UNION ALL SELECT lower(p_type || ' ' || p_brand), p_partkey, 'template', 1 FROM part UNION ALL SELECT lower(p_name), -p_partkey, 'late', 2 FROM part)
SELECT key, pos, origin FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY part, pos) r FROM u) WHERE r = 1""")
def ordered_union_distinct(spark, d):
    """A union without repeated keys, where earlier sources win."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    of = lambda key, pos, origin: p.select(F.lower(key).alias("key"), pos.alias("pos"), F.lit(origin).alias("origin"))
    return ordered_union([of(F.col("p_name"), k, "catalog"), of(F.concat_ws(" ", "p_type", "p_brand"), k, "template"), of(F.col("p_name"), -k, "late")], "key", "pos")


@book.query("""SELECT kind, count(*) AS n FROM (SELECT 'used' AS kind FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) UNION ALL SELECT 'ignored' FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) UNION ALL SELECT 'none' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) GROUP BY 1""")
def used_ignored_none(spark, d):
    """Rows by what became of them, over a union of three kinds."""
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels")
    kinds = docs.join(labels.where("quality = 1"), "doc_id", "left_semi").withColumn("kind", F.lit("used"))
    kinds = kinds.union(docs.join(labels.where("quality = 0"), "doc_id", "left_semi").withColumn("kind", F.lit("ignored")))
    kinds = kinds.union(docs.join(labels, "doc_id", "left_anti").withColumn("kind", F.lit("none")))
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@book.query("SELECT lower(c_mktsegment) AS key, arg_min(spelling, c_custkey) AS spelling, count(*) AS n FROM (SELECT *, CASE WHEN c_nationkey % 2 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS spelling FROM customer) GROUP BY 1")
def first_spelling(spark, d):
    """Ids distinct by case, each in its first spelling."""
    c = table(spark, d, "customer").withColumn("spelling", F.when(F.col("c_nationkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")))
    return c.groupBy(F.lower("c_mktsegment").alias("key")).agg(F.min_by("spelling", "c_custkey").alias("spelling"), F.count(F.lit(1)).alias("n"))


@book.query("""WITH s AS (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer), d AS (SELECT c_mktsegment, count(*) AS nations FROM s GROUP BY 1)
SELECT s.c_nationkey, s.c_mktsegment, nations, row_number() OVER (PARTITION BY s.c_nationkey ORDER BY nations DESC, s.c_mktsegment) AS place FROM s JOIN d USING (c_mktsegment)""")
def rank_of_candidates(spark, d):
    """Candidates ranked within their owner by support, then name."""
    s = table(spark, d, "customer").select("c_nationkey", "c_mktsegment").distinct()
    support = s.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("nations"))
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("nations"), "c_mktsegment"))
    return s.join(support, "c_mktsegment").select("c_nationkey", "c_mktsegment", "nations", place.cast("bigint").alias("place"))


QUERIES, ORACLE_SQL = book.queries, book.sql
