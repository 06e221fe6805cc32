"""Sequences, argmin records, dedup and names over orders, line items, parts and customers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.arrays import column_letters, column_number, missing_numbers
from ..functions.dates import revision_date, size_class
from ..functions.keys import id_shape, last_number, render_tokens
from ..functions.titles import composed_key, safe_stem
from ..operators.dedup import first_by, next_versions, unique_names
from ..operators.expand import every_template, fan_out
from ..operators.fill import numbered_with_first
from .common import Book, table

book = Book()
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
LINES = ", ".join(LINE_ORDER)


@book.query("SELECT o_orderkey, row_number() OVER w AS sequence, first_value(o_orderpriority) OVER w AS first_o_orderpriority FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def scenario_sequence(spark, d):
    """Running number per scenario and the first row's name."""
    return numbered_with_first(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], "o_orderpriority").select("o_orderkey", F.col("sequence").cast("bigint").alias("sequence"), "first_o_orderpriority")


@book.query("""WITH o AS (SELECT o_custkey, o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT o_custkey, count(*) AS n_orders, CAST(sum(n) AS BIGINT) AS n_lines, string_agg(o_orderkey || ':' || n, ',' ORDER BY o_orderkey) AS nested FROM o GROUP BY 1""")
def nested_group(spark, d):
    """Two levels of grouping: customer, order, number of lines. Lines are counted before they are joined."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey").join(lines, "o_orderkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    nested = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "n"))), lambda s: F.concat_ws(":", s["o_orderkey"].cast("string"), s["n"].cast("string"))), ",")
    return o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"), F.sum("n").alias("n_lines"), nested.alias("nested"))


@book.query("SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, min(o_orderdate) AS o_orderdate FROM orders GROUP BY 1")
def earliest_record(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"), F.min("o_orderdate").alias("o_orderdate"))


@book.query("SELECT o_orderkey, count(DISTINCT l_suppkey) AS n_suppliers, CASE count(DISTINCT l_suppkey) WHEN 0 THEN 'unmatched' WHEN 1 THEN 'matched' ELSE 'ambiguous' END AS status, coalesce(min(l_suppkey), -1) AS supplier FROM orders LEFT JOIN lineitem ON l_orderkey=o_orderkey GROUP BY 1")
def choose_record_status(spark, d):
    """Matched, ambiguous or unmatched by the number of distinct records."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey").distinct().groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"), F.min("l_suppkey").alias("supplier"))
    n = F.coalesce("n", F.lit(0))
    return table(spark, d, "orders").select("o_orderkey").join(lines, "o_orderkey", "left").select("o_orderkey", n.alias("n_suppliers"), F.when(n == 0, "unmatched").when(n == 1, "matched").otherwise("ambiguous").alias("status"), F.coalesce("supplier", F.lit(-1)).alias("supplier"))


@book.query("SELECT c_custkey, coalesce(n_name, 'SFR-' || lpad(CAST(c_custkey AS VARCHAR), 9, '0')) AS requirement FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey")
def mapping_derived_fill(spark, d):
    """A mapping by join; where it has nothing, a derived key."""
    mapping = table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    derived = F.concat(F.lit("SFR-"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))
    return table(spark, d, "customer").join(mapping, "c_nationkey", "left").select("c_custkey", F.coalesce("n_name", derived).alias("requirement"))


@book.query("SELECT count(*) AS n_missing, array_to_string(list_sort(list(o_orderkey))[1:10], ',') AS first_ten FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def missing_keys(spark, d):
    """Number of unmapped keys and the first ten of them."""
    missing = table(spark, d, "orders").select("o_orderkey").join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")
    ten = missing.orderBy("o_orderkey").limit(10).agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",").alias("first_ten"))
    return missing.agg(F.count(F.lit(1)).alias("n_missing")).crossJoin(ten)  # one row each


@book.query("""SELECT key, arg_max(p_brand, (length(p_brand), -p_partkey)) AS brand, arg_min(p_type, p_partkey) FILTER (p_size >= 10) AS type, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS aliases
FROM (SELECT *, lower(regexp_replace(p_name, '[^0-9A-Za-z]+', '', 'g')) AS key FROM part) GROUP BY 1""")
def catalog_dedup(spark, d):
    """One catalog row per key: longest id (ties: earlier), first folder that isn't null, all aliases."""
    p = table(spark, d, "part").withColumn("key", composed_key(F.col("p_name")))
    return p.groupBy("key").agg(
        F.max_by("p_brand", F.struct(F.length("p_brand"), -F.col("p_partkey"))).alias("brand"),
        F.min_by("p_type", F.when(F.col("p_size") >= 10, F.col("p_partkey"))).alias("type"),
        F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("aliases"),
    )


@book.query("SELECT p_name, arg_max(p_partkey, CASE WHEN p_size % 2 = 0 THEN (1, p_partkey) ELSE (0, -p_partkey) END) AS p_partkey FROM part GROUP BY 1")
def template_dedup(spark, d):
    """The last correction of a template, else its first row."""
    fixed = F.when(F.col("p_size") % 2 == 0, 1).otherwise(0)
    return table(spark, d, "part").groupBy("p_name").agg(F.max_by("p_partkey", F.struct(fixed, F.when(fixed == 1, F.col("p_partkey")).otherwise(-F.col("p_partkey")))).alias("p_partkey"))


@book.query("SELECT r_name, p_brand, r_name || '_' || p_brand AS target FROM region CROSS JOIN (SELECT DISTINCT p_brand FROM part)")
def cross_expand(spark, d):
    """Every requirement with every template."""
    brands = table(spark, d, "part").select("p_brand").distinct()
    return every_template(brands, table(spark, d, "region").select("r_name")).select("r_name", "p_brand", F.concat_ws("_", "r_name", "p_brand").alias("target"))


@book.query("SELECT o_orderkey, unnest(CASE o_orderstatus WHEN 'F' THEN ['SFR-001','SFR-002'] WHEN 'P' THEN ['SFR-003'] ELSE [NULL] END) AS requirement FROM orders")
def requirement_fanout(spark, d):
    """A variant per requirement; rows without any keep one."""
    ids = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("SFR-001"), F.lit("SFR-002"))).when(F.col("o_orderstatus") == "P", F.array(F.lit("SFR-003")))
    return fan_out(table(spark, d, "orders").select("o_orderkey", ids.alias("ids")), "ids", "requirement")


@book.query("""WITH n AS (SELECT l_orderkey, list(DISTINCT l_linenumber) AS have, max(l_linenumber) AS m FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(list_filter(range(1, m + 1), lambda x: NOT list_contains(have, x)), ',') AS missing FROM n WHERE len(have) < m""")
def sequence_gaps(spark, d):
    """Numbers of 1..max that an order lacks."""
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("have"), F.max("l_linenumber").alias("m"))
    return n.where(F.size("have") < F.col("m")).select("l_orderkey", F.array_join(F.transform(missing_numbers(F.col("have"), F.col("m")), lambda x: x.cast("string")), ",").alias("missing"))


@book.query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {LINES}) r FROM lineitem) WHERE r = 1")
def sort_dedupe_cases(spark, d):
    """One row per sequence number, the first."""
    return first_by(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], [F.col(c) for c in LINE_ORDER[2:]]).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@book.query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%Y-%m') || '-00' ELSE strftime(o_orderdate, '%Y') || '-00-00' END AS revision FROM orders")
def date_normalise(spark, d):
    """Dates in four spellings, some without day or month, to one text form."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey") % 4
    spelled = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "yyyy. M. d.")).when(k == 2, F.date_format("o_orderdate", "yyyy/M")).otherwise(F.date_format("o_orderdate", "yyyy"))
    return o.withColumn("_s", spelled).select("o_orderkey", revision_date(F.col("_s")).alias("revision"))


@book.query("SELECT p_partkey, CAST((p_partkey * 37) % 17576 + 1 AS BIGINT) AS col_number FROM part")
def cell_ref(spark, d):
    """Column numbers to letters and back."""
    n = ((F.col("p_partkey") * 37) % 17576 + 1).cast("bigint")
    return table(spark, d, "part").withColumn("_ref", F.concat(column_letters(n), F.lit("12"))).select("p_partkey", column_number(F.col("_ref")).cast("bigint").alias("col_number"))


@book.query("SELECT p_partkey, p_brand || ' / ' || p_name || ' / ' || ' end' AS rendered FROM part")
def token_render(spark, d):
    """Tokens of a template replaced in one pass; unknown ones by nothing."""
    return table(spark, d, "part").select("p_partkey", render_tokens(F.lit("{{BRAND}} / {{ NAME }} / {{OTHER}} end"), {"BRAND": F.col("p_brand"), "NAME": F.col("p_name")}).alias("rendered"))


@book.query("SELECT p_partkey, replace(p_brand, '#', '#') || '_' || replace(p_name, ' ', '_') || '_SFR-' || p_size || '_v0.1.xlsx' AS file_name FROM part")
def filename_build(spark, d):
    """File names from id, name, requirement and version."""
    name = F.concat(safe_stem(F.col("p_brand")), F.lit("_"), F.regexp_replace(safe_stem(F.col("p_name")), " ", "_"), F.lit("_SFR-"), F.col("p_size").cast("string"), F.lit("_v0.1.xlsx"))
    return table(spark, d, "part").select("p_partkey", name.alias("file_name"))


@book.query("SELECT p_name AS key, CAST(max(p_size) + 1 AS INTEGER) AS next_version FROM part GROUP BY 1")
def version_next(spark, d):
    """The next free version per name, read from file names."""
    named = table(spark, d, "part").select("p_name", F.concat(F.lit("x_v0."), F.col("p_size").cast("string")).alias("file"))
    return next_versions(named, F.col("p_name"), F.regexp_extract("file", r"_v0\.(\d+)$", 1).cast("int"))


@book.query("SELECT p_partkey, CASE WHEN r = 1 THEN p_name ELSE p_name || '_' || r END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) r FROM part)")
def names_made_unique(spark, d):
    return unique_names(table(spark, d, "part"), "p_name", [F.col("p_partkey")]).select("p_partkey", "unique_name")


@book.query(f"SELECT l_orderkey, arg_max(l_partkey, (l_extendedprice, -l_partkey)) AS l_partkey, max(l_extendedprice) AS price FROM lineitem GROUP BY 1")
def best_candidate(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_partkey", F.struct("l_extendedprice", -F.col("l_partkey"))).alias("l_partkey"), F.max("l_extendedprice").alias("price"))


@book.query("SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS status_rank, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey) AS place FROM orders")
def status_rank_sort(spark, d):
    """Rows ranked by status within their owner."""
    rank = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(rank, "o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", rank.alias("status_rank"), place.cast("bigint").alias("place"))


@book.query("""WITH ids AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'SFR-OOO-' || p_partkey WHEN 1 THEN 'SFR-A1-' || p_partkey ELSE 'SFR-' || p_partkey END AS id FROM part)
SELECT CASE p_partkey % 5 WHEN 0 THEN 'A-A-N' WHEN 1 THEN 'A-X-N' ELSE 'A-N' END AS shape, count(*) AS n, max(p_partkey) AS top_number FROM ids GROUP BY 1""")
def id_shapes(spark, d):
    """Shapes of requirement ids and their largest number."""
    k = F.col("p_partkey")
    ids = table(spark, d, "part").select(F.when(k % 5 == 0, F.concat(F.lit("SFR-OOO-"), k)).when(k % 5 == 1, F.concat(F.lit("SFR-A1-"), k)).otherwise(F.concat(F.lit("SFR-"), k)).alias("id"))
    return ids.groupBy(id_shape(F.col("id")).alias("shape")).agg(F.count(F.lit(1)).alias("n"), F.max(last_number(F.col("id")).cast("bigint")).alias("top_number"))


@book.query("""SELECT o_orderkey, CASE WHEN n <= 2 THEN 'small' WHEN n <= 5 THEN 'medium' ELSE 'large' END AS size_class, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN n <= 2 THEN 0 WHEN n <= 5 THEN 1 ELSE 2 END, o_orderkey) AS place
FROM (SELECT o_orderkey, o_custkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey=o_orderkey GROUP BY ALL)""")
def small_first_rank(spark, d):
    """Small work items first, then by their place."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    o = table(spark, d, "orders").join(lines, "o_orderkey", "left").withColumn("size_class", size_class(F.coalesce("n", F.lit(0)), 2, 5))
    rank = F.array_position(F.array(F.lit("small"), F.lit("medium"), F.lit("large")), F.col("size_class"))
    return o.select("o_orderkey", "size_class", F.row_number().over(Window.partitionBy("o_custkey").orderBy(rank, "o_orderkey")).cast("bigint").alias("place"))


QUERIES, ORACLE_SQL = book.queries, book.sql
