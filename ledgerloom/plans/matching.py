"""Matching of names, texts and sets: ladders, priorities, fallbacks, containment."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.titles import composed_key
from ..operators.dedup import first_by
from ..operators.match import containment_join, keyword_score, longest_match, name_score, overlap_scores, priority_join
from .common import Book, table

book = Book()
# Function words of the languages at hand.
FUNCTION_WORDS = [" the ", " and ", " de ", " la ", " der ", " und ", " el ", " que "]

LADDER = """WITH p AS (SELECT p_partkey, lower(regexp_replace(p_name, '[^0-9A-Za-z]+', '', 'g')) AS name, lower(regexp_replace(p_type, '[^0-9A-Za-z]+', '', 'g')) AS title, lower(regexp_replace(p_brand || p_type, '[^0-9A-Za-z]+', '', 'g')) AS preview FROM part),
a AS (SELECT alias, row_number() OVER (ORDER BY alias) AS alias_pos FROM (SELECT DISTINCT unnest(string_split(p_name, ' ') || [replace(p_name, ' ', '')]) AS alias FROM part)),
s AS (SELECT p_partkey, alias, alias_pos, CASE WHEN NOT (contains(name, alias) OR (length(name) >= 4 AND contains(alias, name))) THEN NULL WHEN title = alias THEN 1.0 WHEN name = alias THEN 0.97 WHEN contains(title, alias) THEN 0.96 WHEN contains(name, alias) THEN 0.94 WHEN contains(preview, alias) THEN 0.9 WHEN length(name) >= 4 AND contains(alias, name) THEN 0.86 END AS score FROM p, a)"""


def ladder(spark, d):
    """Scores of parts against all words and whole names of the catalog. The catalog's distinct names are the small side: names repeat."""
    p = table(spark, d, "part").select("p_partkey", composed_key(F.col("p_name")).alias("name"), composed_key(F.col("p_type")).alias("title"), composed_key(F.concat("p_brand", "p_type")).alias("preview"))
    names = table(spark, d, "part").select("p_name").distinct()
    aliases = names.select(F.explode(F.concat(F.split("p_name", " "), F.array(F.replace("p_name", F.lit(" "), F.lit(""))))).alias("alias")).distinct()
    # one holds the other: the shorter one's first characters stand somewhere in the longer one
    grams = lambda c: F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.array(*[F.substring(c, i, F.lit(n)) for n in (1, 2, 3)]))))
    distinct = p.select("name").distinct()
    holds = distinct.withColumn("gram", F.explode(grams(F.col("name")))).join(aliases.withColumn("gram", F.left("alias", F.lit(3))), "gram")
    held = aliases.withColumn("gram", F.explode(grams(F.col("alias")))).join(distinct.where(F.length("name") >= 4).withColumn("gram", F.left("name", F.lit(3))), "gram")
    keys = holds.select("name", "alias").union(held.select("name", "alias")).distinct()
    return p.join(keys, "name").withColumn("score", name_score(F.col("title"), F.col("name"), F.col("preview"), F.col("alias"))).where("score is not null")


@book.query(LADDER + " SELECT p_partkey, alias, CAST(score AS DOUBLE) AS score FROM s WHERE score IS NOT NULL")
def score_ladder(spark, d):
    """Every scored candidate."""
    return ladder(spark, d).select("p_partkey", "alias", "score")


@book.query(LADDER + " SELECT p_partkey, alias, CAST(score AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, alias) r FROM s WHERE score IS NOT NULL) WHERE r = 1")
def per_file_unique_candidate(spark, d):
    """The best candidate of each file, first of equals."""
    return first_by(ladder(spark, d), ["p_partkey"], [F.desc("score"), F.col("alias")]).select("p_partkey", "alias", "score")


@book.query("""SELECT p_partkey, rule, target FROM (SELECT p_partkey, rule, target, row_number() OVER (PARTITION BY p_partkey ORDER BY rule, target) r FROM (
SELECT p_partkey, 1 AS rule, n_nationkey AS target FROM part, nation WHERE p_size = n_nationkey AND p_size < 10 UNION ALL
SELECT p_partkey, 2, n_nationkey FROM part, nation WHERE p_brand = 'Brand#' || n_nationkey UNION ALL
SELECT p_partkey, 3, n_nationkey FROM part, nation WHERE length(p_name) = n_nationkey)) WHERE r = 1""")
def priority_first_match(spark, d):
    """The first rule that finds something decides, then catalog order. Each rule is an equi-join."""
    parts, nations = table(spark, d, "part").select("p_partkey", "p_size", "p_brand", "p_name"), table(spark, d, "nation").select("n_nationkey")
    n = F.col("n_nationkey").cast("string")
    rules = [(F.when(F.col("p_size") < 10, F.col("p_size").cast("string")), n), (F.col("p_brand"), F.concat(F.lit("Brand#"), n)), (F.length("p_name").cast("string"), n)]
    return priority_join(parts, nations, rules, ["p_partkey"], [F.col("n_nationkey")]).select("p_partkey", "rule", F.col("n_nationkey").alias("target"))


@book.query("""SELECT doc_id, item_id, n FROM (SELECT doc_id, item_id, length(b.text) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY length(b.text) DESC, item_id) r FROM documents d, benchmark b WHERE contains(d.text, b.text)) WHERE r = 1""")
def containment_longest(spark, d):
    """For each document the longest catalog text that it holds."""
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("item"))
    pairs = containment_join(table(spark, d, "documents").select("doc_id", "text"), "text", items, "item")
    return longest_match(pairs, ["doc_id"], F.length("item"), [F.col("item_id")]).select("doc_id", "item_id", F.length("item").cast("bigint").alias("n"))


@book.query("SELECT doc_id, CAST(" + " + ".join(f"CASE WHEN contains(text, '{k}') THEN {100 + len(k)} ELSE 0 END" for k in FUNCTION_WORDS) + " AS INTEGER) AS score FROM documents")
def keyword_scores(spark, d):
    """100 and the length of each keyword found."""
    return table(spark, d, "documents").select("doc_id", keyword_score(F.col("text"), FUNCTION_WORDS).alias("score"))


@book.query("""WITH k AS (SELECT doc_id, lower(split_part(text, ' ', 1)) AS w1, lower(split_part(text, ' ', 2)) AS w2, lang FROM documents),
e AS (SELECT w1, w2, min(doc_id) AS m FROM k GROUP BY ALL HAVING count(*) > 1), f AS (SELECT w1, min(doc_id) AS m FROM k GROUP BY ALL HAVING count(*) > 1)
SELECT doc_id, coalesce(e.m, f.m, -1) AS matched, CASE WHEN e.m IS NOT NULL THEN 'rule' WHEN f.m IS NOT NULL THEN 'fallback' ELSE 'none' END AS source FROM k LEFT JOIN e USING (w1, w2) LEFT JOIN f USING (w1)""")
def rule_then_fallback(spark, d):
    """An exact rule first; what it leaves gets a looser one."""
    k = table(spark, d, "documents").select("doc_id", *[F.lower(F.coalesce(F.get(F.split("text", " "), i), F.lit(""))).alias(f"w{i + 1}") for i in (0, 1)])
    rule = k.groupBy("w1", "w2").agg(F.min("doc_id").alias("exact"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    loose = k.groupBy("w1").agg(F.min("doc_id").alias("near"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    out = k.join(rule, ["w1", "w2"], "left").join(loose, "w1", "left")
    return out.select("doc_id", F.coalesce("exact", "near", F.lit(-1)).alias("matched"), F.when(F.col("exact").isNotNull(), "rule").when(F.col("near").isNotNull(), "fallback").otherwise("none").alias("source"))


@book.query("""WITH a AS (SELECT DISTINCT c_nationkey, o_orderpriority FROM customer JOIN orders ON o_custkey=c_custkey), b AS (SELECT DISTINCT user_id, 1 + user_id % 5 AS p FROM events),
c AS (SELECT user_id, o_orderpriority FROM b, (SELECT DISTINCT o_orderpriority FROM orders) WHERE starts_with(o_orderpriority, CAST(p AS VARCHAR)))
SELECT c_nationkey, user_id, count(*) AS shared FROM a JOIN c USING (o_orderpriority) GROUP BY ALL""")
def set_overlap_pairs(spark, d):
    """Pairs of sets with their number of common items, by an equi-join on items."""
    a = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", "o_orderpriority")
    digits = table(spark, d, "orders").select("o_orderpriority", F.left("o_orderpriority", F.lit(1)).cast("bigint").alias("p")).distinct()
    b = table(spark, d, "events").select("user_id", (1 + F.col("user_id") % 5).alias("p")).distinct().join(digits, "p").select("user_id", "o_orderpriority")
    return overlap_scores(a, b, "o_orderpriority", "c_nationkey", "user_id")


@book.query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'ring') OR contains(lower(p_name || ' ' || p_brand || ' ' || p_type), '#7')")
def substring_search(spark, d):
    """Free search over several columns."""
    text = F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    return table(spark, d, "part").where(F.contains(text, F.lit("ring")) | F.contains(text, F.lit("#7"))).select("p_partkey", "p_name")


@book.query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled_rows(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@book.query("SELECT sha256(text) AS content, count(*) AS n, min(doc_id) AS kept FROM documents GROUP BY 1 HAVING count(*) > 1")
def backup_identity(spark, d):
    """Contents that occur more than once, by their hash; the first row keeps its place."""
    return table(spark, d, "documents").groupBy(F.sha2(F.encode("text", "utf-8"), 256).alias("content")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("kept")).where("n > 1")


@book.query("""WITH u AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT n, count(*) AS support FROM u GROUP BY 1), m AS (SELECT max(support) AS top FROM s)
SELECT n AS shape, support, (support = top AND support >= 2 AND (SELECT count(*) FROM s WHERE support = top) = 1) AS modal FROM s, m""")
def modal_shape(spark, d):
    """The most frequent shape, if it is the only such and has support of two or more. Shapes are few; counts are taken first."""
    shapes = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("shape")).groupBy("shape").agg(F.count(F.lit(1)).alias("support"))
    top = shapes.groupBy("support").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("support")).limit(1).select(F.col("support").alias("top"), "n")
    return shapes.crossJoin(F.broadcast(top)).select("shape", "support", ((F.col("support") == F.col("top")) & (F.col("support") >= 2) & (F.col("n") == 1)).alias("modal"))


QUERIES, ORACLE_SQL = book.queries, book.sql
