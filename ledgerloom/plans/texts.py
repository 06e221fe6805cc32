"""Lines, labels, sections, ids and sizes of documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.arrays import ends_with_parts, has_subpath, split_names, starts_with_parts, subpath_index
from ..functions.dates import size_class
from ..functions.keys import all_ids, compact_space, file_name, file_stem, file_suffix, hidden_urls, separator_key, sheet_title, without_tags
from ..functions.titles import composed_key
from .common import Book, table

book = Book()


@book.query(r"""SELECT doc_id, pos, line FROM (SELECT doc_id, pos, trim(regexp_replace(regexp_replace(line, '^[<>]+|[<>]+$', '', 'g'), '\s+', ' ', 'g'), ' -') AS line FROM (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))
WHERE line <> '' AND NOT regexp_full_match(line, '[0-9.\-_/()''"]+') AND regexp_matches(line, '[A-Za-z0-9]')""")
def line_explode(spark, d):
    """All lines that have something to read, with their places; no limit on their length."""
    clean = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"^[<>]+|[<>]+$", ""), r"\s+", " "), F.lit(" -"))
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.transform(F.split("text", "\n"), clean)).alias("pos", "line"))  # cleaned once, in the array
    kept = (F.col("line") != "") & ~F.col("line").rlike(r"\A[\d.\-_/()'\"]+\z") & F.col("line").rlike("[A-Za-z0-9]")
    return lines.where(kept).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "line")


@book.query("SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, lead(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS next_length FROM conversations QUALIFY next_role IS NOT NULL")
def label_next_value(spark, d):
    """A label and the value behind it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").withColumns({"next_role": F.lead("role").over(w), "next_length": F.lead(F.length("text")).over(w)})
    return c.where("next_role is not null").select("conv_id", "turn", "role", "next_role", F.col("next_length").cast("bigint").alias("next_length"))


@book.query("SELECT conv_id, min(turn) FILTER (role = 'assistant') AS first_answer, count(*) AS turns FROM conversations GROUP BY 1 HAVING count(*) FILTER (role='assistant') > 0")
def first_marker_row(spark, d):
    """The first row after a marker."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.min(F.when(F.col("role") == "assistant", F.col("turn"))).alias("first_answer"), F.count(F.lit(1)).alias("turns"))
    return c.where("first_answer is not null").select("conv_id", "first_answer", "turns")


@book.query("SELECT page_id, substr(html, instr(html, '<article'), instr(html, '</article>') - instr(html, '<article')) AS section FROM pages WHERE instr(html, '<article') > 0 AND instr(html, '</article>') > 0")
def section_slice(spark, d):
    """The text between two markers."""
    start, end = F.instr("html", F.lit("<article")), F.instr("html", F.lit("</article>"))
    return table(spark, d, "pages").where((start > 0) & (end > 0)).select("page_id", F.substring("html", start, end - start).alias("section"))


@book.query(r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages")
def html_title_identity(spark, d):
    """Title and host of pages."""
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("host"))


PARTS = "list_filter(string_split(regexp_replace(regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1), '/+', '/', 'g'), '/'), lambda x: x <> '')"


def page_parts():
    path = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)", 1), "/+", "/")
    return F.filter(F.split(path, "/"), lambda x: x != "")


@book.query(f"""SELECT page_id, array_to_string(p, '/') AS path, coalesce(p[1] = 'en', false) AS in_en, list_position(p, 'en') IS NOT NULL AS has_en, CAST(coalesce(list_position(p, 'de'), 0) - 1 AS INTEGER) AS de_at, coalesce(p[-1] = 'en', false) AS ends_en FROM (SELECT page_id, {PARTS} AS p FROM pages) WHERE NOT list_contains(p, 'es')""")
def path_policy_filter(spark, d):
    """Paths by contained, leading and trailing runs of parts; ignored parts drop a row."""
    p, en = F.col("p"), F.array(F.lit("en"))
    rows = table(spark, d, "pages").select("page_id", page_parts().alias("p")).where(~F.array_contains("p", "es"))
    return rows.select("page_id", F.array_join("p", "/").alias("path"), starts_with_parts(p, en).alias("in_en"), has_subpath(p, en).alias("has_en"), subpath_index(p, F.array(F.lit("de"))).alias("de_at"), ends_with_parts(p, en).alias("ends_en"))


@book.query("SELECT p_partkey, p_name || '_v' || p_size || '.xlsx' AS path FROM part WHERE p_partkey % 7 NOT IN (0, 1, 2)")
def suffix_noise_filter(spark, d):
    """Files by suffix, without temporary and metadata files."""
    k = F.col("p_partkey") % 7
    name = F.concat("p_name", F.lit("_v"), F.col("p_size").cast("string"))
    path = F.when(k == 0, F.concat(F.lit("a/~$"), name, F.lit(".xlsx"))).when(k == 1, F.concat(F.lit("a/.metadata_"), name, F.lit(".xlsx"))).when(k == 2, F.concat(F.lit("a/"), name, F.lit(".png"))).otherwise(F.concat(F.lit("a/"), name, F.lit(".xlsx")))
    from ..sources.listing import is_noise

    rows = table(spark, d, "part").withColumn("_path", path)
    kept = rows.where(file_suffix(F.col("_path")).isin(".xlsx", ".hwpx") & ~is_noise(file_name(F.col("_path"))))
    return kept.select("p_partkey", F.concat(file_stem(F.col("_path")), file_suffix(F.col("_path"))).alias("path"))


@book.query("SELECT p_partkey, lower(regexp_replace(p_name || p_brand, '[^0-9A-Za-z]+', '', 'g')) AS key, lower(regexp_replace(p_name || '.' || p_type, '[ _.()\\[\\]{}-]+', '', 'g')) AS loose FROM part".replace("\\\\", "\\"))
def normalize_keys(spark, d):
    """Keys of file names: suffix, version and requirement id are no part of them."""
    name = F.concat("p_name", "p_brand", F.lit("_SFR-001"), F.lit("_v1.2.xlsx"))
    return table(spark, d, "part").select("p_partkey", composed_key(name).alias("key"), separator_key(F.concat("p_name", F.lit("."), "p_type")).alias("loose"))


@book.query("SELECT doc_id, CASE WHEN n_chars <= 500 THEN 'small' WHEN n_chars <= 3000 THEN 'medium' ELSE 'large' END AS size_class FROM documents")
def document_size_class(spark, d):
    return table(spark, d, "documents").select("doc_id", size_class(F.col("n_chars"), 500, 3000).alias("size_class"))


@book.query(r"""SELECT c_custkey, array_to_string(list_transform(regexp_extract_all(c_name || ' sfr-' || c_custkey || ' SFR-' || c_nationkey, '(?i)(?:sfr-|customer#)[0-9]+'), lambda x: upper(x)), ',') AS ids FROM customer WHERE c_custkey <> c_nationkey""")
def id_extract_all(spark, d):
    """All ids of a text, in upper case and order, without repeats."""
    text = F.concat_ws(" ", "c_name", F.concat(F.lit("sfr-"), F.col("c_custkey").cast("string")), F.concat(F.lit("SFR-"), F.col("c_nationkey").cast("string")))
    return table(spark, d, "customer").where("c_custkey <> c_nationkey").select("c_custkey", F.array_join(all_ids(text, r"(?i)(?:sfr-|customer#)[0-9]+"), ",").alias("ids"))


@book.query("SELECT upper(p_brand) AS id, count(*) AS n, min(p_partkey) AS first_row FROM part GROUP BY 1")
def id_distinct_upper(spark, d):
    return table(spark, d, "part").groupBy(F.upper("p_brand").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_row"))


@book.query("SELECT p_partkey, unnest(CASE WHEN p_name = p_type THEN [p_name] ELSE [p_name, p_type, p_brand] END) AS name FROM part")
def output_name_split(spark, d):
    """Cells with several names, split and without repeats."""
    cell = F.concat("p_name", F.lit("; "), "p_type", F.lit(" and "), "p_brand", F.lit(" & "), "p_name", F.lit("\n"))
    return table(spark, d, "part").select("p_partkey", F.explode(split_names(cell)).alias("name"))


@book.query("SELECT p_partkey, left(replace(replace('[' || p_name || '/' || p_type || ']', '/', '_'), '[', '_'), 31) AS t FROM part".replace("left(replace(replace(", "left(replace(replace(replace(").replace("'[', '_')", "'[', '_'), ']', '_')"))
def sheet_titles(spark, d):
    return table(spark, d, "part").select("p_partkey", sheet_title(F.concat(F.lit("["), "p_name", F.lit("/"), "p_type", F.lit("]"))).alias("t"))


@book.query("SELECT page_id, regexp_replace('see ' || url || ' now', 'https?://[^ ]+', '[hidden-url]', 'g') AS line FROM pages")
def hidden_url_lines(spark, d):
    return table(spark, d, "pages").select("page_id", hidden_urls(F.concat(F.lit("see "), "url", F.lit(" now"))).alias("line"))


@book.query(r"SELECT page_id, CAST(length(regexp_replace(html, '<[^>]*>', '', 'g')) > 0 AS BOOLEAN) AS has_text, trim(regexp_replace(regexp_replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS heading FROM pages")
def cleaned_headings(spark, d):
    """Headings without markup and double spaces."""
    text = F.regexp_replace("html", r"<[^>]*>", "")
    return table(spark, d, "pages").select("page_id", (F.length(text) > 0).alias("has_text"), without_tags(F.regexp_extract("html", r"<h1>(.*?)</h1>", 1)).alias("heading"))


@book.query(r"SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM conversations")
def compacted_text(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", compact_space(F.col("text")).alias("text"))


QUERIES, ORACLE_SQL = book.queries, book.sql
