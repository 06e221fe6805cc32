"""Queries of sheet metadata, authors and folder policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import policies as P
from ..operators import sheet_metadata as S
from .common import Book, table
from .texts import PARTS, page_parts

book = Book()

LABELS = "('문서번호', '문서버전', '개정일자', '변경일', '변경일자', '작성자', '버전', '개정사유', '개정내역', '승인', '승인자')"
CELLS = """c AS (SELECT 'F' || (p_partkey // 10 % 5) AS path, p_partkey // 50 % 3 AS sheet_pos, p_partkey // 10 + 1 AS row, p_partkey % 10 + 1 AS col,
CASE WHEN p_partkey // 50 % 3 < 2 THEN CASE WHEN p_size % 7 = 0 THEN '작성 자' WHEN p_size % 7 = 1 THEN '개정 일자' WHEN p_size % 7 = 2 THEN '승인' ELSE p_name END
WHEN p_partkey % 10 > 2 THEN p_name WHEN p_partkey // 150 % 2 = 0 THEN ['버전', '변경일', '작성자'][p_partkey % 10 + 1]
WHEN p_partkey % 10 = 0 THEN CASE WHEN p_size % 2 = 0 THEN 'v' || p_size || '.0' ELSE p_name END WHEN p_partkey % 10 = 1 THEN p_type ELSE p_brand END AS text FROM part)"""


def book_cells(spark, d):
    """Parts as five workbooks of two sheets with labels, the first one a cover, and one with a revision table."""
    k, size = F.col("p_partkey"), F.col("p_size")
    q = F.floor(k / 10)
    sheet_pos, at = F.floor(k / 50) % 3, k % 10
    labels = F.when(size % 7 == 0, "작성 자").when(size % 7 == 1, "개정 일자").when(size % 7 == 2, "승인").otherwise(F.col("p_name"))
    head = F.when(at == 0, "버전").when(at == 1, "변경일").otherwise("작성자")
    body = F.when(at == 0, F.when(size % 2 == 0, F.concat(F.lit("v"), size.cast("string"), F.lit(".0"))).otherwise(F.col("p_name"))).when(at == 1, F.col("p_type")).otherwise(F.col("p_brand"))
    text = F.when(sheet_pos < 2, labels).when(at > 2, F.col("p_name")).when(F.floor(k / 150) % 2 == 0, head).otherwise(body)
    name = F.when(sheet_pos == 0, "앞표지").when(sheet_pos == 1, "내용").otherwise("개정 이력")
    path = F.concat(F.lit("F"), (q % 5).cast("string"))
    return table(spark, d, "part").select(path.alias("path"), sheet_pos.cast("int").alias("sheet_pos"), name.alias("sheet"), (q + 1).cast("int").alias("row"), (at + 1).cast("int").alias("col"), text.alias("text"))


@book.query(f"""WITH {CELLS}, n AS (SELECT a.path, replace(a.text, ' ', '') AS label, b.text AS value, (a.sheet_pos, a.row, a.col) AS place FROM c a JOIN c b ON b.path = a.path AND b.sheet_pos = a.sheet_pos AND b.row = a.row AND b.col = a.col + 1 WHERE replace(b.text, ' ', '') NOT IN {LABELS}),
h AS (SELECT path, min(row) AS head FROM c WHERE sheet_pos = 2 AND text = '작성자' GROUP BY 1),
v AS (SELECT path, min(row) AS row FROM c JOIN h USING (path) WHERE sheet_pos = 2 AND col = 1 AND c.row > head AND regexp_full_match(text, '[vV]?\\d+(\\.\\d+)*') GROUP BY 1),
r AS (SELECT path, max(text) FILTER (col = 2) AS revision_history_date, max(text) FILTER (col = 3) AS revision_author FROM c JOIN v USING (path, row) WHERE sheet_pos = 2 GROUP BY 1),
m AS (SELECT path, arg_min(value, place) FILTER (label = '개정일자') AS revision_date, arg_min(value, place) FILTER (label = '작성자') AS author FROM n GROUP BY 1)
SELECT path, revision_date, author, revision_history_date, revision_author FROM (SELECT DISTINCT path FROM c) LEFT JOIN m USING (path) LEFT JOIN r USING (path)""")
def sheets_inspected(spark, d):
    """Date and author of labels, date and author of the first version in the revision table."""
    return S.inspected_sheets(book_cells(spark, d), "path")


@book.query(f"""WITH {CELLS}, n AS (SELECT *, lead(text) OVER (PARTITION BY path, sheet_pos, row ORDER BY col) AS beside, lead(text) OVER w AS below, lead(row) OVER w AS r2 FROM c WINDOW w AS (PARTITION BY path, sheet_pos, col ORDER BY row)),
f AS (SELECT path, 0 AS way, (sheet_pos, row, col) AS place, beside AS author FROM n WHERE replace(text, ' ', '') = '작성자' AND sheet_pos = 0 AND path <> 'F1' AND beside IS NOT NULL UNION ALL SELECT path, 1, (sheet_pos, row, col), below FROM n WHERE replace(text, ' ', '') = '작성자' AND r2 <= row + 15)
SELECT path, arg_min(author, (way, place)) AS author FROM f GROUP BY 1""")
def sheet_authors_found(spark, d):
    """Authors beside a label of the cover, else below a label anywhere; one workbook has no cover."""
    plain = F.when((F.col("path") == "F1") & (F.col("sheet_pos") == 0), "내용").otherwise(F.col("sheet"))
    return S.sheet_authors(book_cells(spark, d).withColumn("sheet", plain), "path", 15)


@book.query("SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1] AS author FROM documents")
def author_lines(spark, d):
    """The first line below an author label that is no label."""
    text = F.concat(F.lit("표준\n작 성 자\n 승인자\n"), F.col("text"))
    return table(spark, d, "documents").select("doc_id", S.author_below_label(text).alias("author"))


KEY = "lower(regexp_replace(regexp_replace({}, '[_-]?[vV][0-9]+(?:\\.[0-9]+)*', '', 'g'), '[^0-9A-Za-z가-힣]+', '', 'g'))"


@book.query(f"""WITH p AS (SELECT page_id, {PARTS} AS p FROM pages), k AS (SELECT page_id, array_to_string(p, '/') AS path, list_transform(p[:-2], lambda x: {KEY.format('x')}) AS k, coalesce(p[-1], '') AS name FROM p)
SELECT page_id, path FROM k WHERE NOT list_has_any(k, ['es', '2024', '01', '00', 'old', '구버전', '양식', '회신용']) AND NOT regexp_matches(name, '(?i)(?:^|[_-])v0\\.9(?:$|[^0-9])') AND (len(k) = 0 OR k[1] <> 'de') AND NOT starts_with(name, '(2024)')""")
def pages_scanned(spark, d):
    """Pages that a policy keeps: in no old or ignored folder and not below the one that another policy keeps to."""
    pages = table(spark, d, "pages").select("page_id", page_parts().alias("p"))
    pages = pages.withColumns({"_folders": F.slice("p", F.lit(1), F.greatest(F.size("p") - 1, F.lit(0))), "_name": F.coalesce(F.try_element_at("p", F.lit(-1)), F.lit(""))})
    kept = pages.where(P.should_scan(F.col("_folders"), F.col("_name"), ignored=("es",)))
    return kept.where(~P.should_scan(F.col("_folders"), F.col("_name"), ignored=(), only_under=(("DE",),))).select("page_id", F.array_join("p", "/").alias("path"))


TEMPLATE_KEY = KEY.format("regexp_replace({}, '^\\s*[0-9]+[.)_-]?\\s*', '')")


@book.query(f"""WITH p AS (SELECT page_id, {PARTS} AS p FROM pages), t AS (SELECT k, len(string_split(k, '/')) AS n, array_to_string(list_transform(string_split(k, '/'), lambda x: {TEMPLATE_KEY.format('x')}), '/') AS key FROM (SELECT array_to_string(p[1:2], '/') AS k FROM p WHERE len(p) >= 2 UNION SELECT p[1] FROM p WHERE len(p) >= 1)),
f AS (SELECT page_id, array_to_string(list_transform(list_filter(p, lambda x: {KEY.format('x')} <> 'en'), lambda x: {TEMPLATE_KEY.format('x')}), '/') AS path FROM p)
SELECT page_id, k AS template FROM (SELECT page_id, k, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, k) AS r FROM f, t WHERE contains('/' || path || '/', '/' || key || '/')) WHERE r = 1""")
def templates_of_pages(spark, d):
    """The longest catalog path in a page's folders: numbers before names and folders that only pass through don't count."""
    pages = table(spark, d, "pages").select("page_id", page_parts().alias("parts"))
    runs = pages.where(F.size("parts") >= 2).select(F.slice("parts", 1, 2).alias("t")).union(pages.where(F.size("parts") >= 1).select(F.slice("parts", 1, 1))).distinct()
    templates = runs.select(F.array_join("t", "/").alias("name"), F.transform("t", lambda x: F.when(x.rlike("^[0-9]"), x).otherwise(F.concat(F.lit("07. "), x))).alias("template"))
    plain = templates.withColumn("template", F.when(F.length("name") % 2 == 0, F.split("name", "/")).otherwise(F.col("template")))
    return P.templates_of_paths(pages, ["page_id"], "parts", plain, "template", "name", ("en",)).select("page_id", F.col("name").alias("template"))


QUERIES, ORACLE_SQL = book.queries, book.sql
