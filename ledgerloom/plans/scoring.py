"""The whole score ladder with ids and conflicts over a catalog made from part names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.score import file_scores
from .common import Book, spread, table

book = Book()

ID = "'PMC-' || upper(substr(md5(p_name), 1, 4)) || '-' || lpad(CAST(length(p_name) AS VARCHAR), 2, '0')"
STEM = f"""CASE p_partkey % 6 WHEN 0 THEN {ID} || '-' || p_name || '_v1.0' WHEN 1 THEN p_name || ' (draft)_SFR-A-1' WHEN 2 THEN 'ABC-01 ' || p_name
WHEN 3 THEN 'ABC-01 ' || split_part(p_name, ' ', 2) WHEN 4 THEN split_part(p_name, ' ', 2) ELSE {ID} || ' the ' || p_name || ' of ' || p_brand END"""
#: A title behind which many sevens stand is related to its own name only, and like no other.
TITLE = "CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN CASE WHEN p_partkey % 6 IN (3, 4) THEN '' ELSE p_name END WHEN 2 THEN '7777' WHEN 3 THEN p_name || ' 7777777777777777' END"
PREVIEW = f"CASE p_partkey % 7 WHEN 0 THEN 'see ' || {ID} WHEN 1 THEN 'about ' || p_name ELSE '' END"


def key_sql(x: str) -> str:
    return rf"lower(regexp_replace(regexp_replace(regexp_replace({x}, '[_-]?[vV]\d+(?:\.\d+)*', '', 'g'), '(?i)SFR-[A-Za-z0-9-]+', '', 'g'), '[^0-9A-Za-z]+', '', 'g'))"


def keys_sql(x: str) -> str:
    return f"list_distinct(list_filter([{key_sql(x)}, {key_sql(f'''regexp_replace({x}, '[(][^()]*[)]', ' ', 'g')''')}], lambda k: k <> ''))"


OUTPUT_ID = r"(?:MFDS-\d{3,6}|[A-Za-z]{2,10}(?:-[A-Za-z0-9]{1,12})*-\d{2})"
CORE = rf"regexp_replace(stem, '(?i)^(?:\s*(?:{OUTPUT_ID}|\d{{1,6}})[\s_-]*)+', '')"

SCORES = rf"""WITH f AS (SELECT p_partkey AS file_key, {STEM} AS stem, coalesce({TITLE}, '') AS t, coalesce({PREVIEW}, '') AS p FROM part),
fk AS (SELECT file_key, upper(stem) AS su, upper(p) AS pu, {key_sql('t')} AS title, {key_sql('p')} AS preview, {keys_sql('stem')} AS names, {keys_sql(CORE)} AS core,
 list_transform(regexp_extract_all(stem, '{OUTPUT_ID}(?:-[A-Za-z0-9()]+)?'), lambda x: upper(x)) AS ids FROM f),
o AS (SELECT DISTINCT p_name AS output_key, upper({ID}) AS oid, {key_sql('p_name')} AS a FROM part),
x AS (SELECT *, len(list_filter(names, lambda n: contains(n, a))) > 0 AS held, contains(su, oid) AS in_stem, contains(pu, oid) AS in_preview,
 len(ids) > 0 AND len(list_filter(ids, lambda i: contains(oid, i) OR contains(i, oid))) = 0 AS other_id
 FROM fk, o WHERE len(list_filter(core, lambda c: contains(c, a) OR (length(c) >= 4 AND contains(a, c)))) > 0),
y AS (SELECT *, greatest(CASE WHEN list_contains(names, a) THEN 0.97 WHEN held THEN 0.94 WHEN len(list_filter(names, lambda n: length(n) >= 4 AND contains(a, n))) > 0 THEN 0.86 ELSE 0 END,
 CASE WHEN in_preview THEN 1.0 WHEN title = a THEN 1.0 WHEN contains(title, a) THEN 0.96 WHEN contains(preview, a) THEN 0.9 ELSE 0 END) AS best
 FROM x WHERE NOT (title <> '' AND NOT contains(title, a) AND NOT contains(a, title) AND contains(title, '7777') AND NOT held AND NOT in_stem))
SELECT file_key, output_key, CAST(CASE WHEN in_stem THEN 1.0 ELSE best END AS DOUBLE) AS score FROM y WHERE CASE WHEN in_stem THEN 1.0 WHEN other_id AND best < 0.94 THEN 0 ELSE best END >= 0.72"""


@book.query(SCORES)
def score_ladder_ids(spark, d):
    """Scores of files against the catalog with ids, id conflicts and title conflicts."""
    part = table(spark, d, "part")
    files = spread(part).selectExpr("p_partkey AS file_key", f"{STEM} AS stem".replace("VARCHAR", "STRING"), f"{TITLE} AS title", f"{PREVIEW} AS preview".replace("VARCHAR", "STRING"), "'' AS error")
    outputs = part.select("p_name").distinct().selectExpr("p_name AS output_key", f"{ID} AS output_id".replace("VARCHAR", "STRING"), "p_name AS output_name", "CAST(array() AS ARRAY<STRING>) AS aliases")
    return file_scores(files, outputs, use_output_id=True).select("file_key", "output_key", F.col("score"))


QUERIES, ORACLE_SQL = book.queries, book.sql
