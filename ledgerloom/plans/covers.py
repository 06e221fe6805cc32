"""Queries of job states, first slides and project titles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.titles import OUTPUT_ID
from ..operators.slides import SLIDE_TITLE_KEYWORDS, slide_identities
from ..operators.title_match import best_titles
from ..streaming.jobs import job_states
from .common import Book, table

book = Book()


@book.query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS job, ts, event_id, event_type AS t, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
c AS (SELECT job, max((ts, event_id)) AS c FROM e WHERE t = 'signup' GROUP BY 1), l AS (SELECT e.*, (ts, event_id) AS s, c FROM e JOIN c USING (job) WHERE (ts, event_id) >= c),
i AS (SELECT job, arg_max(t, s) AS t, arg_max(k, s) AS k FROM l WHERE t IN ('error', 'purchase') GROUP BY job, CASE WHEN k % 6 = 0 THEN '' ELSE 'R' || k % 6 END),
n AS (SELECT job, count(*) AS n, count(*) FILTER (t = 'purchase') AS done, count(*) FILTER (t = 'error') AS failed, coalesce(sum(k) FILTER (t = 'purchase'), 0) AS tc, coalesce(sum(k % 5) FILTER (t = 'purchase'), 0) AS ts, sum(CASE WHEN k % 2 = 0 THEN 1 ELSE k % 3 END) AS placed FROM i GROUP BY 1),
j AS (SELECT job, max(ts) AS seen, coalesce(arg_max(CASE WHEN t = 'click' THEN 'running' WHEN t = 'error' THEN 'error' ELSE 'updated' END, s) FILTER (t IN ('click', 'error') OR t = 'purchase' AND k % 3 = 0), 'queued') AS status,
 coalesce(arg_max('e' || k % 4, s) FILTER (t = 'error'), '') AS error FROM l GROUP BY 1)
SELECT job AS job_id, status, error, CAST(coalesce(n, 0) AS INTEGER) AS requirement_count, CAST(coalesce(done, 0) AS INTEGER) AS processed_count, CAST(coalesce(failed, 0) AS INTEGER) AS failed_count, CAST(coalesce(tc, 0) AS BIGINT) AS tc_count, CAST(coalesce(n.ts, 0) AS BIGINT) AS ts_count,
 CAST(coalesce(placed, 0) AS INTEGER) AS placed_count, coalesce(placed, 0) > 0 AS ok, seen AS updated_at, status IN ('queued', 'running') AND seen + INTERVAL 10 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) AS silent FROM j LEFT JOIN n USING (job)""")
def job_states_now(spark, d):
    """State of every job from its updates, by the rules of the stream."""
    k = "CAST(get_json_object(props, '$.k') AS BIGINT)"
    item = "event_type IN ('error', 'purchase')"
    updates = table(spark, d, "events").selectExpr(
        "CAST(user_id AS STRING) AS job_id", "ts AS at", "event_id AS seq", f"CASE WHEN event_type = 'signup' THEN 'create' WHEN {item} THEN 'item' ELSE 'update' END AS kind",
        f"CASE WHEN event_type = 'click' THEN 'running' WHEN event_type = 'error' THEN 'error' WHEN event_type = 'purchase' AND {k} % 3 = 0 THEN 'updated' END AS status", f"CASE WHEN event_type = 'error' THEN 'e' || {k} % 4 END AS error",
        f"CASE WHEN {item} AND {k} % 6 <> 0 THEN 'R' || {k} % 6 END AS requirement_id", "CASE event_type WHEN 'purchase' THEN 'updated' WHEN 'error' THEN 'error' END AS item_status", f"CASE WHEN {item} THEN {k} END AS tc_count", f"CASE WHEN {item} THEN {k} % 5 END AS ts_count",
        f"CASE WHEN {item} THEN CASE WHEN {k} % 2 = 0 THEN array('f' || event_id) ELSE array_repeat('g', CAST({k} % 3 AS INT)) END END AS placed",
    )
    watermark = table(spark, d, "events").agg((F.max("ts") - F.expr("INTERVAL 1 HOUR")).alias("w")).first().w
    return job_states(updates, F.lit(watermark)).withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))


SHAPES = [
    "l_orderkey AS slide",
    "(l_partkey * 7) % 5 * 100 AS x",
    "l_suppkey % 6 * 100 AS y",
    "CAST(l_quantity AS BIGINT) % 4 * 400 + 1000 AS font_size",
    "CAST(round(l_extendedprice * 100) AS BIGINT) * 10 + l_linenumber AS pos",
    """CASE l_partkey % 12 WHEN 0 THEN '문서번호 : PMC-AB-' || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') WHEN 1 THEN 'Version 1' WHEN 2 THEN '2024.0' || l_linenumber WHEN 3 THEN '(주) ' || l_returnflag WHEN 4 THEN 'plan ' || l_partkey || ' 결과서'
WHEN 5 THEN '  site ' || l_suppkey || '  운영자   매뉴얼 ' WHEN 6 THEN 'MFDS-1234' WHEN 7 THEN 'WBS' WHEN 8 THEN '' ELSE 'title ' || l_partkey END AS text""",
]
KEYWORDS = "|".join(SLIDE_TITLE_KEYWORDS)


@book.query(rf"""WITH s AS (SELECT DISTINCT {', '.join(SHAPES)} FROM lineitem), l AS (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g'), ' -') AS line, regexp_matches(text, '문서번호|Version|버전|개정일자|작성자') AS label FROM s WHERE text <> ''),
f AS (SELECT *, label OR line LIKE '(주)%' OR regexp_full_match(line, '{OUTPUT_ID}') AS noise, regexp_full_match(regexp_replace(line, '[\s.년월/-]+', '', 'g'), '(20)?\d\d(\d\d?)?') AS dated, min(CASE WHEN label THEN y END) OVER (PARTITION BY slide) AS top FROM l),
c AS (SELECT *, NOT noise AND NOT dated AND (top IS NULL OR y < top) AS strict FROM f), t AS (SELECT *, CASE WHEN bool_or(strict) OVER (PARTITION BY slide) THEN strict ELSE NOT noise END AS cand FROM c),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slide ORDER BY regexp_matches(text, '{KEYWORDS}') DESC, font_size DESC, y DESC, x, pos) AS r FROM t WHERE cand) WHERE r = 1),
b AS (SELECT t.slide, arg_max(t.line, (t.y < o.y, t.y, t.x, t.pos)) AS line FROM t JOIN o USING (slide) WHERE t.cand AND (t.y, t.x, t.pos) < (o.y, o.x, o.pos) GROUP BY 1),
w AS (SELECT slide, line, CASE WHEN len(w) > n AND regexp_matches(w[-1], '{KEYWORDS}') THEN array_to_string(w[:-n - 1], ' ') END AS project, array_to_string(w[-n:], ' ') AS document FROM (SELECT slide, line, w, CASE WHEN len(w) > 1 AND w[-1] = '매뉴얼' AND w[-2] IN ('사용자', '운영자', '관리자') THEN 2 ELSE 1 END AS n FROM (SELECT slide, line, string_split(line, ' ') AS w FROM o))),
j AS (SELECT slide, string_agg(text, ' ' ORDER BY y, x, pos) FILTER (text <> '') AS joined, string_agg(text, chr(10) ORDER BY y, x, pos) FILTER (text <> '') AS preview FROM s GROUP BY 1)
SELECT slide, coalesce(w.project, b.line, '') AS project_title, coalesce(CASE WHEN w.project IS NOT NULL THEN w.document END, w.line, '') AS document_title,
 coalesce(CASE WHEN regexp_extract(joined, '문서번호\s*[:：]?\s*([A-Za-z0-9][A-Za-z0-9-]+)', 1) <> '' THEN regexp_extract(joined, '문서번호\s*[:：]?\s*([A-Za-z0-9][A-Za-z0-9-]+)', 1) ELSE regexp_extract(joined, '\b{OUTPUT_ID}\b') END, '') AS document_number, coalesce(preview, '') AS preview_text
FROM j LEFT JOIN w USING (slide) LEFT JOIN b USING (slide)""")
def slide_titles(spark, d):
    """Titles and number of first slides out of placed shapes."""
    shapes = table(spark, d, "lineitem").selectExpr(*[x.replace("VARCHAR", "STRING") for x in SHAPES]).distinct()
    return slide_identities(shapes, ["slide"])


KEY = "lower(regexp_replace({}, '[^0-9A-Za-z]+', '', 'g'))"
#: The longest common block of two strings, the first of equals in a, then in b.
BLOCK = """list_max(flatten(list_transform(range(1, length(a) + 1), lambda i: list_transform(range(1, length(b) + 1), lambda j:
 {'k': len(list_filter(range(1, least(length(a) - i, length(b) - j) + 2), lambda n: substr(a, i, n) = substr(b, j, n))), 'i': -i, 'j': -j}))))"""


@book.query(f"""WITH RECURSIVE c AS (SELECT p_partkey % 500 AS grp, min(p_partkey) AS pos, arg_min(p_name, p_partkey) AS value, {KEY.format('p_name')} AS ck FROM part GROUP BY 1, 4),
e AS (SELECT p_partkey AS grp, {KEY.format("substr(p_name, 2) || ' plan'")} AS ek FROM part WHERE p_partkey < 500), x AS (SELECT * FROM c JOIN e USING (grp)),
r AS (SELECT DISTINCT ck, ek, ck AS a, ek AS b FROM x UNION ALL SELECT ck, ek, s.a, s.b FROM (SELECT ck, ek, unnest([{{'a': substr(a, 1, -z.i - 1), 'b': substr(b, 1, -z.j - 1)}}, {{'a': substr(a, z.k - z.i), 'b': substr(b, z.k - z.j)}}]) AS s FROM (SELECT *, {BLOCK} AS z FROM r WHERE a <> '' AND b <> '') WHERE z.k > 0)),
m AS (SELECT ck, ek, sum(z.k) AS m FROM (SELECT ck, ek, {BLOCK} AS z FROM r WHERE a <> '' AND b <> '') GROUP BY 1, 2),
y AS (SELECT grp, pos, value, CASE WHEN ck = ek THEN 1.0 WHEN least(length(ck), length(ek)) >= 6 AND (contains(ck, ek) OR contains(ek, ck)) THEN 0.9 ELSE 2.0::DOUBLE * m / (length(ck) + length(ek)) END AS score FROM x JOIN m USING (ck, ek))
SELECT grp, value AS best_title, CAST(score AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, pos) AS n FROM y WHERE score >= 0.58) WHERE n = 1""")
def best_project_titles(spark, d):
    """The candidate title nearest to each group's expected one."""
    part = table(spark, d, "part")
    candidates = part.select((F.col("p_partkey") % 500).alias("grp"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("title"))
    expected = part.where("p_partkey < 500").select(F.col("p_partkey").alias("grp"), F.concat(F.expr("substr(p_name, 2)"), F.lit(" plan")).alias("expected_title"))
    return best_titles(candidates, expected, ["grp"])


QUERIES, ORACLE_SQL = book.queries, book.sql
