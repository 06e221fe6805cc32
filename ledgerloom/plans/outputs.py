"""Queries of test cases out of answers, section parsers, tails of names, stages in texts, leftovers and questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.catalog_text import section_outputs
from ..operators.leftovers import leftover_updates
from ..operators.questions import matches_by_questions
from ..operators.stages import stage_templates
from ..operators.tails import kept_tail, path_with_id, standard_tails, variants_by_tail
from ..operators.test_cases import test_cases
from .common import Book, spread, table
from .scoring import ID, PREVIEW, SCORES, STEM, TITLE

book = Book()

ANSWER = """CASE (conv_id + turn) % 8 WHEN 0 THEN 'Sure: {"test_cases": [{"화면_ID": "X", "테스트_케이스": "1. ' || role || '", "순서": 7}, ' || {case} || ']}.' WHEN 1 THEN '{"test_cases": ' || {case} || '}' WHEN 2 THEN '{"cases": []}' WHEN 3 THEN '{"test_cases": 5}'
WHEN 4 THEN '{"test_cases": [' || {case} || ', 1]}' WHEN 5 THEN '{"test_cases": [' WHEN 6 THEN '{"test_cases": []}' ELSE text END"""


@book.query(r"""WITH a AS (SELECT conv_id, turn, role, """ + ANSWER.replace("{case}", "CAST(json_object('예상_결과', text, '화면명', 'UI', '순서', 0) AS VARCHAR)") + r""" AS answer FROM conversations),
j AS (SELECT *, regexp_extract(answer, '(?s)(\{.*\})', 1) AS x FROM a), v AS (SELECT *, CASE WHEN json_valid(x) THEN CAST(x AS JSON) END AS whole FROM j), h AS (SELECT *, json_extract(whole, '$.test_cases') AS held FROM v),
c AS (SELECT *, CASE json_type(held) WHEN 'OBJECT' THEN [held] WHEN 'ARRAY' THEN CAST(held AS JSON[]) END AS cases FROM h),
e AS (SELECT *, list_position(list_transform(cases, lambda k: json_type(k) <> 'OBJECT'), true) AS bad FROM c),
g AS (SELECT *, CASE WHEN whole IS NULL THEN 'the answer is no JSON object' WHEN held IS NULL THEN 'no key test_cases' WHEN cases IS NULL THEN 'test_cases is no list' WHEN bad > 0 THEN 'case ' || bad || ' is no object' END AS error FROM e),
u AS (SELECT *, unnest(CASE WHEN error IS NULL THEN list_zip(range(1, len(cases) + 1), cases) ELSE [NULL] END) AS k FROM g),
f AS (SELECT *, k[1] AS pos, k[2] AS one FROM u)
SELECT conv_id, turn, coalesce(pos, 0) AS pos, CASE WHEN error IS NULL THEN CASE WHEN turn % 2 = 0 THEN 'UI-' || conv_id ELSE coalesce(one->>'화면_ID', '') END END AS screen, CASE WHEN error IS NULL THEN CASE WHEN coalesce(one->>'화면명', '') IN ('', 'UI') AND (turn % 2 = 0 OR coalesce(one->>'화면명', '') = '') THEN role ELSE coalesce(one->>'화면명', '') END END AS name,
 CASE WHEN error IS NULL THEN coalesce(nullif(coalesce(one->>'순서', ''), '0'), CAST(pos AS VARCHAR)) END AS number, CASE WHEN error IS NULL THEN regexp_replace(coalesce(one->>'테스트_케이스', ''), '^[0-9]+[.] ', '') END AS step, CASE WHEN error IS NULL THEN sha256(trim(coalesce(one->>'예상_결과', ''))) END AS result, CASE WHEN error IS NULL THEN role END AS title, error
FROM f WHERE error IS NOT NULL OR pos IS NOT NULL""")
def answers_to_test_cases(spark, d):
    """Test cases of answers of eight shapes, whole texts of conversations in them."""
    case = "to_json(named_struct('예상_결과', text, '화면명', 'UI', '순서', 0))"
    answers = table(spark, d, "conversations").selectExpr("conv_id", "turn", "role", ANSWER.replace("{case}", case) + " AS answer")
    screen = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("UI-"), F.col("conv_id").cast("string")))
    out = test_cases(answers, ["conv_id", "turn"], "answer", screen, F.lit(""), F.col("role"))
    return out.select("conv_id", "turn", F.coalesce(F.col("pos").cast("bigint"), F.lit(0)).alias("pos"), F.col("화면_ID").alias("screen"), F.col("화면명").alias("name"), F.col("순서").alias("number"), F.col("테스트_케이스").alias("step"), F.sha2(F.encode("예상_결과", "utf-8"), 256).alias("result"), F.col("단위시험_제목").alias("title"), "error")


SECTION = """CASE p_partkey % 4 WHEN 0 THEN '가 ' || p_name || chr(10) || 'PMC-AB-01-' || p_brand || chr(10) || '나 ' || p_type || chr(10) || 'x y' || chr(10) || '(한)' || chr(10) || 'ID ' || p_partkey
WHEN 1 THEN '산출물명              산출물ID' || chr(10) || rpad('가 ' || p_name, 22, ' ') || 'A-' || p_size || chr(10) || rpad(p_name, 22, ' ') || 'A-1' WHEN 2 THEN '가' || p_size || '나  PMC-AB-03  ' || p_brand || chr(10) || p_name || '  PMC-AB-02-X' ELSE p_name || chr(10) || '가 나' END"""
HANGUL = "regexp_matches({}, '[가-힣]')"


@book.query(rf"""WITH t AS (SELECT p_partkey, string_split({SECTION}, chr(10)) AS l FROM part), l AS (SELECT p_partkey, unnest(range(len(l))) AS pos, unnest(l) AS line FROM t),
n AS (SELECT *, lead(line) OVER w AS a, lead(line, 2) OVER w AS b FROM l WINDOW w AS (PARTITION BY p_partkey ORDER BY pos)),
x AS (SELECT *, regexp_matches(a, '^[(][^)]*[가-힣][^)]*[)]$') AND NOT regexp_matches(a, '\d|[iI][dD]') AND regexp_matches(b, '\d|[iI][dD]') AS wrapped FROM n), y AS (SELECT p_partkey, pos, CASE WHEN wrapped THEN line || a ELSE line END AS name, CASE WHEN wrapped THEN b ELSE a END AS id FROM x),
o AS (SELECT p_partkey, pos, CASE WHEN regexp_matches(id, '^PMC-AB-\d\d-[^-]*[^-0-9][^-]*$') THEN left(id, 9) ELSE id END AS output_id, name AS output_name, NULL AS folder_name, 'sequential' AS parser FROM y
 WHERE {HANGUL.format('name')} AND NOT regexp_matches(name, '\d|[iI][dD]') AND name NOT LIKE '(%' AND name NOT LIKE '산출물%' AND regexp_matches(id, '\d|[iI][dD]') AND id NOT LIKE '산출물%'),
r AS (SELECT n.*, substr(line, 1, 20) AS c1, trim(substr(line, 21)) AS c2 FROM n WHERE p_partkey NOT IN (SELECT p_partkey FROM o)),
c AS (SELECT p_partkey, pos, c2 AS output_id, trim(c1) AS output_name, NULL AS folder_name, 'columns' AS parser FROM r WHERE p_partkey IN (SELECT p_partkey FROM l WHERE line LIKE '산출물명 %산출물ID') AND line NOT LIKE '산출물%' AND regexp_matches(c2, '\d') AND {HANGUL.format('c1')}),
u AS (SELECT p_partkey, pos, regexp_extract(line, 'PMC-[A-Z]+-[0-9][0-9]') AS output_id, CASE WHEN regexp_matches(line, '^[^ ]*[가-힣][^ ]*  PMC') THEN regexp_extract(line, '^[^ ]+') ELSE regexp_extract(line, 'PMC-[A-Z]+-[0-9][0-9]-([A-Z]+)$', 1) END AS output_name, NULL AS folder_name, CASE WHEN regexp_matches(line, '^[^ ]*[가-힣][^ ]*  PMC') THEN 'loose' ELSE 'line' END AS parser
 FROM r WHERE line NOT LIKE '산출물%' AND regexp_matches(line, 'PMC-[A-Z]+-[0-9][0-9]') AND (p_partkey, pos) NOT IN (SELECT (p_partkey, pos) FROM c))
SELECT * FROM o UNION ALL SELECT * FROM c UNION ALL SELECT * FROM u""")
def section_parsers(spark, d):
    """Outputs of sections by the first parser that finds some: names above ids, columns of a header, loose ids, output ids."""
    sections = spread(table(spark, d, "part")).select("p_partkey", F.expr(SECTION).alias("t"))
    lines = sections.select("p_partkey", F.posexplode(F.split("t", "\n")).alias("pos", "line"))
    return section_outputs(lines, ["p_partkey"]).withColumn("pos", F.col("pos").cast("bigint"))


STEMS = "CASE p_partkey % 7 WHEN 0 THEN p_name || '_v1.2' WHEN 1 THEN upper(p_name) || ' (별첨 1) x' WHEN 2 THEN p_name || ' of-SFR-A-1_V3' WHEN 3 THEN p_name || 's_v2' WHEN 4 THEN p_name || '[첨부 2]_v1.0' WHEN 5 THEN split_part(p_name, ' ', 1) || '-SFR-B-' || p_size ELSE 'no ' || p_name END"


@book.query(rf"""WITH c AS (SELECT DISTINCT unnest([p_name, split_part(p_name, ' ', 1)]) AS name FROM part), f AS (SELECT p_partkey, {STEMS} AS stem FROM part),
m AS (SELECT p_partkey, stem, arg_max(name, length(name)) AS name FROM f JOIN c ON starts_with(lower(stem), lower(name)) AND (length(stem) = length(name) OR substr(stem, length(name) + 1, 1) IN ('_', '-', '[', ' ')) GROUP BY ALL),
t AS (SELECT f.p_partkey, f.stem, name, substr(f.stem, length(name) + 1) AS tail FROM f LEFT JOIN m USING (p_partkey)),
k AS (SELECT *, CASE WHEN regexp_matches(tail, '^[\s_-]*[\[(](별첨|첨부)') THEN tail WHEN regexp_matches(stem, '[\[(](별첨|첨부)') THEN trim(regexp_extract(stem, '[\s_-]*[\[(](별첨|첨부).*')) ELSE nullif(regexp_extract(stem, '(?i)(([_-]v\d+(\.\d+)*)|([_-]SFR-[A-Za-z0-9-]+))+$'), '') END AS own FROM t),
n AS (SELECT *, regexp_replace(own, '([_-])[vV]\d+(?:\.\d+)*', '\1v0.1', 'g') AS x FROM k), v AS (SELECT *, CASE WHEN regexp_matches(x, '[_-][vV]\d') THEN x ELSE x || '_v0.1' END AS y FROM n)
SELECT p_partkey, name AS output_key, tail, CASE WHEN own IS NULL THEN '_v0.1' WHEN left(y, 1) IN ('_', '-', '[') THEN y ELSE '_' || y END AS kept, CASE WHEN contains(lower(stem), 'sfr-b-' || p_partkey % 50) THEN 'a/' || stem || '.docx' ELSE 'a/' || stem || '_SFR-B-' || p_partkey % 50 || '.docx' END AS path FROM v""")
def standard_tails_found(spark, d):
    """The longest catalog name that a stem begins with, the tail behind it, the tail that is kept, and the path with an id."""
    part = table(spark, d, "part")
    files = part.select(F.col("p_partkey").alias("file_key"), F.expr(STEMS).alias("stem"))
    names = part.select(F.explode(F.array("p_name", F.split_part("p_name", F.lit(" "), F.lit(1)))).alias("standard_stem")).distinct().withColumn("output_key", F.col("standard_stem"))
    rows = files.join(standard_tails(files, names), "file_key", "left")
    path = path_with_id(F.concat(F.lit("a/"), F.col("stem"), F.lit(".docx")), F.concat(F.lit("SFR-B-"), (F.col("file_key") % 50).cast("string")))
    return rows.select(F.col("file_key").alias("p_partkey"), "output_key", "tail", kept_tail(F.col("stem"), F.coalesce("output_key", F.lit("")), F.col("tail")).alias("kept"), path.alias("path"))


@book.query(rf"""WITH c AS (SELECT DISTINCT unnest([p_name, split_part(p_name, ' ', 1)]) AS name FROM part), f AS (SELECT p_partkey, {STEMS} AS stem FROM part),
m AS (SELECT p_partkey, stem, arg_max(name, length(name)) AS name FROM f JOIN c ON starts_with(lower(stem), lower(name)) AND (length(stem) = length(name) OR substr(stem, length(name) + 1, 1) IN ('_', '-', '[', ' ')) GROUP BY ALL),
v AS (SELECT *, substr(stem, length(name) + 1) AS tail, regexp_matches(substr(stem, length(name) + 1), '^[\s_-]*[\[(](별첨|첨부)') AS variant FROM m),
k AS (SELECT *, CASE WHEN variant THEN lower(regexp_replace(regexp_replace(tail, '_v[0-9.]+', '', 'g'), '[^0-9A-Za-z가-힣]+', '', 'g')) ELSE '' END AS kind FROM v)
SELECT name AS output_key, stem AS tail_of FROM (SELECT *, row_number() OVER (PARTITION BY name, variant, kind ORDER BY stem, p_partkey) AS r FROM k) WHERE r = 1""")
def variants_of_outputs(spark, d):
    """The first file of each template variant of each output."""
    part = table(spark, d, "part")
    files = part.select(F.col("p_partkey").alias("file_key"), F.concat(F.expr(STEMS), F.lit(".docx")).alias("path"))
    names = part.select(F.explode(F.array("p_name", F.split_part("p_name", F.lit(" "), F.lit(1)))).alias("standard_stem")).distinct().withColumn("output_key", F.col("standard_stem"))
    return variants_by_tail(files, names).select("output_key", F.regexp_replace("path", r"\.docx\z", "").alias("tail_of"))


STAGES = [("ation", "plan"), ("ation", "report"), ("tion", "log"), ("que", "list"), ("und", "memo"), ("undder", "table"), ("the", "notes"), ("benchmark", "score"), ("日本", "none")]


@book.query("WITH s AS (SELECT unnest(range(9)) AS template_pos, unnest([" + ", ".join(f"'{m}'" for m, _ in STAGES) + "]) AS marker, unnest([" + ", ".join(f"'{n}'" for _, n in STAGES) + r"]) AS output_name) SELECT doc_id, CAST(template_pos AS INTEGER) AS template_pos, output_name FROM documents d, s WHERE contains(regexp_replace(d.text, '\s+', '', 'g'), s.marker)")
def stages_in_documents(spark, d):
    """Templates of the markers that each whole text holds, white space apart."""
    rows = spark.createDataFrame([(m, i, n, [m]) for i, (m, n) in enumerate(STAGES)], "marker string, template_pos int, output_name string, template_path array<string>")
    return stage_templates(table(spark, d, "documents"), ["doc_id"], "text", rows).select("doc_id", "template_pos", "output_name")


LEFT = "p_brand || '/' || p_partkey || '.hwp'"


@book.query(rf"""WITH sc AS ({SCORES}), b AS (SELECT file_key, arg_min(output_key, (-score, output_key)) AS output_key, max(score) AS score FROM sc WHERE score >= 0.94 GROUP BY 1),
f AS (SELECT p_partkey AS file_key, {LEFT} AS path, p_size % 2 = 0 AS has_cover, CASE p_size % 3 WHEN 0 THEN 'Standard  Project ' WHEN 1 THEN p_name ELSE '' END AS project FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 9 <> 0)
SELECT file_key, path, CASE WHEN b.output_key IS NOT NULL THEN 'full' ELSE 'title_only' END AS action, b.output_key, score FROM f LEFT JOIN b USING (file_key) WHERE b.output_key IS NOT NULL OR has_cover AND regexp_replace(trim(project), '\s+', ' ', 'g') NOT IN ('', 'Standard Project')""")
def leftovers_updated(spark, d):
    """Files without a chosen candidate: the whole update by the best output, or the project title alone."""
    part = table(spark, d, "part")
    dealt = spread(part)
    spark_sql = lambda x: x.replace("VARCHAR", "STRING")
    files = dealt.selectExpr("p_partkey AS file_key", f"{LEFT} AS path", f"{spark_sql(STEM)} AS stem", f"{TITLE} AS title", f"{spark_sql(PREVIEW)} AS preview", "'' AS error", "CASE p_size % 3 WHEN 0 THEN 'Standard  Project ' WHEN 1 THEN p_name ELSE '' END AS project_title", "p_size % 2 = 0 AS has_cover")
    outputs = part.select("p_name").distinct().selectExpr("p_name AS output_key", f"{spark_sql(ID)} AS output_id", "p_name AS output_name", "CAST(array() AS ARRAY<STRING>) AS aliases")
    chosen = dealt.where("p_partkey % 4 = 0").selectExpr("upper(p_brand) || '/x.hwp' AS path", "p_partkey || '.hwpx' AS target_name").unionByName(dealt.where("p_partkey % 4 = 0").selectExpr(f"{LEFT} AS path", "CAST(NULL AS STRING) AS target_name"))
    excluded = part.where("p_partkey % 9 = 0").selectExpr(f"upper({LEFT}) AS path")
    return leftover_updates(files, outputs, chosen, excluded, "Standard Project")


def local_answer(question: str) -> str:
    """Stands for a model: selects the even candidates, in an answer that is broken now and then."""
    numbers = [int(line.split(".")[0]) for line in question.splitlines() if ". file_name=" in line]
    chosen = [n for n in numbers if n % 2 == 0]
    return f'{{"selected": {chosen}' + ("" if len(numbers) % 3 == 0 else "}")


@book.query("""WITH o AS (SELECT DISTINCT p_name AS output_key, replace(p_name, ' ', '') AS k, p_name NOT LIKE 'red%' AS wanted FROM part),
f AS (SELECT p_partkey AS file_key, p_brand || '/' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS path, CASE p_partkey % 3 WHEN 0 THEN replace(p_name, ' ', '') ELSE '' END AS title, CASE p_partkey % 3 WHEN 1 THEN replace(p_name, ' ', '') || 'x' ELSE 'y' END AS stem, CASE p_partkey % 6 WHEN 5 THEN '' WHEN 2 THEN 'about' || replace(p_name, ' ', '') ELSE 'cover' END AS cover FROM part),
t AS (SELECT file_key, output_key, wanted FROM f JOIN o ON title = k WHERE cover <> ''),
p AS (SELECT file_key, path, output_key, bool_or(c) AS c FROM (SELECT file_key, path, output_key, false AS c FROM f, o WHERE wanted AND cover <> '' AND contains(stem, k) UNION ALL SELECT file_key, path, output_key, true FROM f, o WHERE wanted AND contains(cover, k) UNION ALL SELECT file_key, path, p_name, false FROM f JOIN part ON file_key = p_partkey WHERE p_size < 10 AND cover <> '' AND p_name NOT LIKE 'red%') WHERE file_key NOT IN (SELECT file_key FROM t) GROUP BY ALL),
n AS (SELECT *, (row_number() OVER (PARTITION BY output_key ORDER BY regexp_extract(path, '^.*/'), path) - 1) % 200 + 1 AS i FROM p)
SELECT output_key, file_key, 'title' AS source FROM t WHERE wanted UNION ALL SELECT output_key, file_key, 'answer' FROM n WHERE c OR i % 2 = 0""")
def matched_by_questions(spark, d):
    """Direct matches by title, and what a stand-in for a model selects among the candidates of each output."""
    key = "replace(p_name, ' ', '')"
    part = table(spark, d, "part")
    files = part.selectExpr("p_partkey AS file_key", "p_brand || '/' || lpad(CAST(p_partkey AS STRING), 8, '0') AS path", f"CASE p_partkey % 3 WHEN 0 THEN {key} ELSE '' END AS title", f"CASE p_partkey % 3 WHEN 1 THEN {key} || 'x' ELSE 'y' END AS stem", f"CASE p_partkey % 6 WHEN 5 THEN '' WHEN 2 THEN 'about ' || {key} ELSE 'cover' END AS cover")
    outputs = part.selectExpr("p_name AS output_key", "p_name AS output_name", "p_name NOT LIKE 'red%' AS wanted").distinct()
    hits = part.where("p_size < 10").selectExpr("p_partkey AS file_key", "p_name AS output_key")
    return matches_by_questions(files, outputs, hits, local_answer, "project").select("output_key", "file_key", "source")


QUERIES, ORACLE_SQL = book.queries, book.sql
