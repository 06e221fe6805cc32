"""Queries of cover identity, catalog lines, folder tables and screens, over texts made from parts.

Each text is laid out so that its parts are known; the SQL says which they are.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.completion import selected_names, selected_numbers
from ..functions.titles import safe_relative_path, slide_name
from ..operators import catalog_text as C
from ..operators import screens as S
from ..operators.extract import text_lines
from ..operators.identity import cover_identities, meaningful_lines, standard_project_title
from ..operators.requirements import proposal_requirements
from .common import Book, spread, table

book = Book()
NL = " || chr(10) || "
COVER = f"""CASE p_partkey % 6
WHEN 0 THEN p_name || ' system'{NL}p_type || ' 결과서'{NL}'문서번호 MFDS-PMC-01'{NL}'작성자 A'
WHEN 1 THEN '사업명: ' || p_name{NL}'문서명 : ' || p_type || ' plan'{NL}'x'
WHEN 2 THEN '프로젝트 명'{NL}p_name{NL}'문서 제목'{NL}p_type
WHEN 3 THEN '<' || p_name || ' 운영자 매뉴얼> <문서번호 A-01>'
WHEN 4 THEN '2024.01.01'{NL}'(주)' || p_brand{NL}p_name || ' 보고서 안내'
ELSE '&lt;목 차&gt;'{NL}'---' END"""


def parts(spark, d, text):
    return spread(table(spark, d, "part")).select("p_partkey", "p_name", F.expr(text).alias("_t"))


@book.query(
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_name || ' system' WHEN 5 THEN '' ELSE p_name END AS project,
CASE p_partkey % 6 WHEN 0 THEN p_type || ' 결과서' WHEN 1 THEN p_type || ' plan' WHEN 2 THEN p_type WHEN 3 THEN '운영자 매뉴얼' WHEN 4 THEN '보고서 안내' ELSE '' END AS document FROM part"""
)
def cover_titles_found(spark, d):
    """Project and document title of covers of six layouts."""
    return cover_identities(parts(spark, d, COVER), ["p_partkey"], "_t")


@book.query(
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_name || ' system|' || p_type || ' 결과서|문서번호 MFDS-PMC-01|작성자 A' WHEN 1 THEN '사업명: ' || p_name || '|문서명 : ' || p_type || ' plan|x'
WHEN 2 THEN '프로젝트 명|' || p_name || '|문서 제목|' || p_type WHEN 3 THEN p_name || ' 운영자 매뉴얼 문서번호 A-01' WHEN 4 THEN '(주)' || p_brand || '|' || p_name || ' 보고서 안내' ELSE '목 차' END AS lines FROM part"""
)
def meaningful_line_list(spark, d):
    """Cleaned lines without noise, numbers and dates."""
    return meaningful_lines(parts(spark, d, COVER), "_t").select("p_partkey", F.array_join("lines", "|").alias("lines"))


LINE = """CASE p_partkey % 5 WHEN 0 THEN p_name || '   PMC-AB-01-' || p_type || '   01.' || p_brand WHEN 1 THEN p_name || '   PMC-AB-02   ' || p_brand || ' folder'
WHEN 2 THEN 'PMC-AB-03  ' || p_name WHEN 3 THEN '산출물명  PMC-AB-04' ELSE p_name END"""


@book.query(
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'PMC-AB-01' WHEN 1 THEN 'PMC-AB-02' ELSE 'PMC-AB-03' END AS output_id, CASE p_partkey % 5 WHEN 0 THEN p_type ELSE p_name END AS output_name,
CASE p_partkey % 5 WHEN 0 THEN '01.' || p_brand WHEN 1 THEN p_brand || ' folder' ELSE p_name END AS folder_name FROM part WHERE p_partkey % 5 < 3"""
)
def catalog_line_outputs(spark, d):
    """Ids, names and folders of table lines; headers and other lines give none."""
    return parts(spark, d, LINE).select("p_partkey", C.line_output(F.col("_t")).alias("o")).where("o is not null").select("p_partkey", "o.*")


LOOSE = "CASE p_partkey % 4 WHEN 0 THEN p_partkey || 'A  ' || p_name || ' 대장' WHEN 1 THEN p_name || ' 대장  B' || p_partkey WHEN 2 THEN '7 ' || p_name || ' 대장' ELSE 'A1' END"


@book.query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_partkey || 'A' ELSE 'B' || p_partkey END AS output_id, p_name || ' 대장' AS output_name FROM part WHERE p_partkey % 4 < 2")
def loose_line_outputs(spark, d):
    """Any id with a digit and the name beside it."""
    return parts(spark, d, LOOSE).select("p_partkey", C.loose_line_output(F.col("_t")).alias("o")).where("o is not null").select("p_partkey", "o.*")


SEQUENCE = f"p_type || ' 정의서'{NL}'PMC-AB-01-요구'{NL}p_type || ' 계획서'{NL}'(통합 ' || p_type || ')'{NL}'PMC-AB-02'{NL}'분석'{NL}'PMC-AB-03'{NL}'WBS'{NL}'PM-' || p_partkey"


@book.query("SELECT p_partkey, unnest(['PMC-AB-01', 'PMC-AB-02', 'PM-' || p_partkey]) AS output_id, unnest([p_type || ' 정의서', p_type || ' 계획서(통합 ' || p_type || ')', 'WBS']) AS output_name FROM part")
def sequential_line_outputs(spark, d):
    """Names and ids on lines below each other, some names wrapped; stages are no names."""
    return C.sequential_outputs(text_lines(parts(spark, d, SEQUENCE), ["p_partkey"], "_t"), ["p_partkey"]).drop("pos")


LAYOUT = f"""'구분  폴더명/문서명'{NL}'02.분석' || repeat(' ', 5) || '01.' || rpad(p_brand, 20, ' ') || '  01.세부' || repeat(' ', 20) || '01.' || p_name{NL}repeat(' ', 50) || p_type{NL}repeat(' ', 10) || '02.설계' || repeat(' ', 40) || 'WBS'"""


@book.query(
    """SELECT p_partkey, unnest([p_name, p_type, 'WBS']) AS output_name, unnest(['02.분석/01.' || p_brand || '/01.세부', '02.분석/01.' || p_brand || '/01.세부', '02.분석/02.설계/01.세부']) AS path FROM part"""
)
def folder_table_templates(spark, d):
    """Folder paths by indent, with the folders that are open."""
    lines = parts(spark, d, LAYOUT).select("p_partkey", F.posexplode(F.split("_t", "\n")).alias("pos", "line"))
    return C.layout_templates(lines, ["p_partkey"]).select("p_partkey", "output_name", F.array_join("template_path", "/").alias("path"))


SCREEN = f"""'4.1. ' || p_name || ' 12'{NL}'요구사항ID'{NL}'UI-AB-' || p_partkey{NL}'처리 흐름'{NL}'① ' || p_type || ' 조회 ② ' || p_brand || ' 연다'{NL}'이벤트 정의'{NL}'1 ' || p_name || ' 버튼 클릭   저장한다'{NL}'2. 기타'{NL}'4.2. 화면ID'{NL}'y'{NL}'UI-AB-' || p_partkey || ' z UI-CD-1 ' || p_brand"""


@book.query("SELECT p_partkey, p_type || ' 조회|' || p_brand || ' 연다' AS flow, p_name || ' 버튼 클릭=저장한다|기타=' AS events FROM part")
def screen_steps(spark, d):
    """Steps of the flow and rows of the event table."""
    flow = F.array_join(F.transform(S.flow_steps(F.col("_t")), lambda s: s["text"]), "|")
    events = F.array_join(F.transform(S.event_steps(F.col("_t")), lambda s: F.concat(s["event"], F.lit("="), s["description"])), "|")
    return parts(spark, d, SCREEN).select("p_partkey", flow.alias("flow"), events.alias("events"))


@book.query(
    f"""SELECT p_partkey, unnest(['UI-AB-' || p_partkey, 'UI-CD-1']) AS screen_id, unnest(['UT-AB-' || p_partkey, 'UT-CD-1']) AS unit_test_id, unnest([p_name, '']) AS title, unnest([split_part({SCREEN}, chr(10) || '4.2.', 1), 'UI-CD-1 ' || p_brand]) AS text FROM part"""
)
def screen_blocks_found(spark, d):
    """Of each screen's blocks the one that holds most."""
    return S.screen_blocks(parts(spark, d, SCREEN), "p_partkey", "_t").drop("place")


ACTION = "CASE p_partkey % 5 WHEN 0 THEN p_name || ' 저장된다' WHEN 1 THEN p_name || ' 조회된다' WHEN 2 THEN p_name || ' 조회 조건' WHEN 3 THEN '[' || p_brand || '] ' || p_name || ' 버튼(x) 클릭' ELSE p_name END"


@book.query(
    """SELECT p_partkey, p_partkey % 5 IN (0, 2, 3) AS is_action, CASE p_partkey % 5 WHEN 0 THEN 'save' WHEN 1 THEN 'search' WHEN 2 THEN 'search' WHEN 3 THEN 'select' ELSE '' END AS kinds,
replace(p_name, ' ', '') || CASE p_partkey % 5 WHEN 0 THEN '저장된다' WHEN 1 THEN '조회된다' WHEN 2 THEN '조건' ELSE '' END AS key FROM part"""
)
def user_actions(spark, d):
    """Whether a step is a user's, its kinds and what it is about."""
    t = F.col("_t")
    return parts(spark, d, ACTION).select("p_partkey", S.is_user_action(t).alias("is_action"), F.array_join(S.action_types(t), ",").alias("kinds"), S.action_key(t).alias("key"))


PROPOSAL = f"""'SFR-ZZ-1 before'{NL}'기능 요구 사항'{NL}'SFR-AB-' || p_partkey || ' ' || p_name{NL}'s f r_ab - ' || (p_partkey + 1) || ' and SFR-AB-' || p_partkey{NL}'SFR-' || p_partkey || ' SFR-A1-' || (p_partkey + 5)"""


@book.query(
    rf"""WITH t AS (SELECT p_partkey, {PROPOSAL} AS t FROM part), s AS (SELECT p_partkey, substr(t, strpos(t, '기능')) AS t FROM t),
u AS (SELECT p_partkey, t, unnest([{{'m': 'SFR-AB-' || p_partkey, 'k': 0}}, {{'m': 's f r_ab - ' || (p_partkey + 1), 'k': 1}}, {{'m': 'SFR-' || p_partkey, 'k': 2}}, {{'m': 'SFR-A1-' || (p_partkey + 5), 'k': 3}}]) AS x FROM s),
p AS (SELECT *, CASE x.k WHEN 2 THEN strpos(t, chr(10) || x.m) ELSE strpos(t, x.m) - 1 END AS pos FROM u)
SELECT p_partkey, CAST(pos AS INTEGER) AS pos, 'SFR-' || upper(regexp_replace(regexp_replace(x.m, '^(SFR-|s f r_)', ''), '\s*-\s*', '-', 'g')) AS requirement_id, x.m AS matched_text, trim(regexp_replace(substr(t, greatest(pos - 80, 0) + 1, pos + length(x.m) + 80 - greatest(pos - 80, 0)), '\s+', ' ', 'g')) AS context,
 x.k <> 2 AS kept, CASE WHEN x.k = 2 THEN 'SFR-AB-' || p_partkey END AS conflict_with, CASE WHEN x.k = 2 THEN 'number' END AS reason FROM p"""
)
def requirement_ids_in_context(spark, d):
    """Ids of the list section with their places and contexts; one whose shape contradicts the others and whose number is taken goes."""
    return proposal_requirements(parts(spark, d, PROPOSAL), ["p_partkey"], "_t")


STANDARD = f"""CASE p_partkey % 4 WHEN 0 THEN 'x'{NL}p_name || ' 문서관리표준 V1.0' WHEN 1 THEN p_type{NL}'문서관리표준' WHEN 2 THEN '문서관리표준 ' || p_brand ELSE 'x'{NL}'사업명 ' || p_name END"""


@book.query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_type WHEN 2 THEN p_brand ELSE p_name END AS project FROM part")
def standard_projects(spark, d):
    """Projects of standards by the marker of their cover."""
    return meaningful_lines(parts(spark, d, STANDARD), "_t").select("p_partkey", standard_project_title(F.col("lines")).alias("project"))


NAME = "CASE p_partkey % 2 WHEN 0 THEN 'PMC-AB-01 ' || p_name || ' (2024.01.02)_v1.0 20240102' ELSE '2024001(a) - ' || p_name || '-V2' END"


@book.query("SELECT p_partkey, p_name AS slide, CASE p_partkey % 2 WHEN 0 THEN 'a/' || p_name || '/x_' || p_brand || '_.doc' ELSE 'file' END AS path FROM part")
def slide_names_and_paths(spark, d):
    """File names without ids, dates and versions; upload paths made safe."""
    path = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("/a\\ "), "p_name", F.lit(" /../x<"), "p_brand", F.lit(">.doc"))).otherwise("./..//")
    named = table(spark, d, "part").select("p_partkey", F.expr(NAME).alias("_n"), path.alias("_p"))
    return named.select("p_partkey", slide_name(F.col("_n")).alias("slide"), safe_relative_path(F.col("_p")).alias("path"))


ANSWER = """CASE p_partkey % 3 WHEN 0 THEN '{"selected" : [' || p_size || ', 99, ' || p_size || ', 0' WHEN 1 THEN 'so "selected": ["' || p_name || '", "x"]' ELSE 'none' END"""


@book.query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '0,' || p_size || ',99' ELSE '' END AS numbers, CASE p_partkey % 3 WHEN 1 THEN p_name || ',x' ELSE '' END AS names FROM part")
def answers_selected(spark, d):
    """Numbers and names that answers select, broken ones too."""
    t = F.col("_t")
    return parts(spark, d, ANSWER).select("p_partkey", F.array_join(selected_numbers(t).cast("array<string>"), ",").alias("numbers"), F.array_join(selected_names(t), ",").alias("names"))


QUERIES, ORACLE_SQL = book.queries, book.sql
