"""Folder templates of the stages that a text names: markers found in a single pass, templates from a table of rows.

The text without white space is scanned once by one pattern that stands at every place for all markers (the longest there);
markers inside a found one are known beforehand. The found markers fetch their rows by a join, so tables of templates can grow.
Null and empty texts name no stage; repeated texts give repeated rows; empty markers are left out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: More markers than this would make a pattern of their own size; they raise an error.
MOST_MARKERS = 2000

# Marker, then name and folders of each template, in order.
KNOWN_STAGES = {
    "05.시험": [
        ("통합시험결과서", "05.시험", "01.시험 & 전환", "01.통합시험"),
        ("성능시험결과서", "05.시험", "01.시험 & 전환", "02.시스템시험"),
        ("모의해킹수행결과서", "05.시험", "01.시험 & 전환", "02.시스템시험"),
        ("데이터전환결과서", "05.시험", "01.시험 & 전환", "03.데이터전환"),
        ("소스코드점검보고서", "05.시험", "02.시험단계점검", "01.취약점점검"),
        ("웹취약점진단결과서", "05.시험", "02.시험단계점검", "01.취약점점검"),
        ("데이터값진단계획서", "05.시험", "02.시험단계점검", "02.데이터값진단"),
        ("데이터값진단결과서", "05.시험", "02.시험단계점검", "02.데이터값진단"),
    ],
    "02.분석": [
        ("인터뷰계획서", "02.분석", "01.요구사항분석", "01.인터뷰계획서"),
        ("인터뷰결과서", "02.분석", "01.요구사항분석", "02.인터뷰결과서"),
        ("업무정의서", "02.분석", "02.현행시스템분석", "01.업무정의서"),
        ("현행아키텍처분석서", "02.분석", "02.현행시스템분석", "02.아키텍처분석"),
        ("총괄시험계획서", "02.분석", "03.분석단계시험계획", "01.총괄시험계획"),
        ("성능시험계획서", "02.분석", "03.분석단계시험계획", "02.성능(부하)시험계획"),
    ],
    "06.인도": [
        ("인수인계시험결과서", "06.인도", "01.인수인계", "01.인수인계"),
        ("운영자매뉴얼", "06.인도", "01.인수인계", "02.매뉴얼작성"),
        ("사용자매뉴얼", "06.인도", "01.인수인계", "02.매뉴얼작성"),
        ("교육계획서", "06.인도", "02.교육", "01.교육준비"),
        ("교육결과서", "06.인도", "02.교육", "02.교육수행"),
    ],
    "프로젝트종료": [
        ("완료보고서", "01.프로젝트 시작", "03.프로젝트 종료"),
        ("사업완료보고서", "01.프로젝트 시작", "03.프로젝트 종료"),
        ("프로젝트완료보고서", "01.프로젝트 시작", "03.프로젝트 종료"),
    ],
    "05.설계단계시험계획": [
        ("단위시험케이스", "03.설계", "05.설계단계시험계획", "01.단위시험케이스"),
        ("통합시험시나리오", "03.설계", "05.설계단계시험계획", "02.통합시험시나리오"),
        ("인수인계시험시나리오", "03.설계", "05.설계단계시험계획", "03.인수인계시험시나리오"),
    ],
    "03.설계": [
        ("사용자인터페이스설계", "03.설계", "02.어플리케이션설계", "01.사용자인터페이스설계"),
        ("사용자인터페이스설계서", "03.설계", "02.어플리케이션설계", "01.사용자인터페이스설계"),
    ],
    "04.구현": [
        ("프로그램목록", "04.구현", "01.어플리케이션개발", "01.프로그램개발", "01.프로그램목록"),
        ("SQL튜닝요청서", "04.구현", "03.SQL개발"),
        ("SQL튜닝결과서", "04.구현", "03.SQL개발"),
        ("단위시험결과서", "04.구현", "02.단위시험", "01.단위시험"),
    ],
}


def known_stages(spark: SparkSession) -> DataFrame:
    """marker, template_pos, output_name, template_path."""
    rows = [(marker, name, list(path)) for marker, own in KNOWN_STAGES.items() for name, *path in own]
    return spark.createDataFrame([(m, i, n, p) for i, (m, n, p) in enumerate(rows)], "marker string, template_pos int, output_name string, template_path array<string>")


def markers_in(text: Column, markers: list[str]) -> Column:
    """The markers that a text holds, without repeats; markers have no white space."""
    wanted = sorted({m for m in markers if m}, key=lambda m: (-len(m), m))
    if not wanted:
        return F.array().cast("array<string>")
    pattern = "(?=(" + "|".join(rf"\Q{m}\E" for m in wanted) + "))"
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1)))
    inside = {m: [x for x in wanted if m.startswith(x)] for m in wanted}  # others inside are found at their own places
    table = F.create_map(*[c for m, own in inside.items() for c in (F.lit(m), F.array(*map(F.lit, own)))])
    return F.array_distinct(F.flatten(F.transform(found, lambda m: F.element_at(table, m))))


def stage_templates(texts: DataFrame, keys: list[str], text: str, templates: DataFrame) -> DataFrame:
    """keys, template_pos, output_name, template_path of each text's stages. templates: marker (without white space), template_pos, output_name, template_path."""
    markers = [r.marker for r in templates.select("marker").where("marker <> ''").distinct().limit(MOST_MARKERS + 1).collect()]
    if len(markers) > MOST_MARKERS:
        raise ValueError(f"more than {MOST_MARKERS} markers")
    if any(re.search(r"\s", m) for m in markers):
        raise ValueError("a marker with white space can't be found in a text without it")
    compact = F.regexp_replace(F.col(text), r"(?U)\s+", "")
    return texts.select(*keys, F.explode(markers_in(compact, markers)).alias("marker")).join(templates, "marker").select(*keys, "template_pos", "output_name", "template_path")
