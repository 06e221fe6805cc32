"""Metadata of sheets, lines and headers, and folder policies, on small hand-made rows."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import policies as P
from ledgerloom.operators import sheet_metadata as S

CELL = "path string, sheet_pos int, sheet string, row int, col int, text string"


def sheet(spark, rows):
    return spark.createDataFrame(rows, CELL)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_inspected_sheets(spark):
    cells = sheet(
        spark,
        [
            ("a", 0, "표지", 2, 1, "작성 자"), ("a", 0, "표지", 2, 2, "승인자"),  # a label is no value
            ("a", 0, "표지", 3, 1, "작 성 자"), ("a", 0, "표지", 3, 2, " Kim "), ("a", 0, "표지", 3, 3, None),
            ("a", 1, "x", 1, 1, "개정일자"), ("a", 1, "x", 1, 3, "2024-01-01"),  # not beside it
            ("a", 1, "x", 2, 1, "개정일자"), ("a", 1, "x", 2, 2, "2024-02-02"), ("a", 1, "x", 2, 2, "2024-02-02"),
            ("a", 2, "개정이력1", 1, 1, "1.0"),
            ("a", 2, "개정이력1", 2, 1, "버전"), ("a", 2, "개정이력1", 2, 2, "변경일"), ("a", 2, "개정이력1", 2, 4, "작성자"),
            ("a", 2, "개정이력1", 3, 1, "합계"), ("a", 2, "개정이력1", 4, 1, "v1.0"), ("a", 2, "개정이력1", 4, 2, "2023.1.1"), ("a", 2, "개정이력1", 4, 4, "Lee"),
            ("a", 3, "개정이력2", 1, 1, "버전"), ("a", 3, "개정이력2", 1, 2, "변경일"), ("a", 3, "개정이력2", 1, 3, "작성자"),
            ("b", 0, "s", 1, 1, "nothing"), ("c", 0, "s", 1, 1, " "),
        ],
    )
    found = {r[0]: tuple(r)[1:] for r in S.inspected_sheets(cells, "path").collect()}
    assert found == {"a": ("2024-02-02", "Kim", "2023.1.1", "Lee"), "b": (None, None, None, None)}
    assert S.inspected_sheets(cells.where("false"), "path").count() == 0
    assert S.inspected_sheets(cells.withColumns({c: F.lit("clash") for c in ("_head", "_found", "_r", "author")}), "path").count() == 2


def test_sheet_authors(spark):
    cells = sheet(
        spark,
        [
            ("cover", 0, "s", 1, 1, "작성자"), ("cover", 0, "s", 2, 1, "below"), ("cover", 1, "앞표지", 5, 1, "작성자"), ("cover", 1, "앞표지", 5, 4, "right"),
            ("below", 0, "s", 1, 1, "작성자"), ("below", 0, "s", 7, 1, "six down"),
            ("far", 0, "s", 1, 1, "작성자"), ("far", 0, "s", 8, 1, "seven down"), ("far", 0, "s", 1, 2, "beside, no cover"),
            ("alone", 0, "표지", 1, 1, "작성자"),
        ],
    )
    assert {r.path: r.author for r in S.sheet_authors(cells, "path").collect()} == {"cover": "right", "below": "six down"}


@pytest.mark.parametrize(
    ("text", "author"),
    [
        (None, None), ("", None), ("작성자", None), ("a\n작 성 자\n\n승인자\r\n Kim \nLee", "Kim"), ("작성자\n승인자\n작성자\n승인자\n작성자\nKim", "Kim"),
        ("\n".join(["x"] * 80 + ["작성자", "late"]), None), ("\n".join(["x"] * 79 + ["작성자", "in time"]), "in time"), ("작성자: Kim\nLee", None),
    ],
)
def test_author_below_label(spark, text, author):
    assert value(spark, S.author_below_label(F.lit(text).cast("string"))) == author


def test_authors_of_texts(spark):
    late = F.lit("x" * 3000 + "작성자 Kim")
    assert value(spark, S.standard_author(F.lit("표준 작성 자  Kim|Lee"))) == "Kim"
    assert value(spark, S.standard_author(late)) is None and value(spark, S.standard_author(late, None)) == "Kim"
    assert tuple(value(spark, S.bracketed_metadata(F.lit("< 작 성 자 > < Kim ><개정일자><2024-01-01>")))) == ("Kim", "2024-01-01")
    assert tuple(value(spark, S.bracketed_metadata(F.lit(None).cast("string")))) == (None, None)


@pytest.mark.parametrize(
    ("values", "at"),
    [
        (["A-1", "v1.0", "2024-01-01", "Kim"], 0), (["문서번호", "A-1", "1.0", "2024 1 1", "Kim"], 1), (["", "", "", ""], None), (["", "", "", "Kim"], 0),
        (["A-1", "x", "2024-01-01", "Kim"], None), (["A-1", "1.0", "2024-01-01"], None), (["2024-01-01", "1.0", "2024-01-01", "Kim"], None),
        ([None, " 1.0 ", None, None], 0), (["A", "1.0", "2024-01-01", "2.0"], None), ([], None),
    ],
)
def test_unlabelled_header(spark, values, at):
    assert value(spark, S.unlabelled_header_at(F.array(*[F.lit(v).cast("string") for v in values]) if values else F.array().cast("array<string>"))) == at


@pytest.mark.parametrize(
    ("path", "scanned"),
    [
        ("a/b/c.hwp", True), ("a/BAK/c.hwp", False), ("a/구버전/c.hwp", False), ("a/(자체 테스트)/c.hwp", False), ("a/(2024) c.hwp", False), ("a/c_v0.9.hwp", False), ("a/c_v0.91.hwp", True),
        ("05.시험/02.시험단계점검/02.데이터값진단/c.hwp", False), ("05.시험/x/02.시험단계점검/c.hwp", True),
        ("06.인도/01.인수인계/02.매뉴얼작성/c.hwp", False), ("06.인도/01.인수인계/02.매뉴얼작성/운영자 매뉴얼/c.hwp", True), ("c.hwp", True), ("a/c 회신용.hwp", False),
    ],
)
def test_should_scan(spark, path, scanned):
    *parts, name = path.split("/")
    parts = F.array(*map(F.lit, parts)) if parts else F.array().cast("array<string>")
    assert value(spark, P.should_scan(parts, F.lit(name))) is scanned
    assert value(spark, P.should_scan(parts, F.lit(name), only_under=(("zz",),))) is False


def test_templates_and_reading(spark):
    files = spark.createDataFrame([(1, ["01. 계획", "원본", "02_WBS"]), (2, ["계획"]), (3, ["other"]), (4, [])], "id int, parts array<string>")
    templates = spark.createDataFrame([("t1", ["1.계획"]), ("t2", ["계획", "WBS"]), ("t3", ["계획", "3)WBS"]), ("t4", [])], "name string, template array<string>")
    first = {r.id: r.name for r in P.templates_of_paths(files, ["id"], "parts", templates, "template", "name").collect()}
    assert first == {1: "t2", 2: "t1"}
    every = sorted((r.id, r.name) for r in P.templates_of_paths(files, ["id"], "parts", templates, "template", "name", all_longest=True).collect())
    assert every == [(1, "t2"), (1, "t3"), (2, "t1")]
    assert {r.id: r.read for r in P.files_to_read(files, ["id"], "parts", templates, "template").collect()} == {1: True, 2: True, 3: False, 4: False}
    assert all(r.read for r in P.files_to_read(files.where("id > 2"), ["id"], "parts", templates, "template").collect())
    assert P.files_to_read(files.where("false"), ["id"], "parts", templates, "template").count() == 0


@pytest.mark.parametrize(("alias", "name", "generic"), [("abcd", "abcde", True), ("abcde", "abcdef", False), ("시험결과서", "단위시험결과서", True), ("abcdef", "", True), ("abcdef", None, True)])
def test_generic_alias(spark, alias, name, generic):
    assert value(spark, P.is_generic_alias(F.lit(alias), F.lit(name).cast("string"))) is generic


def test_a_run_meets_one_template_however_many_share_it(spark):
    """Templates that differ in their numbers only are one run; before, every file met each of them."""
    files = spark.range(300).select("id", F.array(F.concat("id", F.lit(". a")), F.lit("b"), F.lit("c")).alias("parts"))
    templates = spark.range(300).select(F.array(F.concat("id", F.lit("-A")), F.lit("b")).alias("template"), F.lpad(F.col("id").cast("string"), 3, "0").alias("name"))
    found = P.templates_of_paths(files, ["id"], "parts", templates, "template", "name")
    assert "min_by" in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.id, r.name) for r in found.collect()} == {(i, "000") for i in range(300)}
    assert P.templates_of_paths(files, ["id"], "parts", templates, "template", "name", all_longest=True).count() == 300 * 300
