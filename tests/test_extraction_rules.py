"""Cover identity, catalog lines, folder tables and screens on texts with known results."""

from pyspark.sql import functions as F

from ledgerloom.operators import catalog_text as C
from ledgerloom.operators import screens as S
from ledgerloom.operators.requirements import proposal_requirements
from ledgerloom.operators.identity import cover_identities, is_cover_value, meaningful_lines


def each(spark, texts, expression, column="t"):
    """expression over each text, in order."""
    df = spark.createDataFrame(list(enumerate(texts)), f"i int, {column} string")
    return [r[0] for r in df.select("i", expression.alias("r")).orderBy("i").select("r").collect()]


def test_meaningful_lines(spark):
    long = "긴 줄 " * 60
    texts = ["A &amp; B\n\n2024.01.02\n<제목> <Ｎ1>\n漢字\n<목 차>\n---\n<>\n⦁ x ", long, None, ""]
    rows = meaningful_lines(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t").orderBy("i").collect()
    assert [list(r.lines) for r in rows] == [["A & B", "제목 N1", "목 차", "x"], [long.strip()], [], []]


def test_cover_values(spark):
    texts = ["제목", "MFDS-PMC-06", "작성자 홍", "(주)회사", "x" * 121, "漢字", ""]
    assert each(spark, texts, is_cover_value(F.col("t"))) == [True] + [False] * 6


def test_cover_identity(spark):
    cases = {
        "새 시스템 구축\n단위시험 결과서\n문서번호 MFDS-PMC-01\n작성자 홍": ("새 시스템 구축", "단위시험 결과서"),
        "사업명: 새 사업\n문서 제목 : 시험 계획서\nx": ("새 사업", "시험 계획서"),
        "프로젝트 명\n새 사업\n문서명\n계획": ("새 사업", "계획"),
        "<통합 시스템 운영자 매뉴얼> <문서번호 A-01>": ("통합 시스템", "운영자 매뉴얼"),
        "&lt;목 차&gt;\n---": ("", ""),
        "2024.01.01\n(주)회사\n민원 보고서 안내": ("민원", "보고서 안내"),
        None: ("", ""),
        "": ("", ""),
    }
    rows = cover_identities(spark.createDataFrame(list(enumerate(cases)), "i int, t string"), ["i"], "t").orderBy("i").collect()
    assert [(r.project, r.document) for r in rows] == list(cases.values())


def test_catalog_lines(spark):
    lines = ["요구사항정의서   MFDS-PMC-01-정의서   01.폴더", "시험결과서   MFDS-PMC-02   결과 폴더", "MFDS-PMC-03  교육 계획서", "산출물명  산출물ID", "2024.01.01 MFDS-PMC-03 x", "no id here", None]
    found = each(spark, lines, C.line_output(F.col("t")))
    assert [r and tuple(r) for r in found] == [("MFDS-PMC-01", "정의서", "01.폴더"), ("MFDS-PMC-02", "시험결과서", "결과 폴더"), ("MFDS-PMC-03", "교육 계획서", "교육 계획서"), None, None, None, None]
    loose = each(spark, ["12  A-1x  시험 대장", "시험 대장  B22", "7 이름", "A1"], C.loose_line_output(F.col("t")))
    assert [r and tuple(r) for r in loose] == [("A-1x", "시험 대장"), ("B22", "시험 대장"), None, None]


def line_table(spark, text):
    return spark.createDataFrame([(1, i, x) for i, x in enumerate(text.split("\n"))], "d int, pos int, line string")


def test_sequential_outputs(spark):
    text = "요구사항정의서\nMFDS-AN-01-요구정의\n시험계획서\n(통합 시험)\nMFDS-AN-02\n분석\nMFDS-AN-03\nWBS\nPM-01"
    rows = C.sequential_outputs(line_table(spark, text), ["d"]).orderBy("pos").collect()
    assert [(r.output_id, r.output_name) for r in rows] == [("MFDS-AN-01", "요구사항정의서"), ("MFDS-AN-02", "시험계획서(통합 시험)"), ("PM-01", "WBS")]
    named = C.sequential_outputs(line_table(spark, text), ["d"], name_from_id=True).orderBy("pos").first()
    assert named.output_name == "요구정의"


def test_columns_of_a_header_line(spark):
    text = "구분        산출물명            산출물ID\n분석        요구사항 정의서      A-101\n            시험 대장           B-7 x\n설계        없음"
    rows = C.column_outputs(line_table(spark, text), ["d"]).orderBy("pos").collect()
    assert [(r.output_id, r.output_name) for r in rows] == [("A-101", "요구사항 정의서"), ("B-7 x", "시험 대장")]


def test_layout_templates(spark):
    text = "\n".join(["01.앞   x", "구분  폴더명/문서명", "02.분석" + " " * 5 + "01.요구" + " " * 20 + "01.세부" + " " * 10 + "01.정의서", " " * 47 + "대장", " " * 12 + "02.설계" + " " * 30 + "xy" + " " * 2 + "02.결과서", "V1.0 page"])
    rows = C.layout_templates(line_table(spark, text), ["d"]).orderBy("pos").collect()
    assert [(r.output_name, list(r.template_path)) for r in rows] == [("정의서", ["02.분석", "01.요구", "01.세부"]), ("대장", ["02.분석", "01.요구", "01.세부"]), ("xy", ["02.분석", "02.설계", "01.세부"]), ("결과서", ["02.분석", "02.설계", "01.세부"])]
    outputs = spark.createDataFrame([(1, "결과서", ["정의서"]), (2, "대장", None), (3, "정의서", None)], "output_key int, output_name string, aliases array<string>")
    chosen = C.outputs_with_templates(outputs, C.layout_templates(line_table(spark, text), ["d"])).orderBy("pos").collect()
    assert [r.output_name for r in chosen] == ["결과서", "대장"]


def test_steps_and_events(spark):
    flow = "처리 흐름\n① 화면을 연다 ② 저장 버튼을\n 클릭한다\n이벤트 정의\n순번 이벤트명 처리설명\n1 저장 버튼 클릭   저장한다\n2. 목록 행 선택 상세를 보인다\n3 기타\n보안기능 없음"
    assert [[tuple(s) for s in x] for x in each(spark, [flow, "처리흐름\n1. 연다\n2) 조회한다\n4.2 끝", "x", None], S.flow_steps(F.col("t")))] == [[(1, "화면을 연다"), (2, "저장 버튼을 클릭한다")], [(1, "연다"), (2, "조회한다")], [], []]
    events = each(spark, [flow, None], S.event_steps(F.col("t")))
    assert [tuple(e)[:3] for e in events[0]] == [(1, "저장 버튼 클릭", "저장한다"), (2, "목록 행 선택", "상세를 보인다"), (3, "기타", "")] and events[1] == []
    assert each(spark, ["저장한다", "조회된다", "조회 조건", "본다", None], S.is_user_action(F.col("t"))) == [True, False, True, False, False]
    assert each(spark, ["행 선택 후 저장", "본다"], S.action_types(F.col("t"))) == [["save", "select"], []]
    assert each(spark, ["[확인] 신청서 버튼(파랑) 클릭"], S.action_key(F.col("t"))) == ["신청서"]
    found = each(spark, [flow + "\n처리흐름"], S.action_candidates(F.col("t")))[0]
    assert [(c.source, c.step) for c in found] == [("event", 1), ("event", 2), ("event", 3), ("flow", 2)]  # the key of the event is another


def test_screen_blocks(spark):
    text = "4.1. 목록 12\n화면ID UI-AB-01\n4. 화면/보고서 정의\n4.1. 목록 화면 12\n요구사항ID\n화면ID UI-AB-01\n처리흐름\n① 연다\n4.2. 화면ID\nx\nUI-AB-02 a UI-AB-02 b UI-AB-03 c\n4.3. 없음\ny"
    rows = S.screen_blocks(spark.createDataFrame([(1, text), (2, "UI-A-1 x UI-A-1 y UI-B-2 z UI-A-1 x"), (3, None), (4, "none")], "d int, t string"), "d", "t").orderBy("d", "place").collect()
    assert [(r.d, r.screen_id, r.title) for r in rows] == [(1, "UI-AB-01", "목록 화면"), (1, "UI-AB-02", ""), (1, "UI-AB-03", ""), (2, "UI-A-1", ""), (2, "UI-B-2", "")]
    assert rows[0].text.startswith("4.1. 목록 화면") and rows[0].unit_test_id == "UT-AB-01"
    assert rows[1].text.endswith("UI-AB-02 a UI-AB-02 b") and rows[2].text == "UI-AB-03 c"
    assert rows[3].text == "UI-A-1 x UI-A-1 y\n\nUI-A-1 y\n\nUI-A-1 x"


def test_requirements_of_proposals(spark):
    texts = ["x SFR-ZZ-9 요구사항 목록표 SFR–AB–01 가 SFR-AB-2\nS F R - ab _ 3 SFR-1 SFR-AB SFR-AB-2-7 SFR-QQ", "SFR-1 요구사항 정의 none", "요구사항 목록 SFR-1 SFR-A-2", None, "XSFR-1 SFR-1A"]
    rows = proposal_requirements(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), ["i"], "t").orderBy("i", "pos").collect()
    assert [(r.i, r.requirement_id, r.kept, r.conflict_with, r.reason) for r in rows] == [
        (0, "SFR-AB-01", True, None, None),
        (0, "SFR-AB-2", True, None, None),
        (0, "SFR-AB-3", True, None, None),
        (0, "SFR-1", False, "SFR-AB-01", "number"),
        (0, "SFR-AB-2-7", False, "SFR-AB-2", "prefix"),
        (1, "SFR-1", True, None, None),
        (2, "SFR-1", True, None, None),
        (2, "SFR-A-2", True, None, None),
    ]
    assert rows[2].matched_text == "S F R - ab _ 3" and rows[5].context.startswith("SFR-1 요구사항")
