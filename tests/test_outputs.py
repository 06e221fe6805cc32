"""Test cases of answers, tails, stages, sections, leftovers and questions beyond what the registered queries show."""

import json
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.catalog_text import section_outputs
from ledgerloom.operators.leftovers import leftover_updates
from ledgerloom.operators.questions import accepted_pairs, answered, candidate_pairs, matches_by_questions, questions, repaired
from ledgerloom.operators.stages import KNOWN_STAGES, known_stages, markers_in, stage_templates
from ledgerloom.operators.tails import kept_tail, path_with_id, standard_tails
from ledgerloom.operators.test_cases import CASE_COLUMNS, test_cases as cases_of


def test_cases_of_odd_answers(spark):
    good = json.dumps({"test_cases": [{"화면_ID": None, "수행자": 5, "사전조건": {"a": [1]}, "테스트_케이스": "① 12) go", "순서": "0x", "예상_결과": " 2. ok "}, {"화면명": "1", "테스트_데이터": "gone"}]}, ensure_ascii=False)
    rows = [(1, good), (2, None), (3, '{"test_cases": null}'), (4, '{"test_cases": {"순서": false}}'), (5, '{"test_cases": [{}, [], 3]}'), (6, '{"a": 1, "a": 2}'), (7, "no braces"), (7, "no braces"), (8, "[1]")]
    df = spark.createDataFrame(rows, "k int, answer string").withColumns({"pos": F.lit("clash"), "error": F.lit("clash")})
    out = cases_of(df, ["k"], "answer", F.lit("S-1-2"), F.lit(None).cast("string"), F.lit("screen"), F.lit(""))
    assert out.columns == ["k", "pos", *CASE_COLUMNS, "단위시험_제목", "error"]
    found = [(r.k, r.pos, r["화면_ID"], r["화면명"], r["수행자"], r["사전조건"], r["테스트_케이스"], r["예상_결과"], r["순서"], r.error) for r in out.orderBy("k", "pos").collect()]
    assert found == [
        (1, 1, "S-1-2", "screen", "5", '{"a":[1]}', "12) go", "ok", "0x", None),
        (1, 2, "S-1-2", "screen", "", "", "", "", "2", None),
        (2, None, *(None,) * 7, "the answer is no JSON object"),
        (3, None, *(None,) * 7, "test_cases is no list"),
        (4, 1, "S-1-2", "screen", "", "", "", "", "1", None),
        (5, None, *(None,) * 7, "case 2 is no object"),
        *[(k, None, *(None,) * 7, "the answer is no JSON object") for k in (6, 7, 7)],
        (8, None, *(None,) * 7, "the answer is no JSON object"),
    ]
    assert cases_of(df.limit(0), ["k"], "answer", F.lit(""), F.lit("")).count() == 0


def test_tails(spark):
    files = [(1, "Plan_v1.0"), (2, "plan list-SFR-A-01_V2"), (3, "Plans"), (4, "PLAN LIST"), (5, None), (6, ""), (7, "a_b [첨부 1] x"), (8, "x별첨 2")]
    catalog = [("p", "Plan"), ("q", "plan list"), ("o", "plan list"), ("r", 'a:b'), ("s", "")]
    f, c = spark.createDataFrame(files, "file_key int, stem string"), spark.createDataFrame(catalog, "output_key string, standard_stem string")
    assert {tuple(r) for r in standard_tails(f, c).collect()} == {(1, "p", "_v1.0"), (2, "o", "-SFR-A-01_V2"), (4, "o", ""), (7, "r", " [첨부 1] x")}
    kept = lambda stem, standard, tail: spark.range(1).select(kept_tail(F.lit(stem), F.lit(standard), F.lit(tail).cast("string"))).first()[0]
    assert kept("a_V2", "a", "_V2") == "_v0.1" and kept("a", "b", None) == "_v0.1"
    assert kept("a-SFR-X-1", "a", "-SFR-X-1") == "-SFR-X-1_v0.1"
    assert kept("b [첨부 1]-v3", "a", None) == "[첨부 1]-v0.1" and kept("a별첨 2", "q", None) == "_별첨 2_v0.1"
    assert kept("인수인계시험결과서 별첨1 인수인계확인서 SFR-A-1", "인수인계시험결과서", " 별첨1 인수인계확인서 SFR-A-1") == "_ 별첨1 인수인계확인서 SFR-A-1_v0.1"
    path = lambda p, i: spark.range(1).select(path_with_id(F.lit(p), F.lit(i).cast("string"))).first()[0]
    assert (path("x/y.z/a.docx", "S-1"), path("a", "S/1"), path("d/a_s-1.b", "S-1"), path("d/a", None)) == ("x/y.z/a_S-1.docx", "a_S_1", "d/a_s-1.b", "d/a")


def test_stages(spark):
    texts = spark.createDataFrame([(1, "05. 시 험 then 03.프로젝트 종료"), (2, "05.설계단계시험계획"), (3, None), (4, "none")], "k int, t string")
    dimension = known_stages(spark)
    out = stage_templates(texts, ["k"], "t", dimension).collect()
    names = lambda k: {r.output_name for r in out if r.k == k}
    of = lambda *markers: {n for m in markers for n, *_ in KNOWN_STAGES[m]}
    assert names(1) == of("05.시험", "프로젝트종료") and names(2) == of("05.설계단계시험계획") and not names(3) | names(4)
    found = spark.createDataFrame([("abcd",), ("xbc",), ("",), (None,)], "t string").select(F.array_sort(markers_in(F.col("t"), ["ab", "abc", "bc", "bcd", "c", "zz", ""])).alias("m"))
    assert [r.m for r in found.collect()] == [["ab", "abc", "bc", "bcd", "c"], ["bc", "c"], [], []]
    with pytest.raises(ValueError, match="white space"):
        stage_templates(texts, ["k"], "t", dimension.withColumn("marker", F.lit("a b")))


def test_sections_are_parsed_in_one_pass(spark):
    lines = spark.createDataFrame([(1, 0, "PMC-AB-01-Plan  folder"), (1, 1, "x"), (2, 0, None), (3, 0, "계획서"), (3, 1, "PMC-AB-02")], "k int, pos int, line string")
    df = section_outputs(lines, ["k"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Scan") == 1
    assert {tuple(r) for r in df.collect()} == {(1, 0, "PMC-AB-01", "Plan", "folder", "line"), (3, 0, "PMC-AB-02", "계획서", None, "sequential")}
    assert {r.parser for r in section_outputs(lines, ["k"], loose_id=False).collect()} == {"line"}


FILES = [(1, "a/one.docx", "one", "plan", "cover"), (2, "a/plan x.docx", "plan x", "", "cover of\n a plan"), (3, "b/three.docx", "three", "", "about the list"), (4, "b/plan.docx", "plan", "", ""), (5, "c/five.docx", "five", "other", "plan"), (6, "c/six.docx", "six", None, "x")]
OUTPUTS = [("P", "plan", True), ("L", "list", None), ("O", "other", False)]


@pytest.fixture(scope="module")
def matching(spark):
    files = spark.createDataFrame(FILES, "file_key int, path string, stem string, title string, cover string")
    return files.union(files.limit(1)), spark.createDataFrame(OUTPUTS, "output_key string, output_name string, wanted boolean"), spark.createDataFrame([(6, "L"), (4, "L"), (1, "L")], "file_key int, output_key string")


def test_candidates_and_questions(matching):
    files, outputs, hits = matching
    pairs = candidate_pairs(files, outputs, hits)
    assert {tuple(r) for r in pairs.collect()} == {(1, "P", True, True), (2, "P", False, True), (3, "L", False, True), (6, "L", False, False)}
    asked = {(r.output_key, r.part): r for r in questions(pairs, files, outputs, "site").collect()}
    assert set(asked) == {("P", 0), ("L", 0)}
    assert "2. file_name=six.docx\n   path=c/six.docx\n   cover_text=x" in asked["L", 0].question and "- output_name: list\n- expected_project_title: site" in asked["L", 0].question
    assert "cover_text=cover of a plan" in asked["P", 0].question
    split = questions(pairs, files, outputs, "site", most=1).collect()
    assert sorted((r.output_key, r.part, r.candidates[0].file_key) for r in split) == [("L", 0, 3), ("L", 1, 6), ("P", 0, 2)]


def asks(folder, fail=(), slow=()):
    """A callable that notes each call in a file."""

    def ask(question):
        import uuid

        Path(folder, uuid.uuid4().hex).write_text(question)
        if question in slow:
            time.sleep(6)
        if question in fail:
            raise ValueError("broken")
        return f'{{"selected": [{len(question)}]'

    return ask


def test_each_question_is_asked_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    rows = spark.createDataFrame([(f"q{i % 30}",) for i in range(90)] + [(None,)], "q string")
    asked = lambda: sorted(p.read_text() for p in calls.iterdir())
    run = lambda **o: {r.question_hash: (r.answer, r.error) for r in answered(rows, "q", asks(str(calls), fail=("q3",), slow=("q4",)), str(tmp_path / "kept"), seconds=2, **o).collect()}
    first = run()
    assert len(first) == 30 and sorted(e for _, e in first.values() if e) == ["TimeoutError: no answer in 2 seconds", "ValueError: broken"]
    assert asked() == sorted([f"q{i}" for i in range(30)] + ["q3"])  # the failing one twice
    again = run(attempts=1)
    assert again == first
    assert asked() == sorted([f"q{i}" for i in range(30)] + ["q3", "q3", "q4"])  # kept answers aren't asked for
    assert not [p for p in (tmp_path / "kept").rglob("*.*")]


def test_answers_are_repaired(spark, matching):
    files, outputs, hits = matching
    out = matches_by_questions(files, outputs, hits, lambda q: '{"selected": [9, 2, "x"' if "list" in q else "nothing")
    assert {tuple(r) for r in out.collect()} == {("P", 1, "title", None), ("P", 2, "answer", None), ("L", 3, "answer", None)}
    out = matches_by_questions(files, outputs, hits, lambda q: '{"selected": [2, 9]')
    assert {(r.output_key, r.file_key) for r in out.collect()} == {("P", 1), ("P", 2), ("L", 3), ("L", 6)}

    def fails(question):
        raise RuntimeError("down")

    out = matches_by_questions(files, outputs, hits, fails)
    assert {(r.output_key, r.file_key, r.error) for r in out.collect()} == {("P", 1, None), ("P", 2, "RuntimeError: down"), ("L", 3, "RuntimeError: down")}
    one = spark.range(1).select(repaired(F.lit(None).cast("string"), F.expr("array(named_struct('file_key', 1, 'in_cover', true), named_struct('file_key', 2, 'in_cover', false))")).alias("c")).first()
    assert [c.file_key for c in one.c] == [1]


def test_proposed_pairs(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "pos int, left string, right string")
    names = lambda c, rows: spark.createDataFrame([(r,) for r in rows], f"{c} string")
    out = accepted_pairs(pairs([(0, "a", "1")]).select("left", "right"), pairs([(1, "a", "2"), (2, "b", "2"), (3, "b", "3"), (4, "c", "2"), (5, "zz", "3"), (6, "d", "3")]), names("left", "abcd"), names("right", "123"))
    assert {tuple(r) for r in out.collect()} == {("a", "1", "rule"), ("b", "2", "proposed"), ("d", "3", "proposed")}


def test_leftovers(spark):
    columns = "file_key int, path string, stem string, title string, preview string, error string, project_title string, has_cover boolean"
    files = spark.createDataFrame([(1, "A/x.hwp", "x", "", "", "", "old", True), (2, "a/X.HWP", "x", "", "", "", "old", True), (3, "b/plan.docx", "plan", "", "", "", None, False), (4, "c/q.docx", "q", "", "", "", " New  site", True), (5, "c/r.docx", "r", None, None, None, "old site", True), (6, "c/s.docx", "s", "", "", "", "old site", None), (7, "d/t.hwpx", "t", "", "", "", "old", True)], columns)
    outputs = spark.createDataFrame([(1, "MFDS-001", "plan", None), (2, "MFDS-002", "plan", None)], "output_key int, output_id string, output_name string, aliases array<string>")
    chosen = spark.createDataFrame([("A\\X.hwp", "t.hwp"), ("d/y.hwp", "T.HWP")], "path string, target_name string")
    out = leftover_updates(files, outputs, chosen, spark.createDataFrame([], "path string"), "New site")
    assert {(r.file_key, r.action, r.output_key) for r in out.collect()} == {(3, "full", 1), (5, "title_only", None)}
    assert leftover_updates(files.limit(0), outputs, chosen, chosen.select("path"), "x").count() == 0


def test_leftovers_are_dealt_out_and_written_once(spark, sf_dir, monkeypatch):
    """Before, the files left over and their keys were computed anew for each join, all files of a small table in one task."""
    from ledgerloom.operators import leftovers
    from ledgerloom.plans import registry

    plans, write = [], leftovers.materialise
    monkeypatch.setattr(leftovers, "materialise", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), write(df))[1])
    out = registry.QUERIES["leftovers_updated"](spark, sf_dir)
    assert len(plans) == 1 and "Repartition 32, true" in plans[0] and "ArrowEvalPython" not in plans[0]
    assert not [f for f in out.inputFiles() if "part.parquet" in f]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1  # the ratio of titles alone


def test_leftovers_without_path_or_name(spark):
    columns = "file_key int, path string, stem string, title string, preview string, error string, project_title string, has_cover boolean, more map<string, int>"
    files = spark.createDataFrame([(1, None, "plan", "", "", "", "old", True, None), (2, "b/x", None, "plan", "MFDS-001", "", "old", True, {"a": 1}), (3, "b/y", "plan", "", "", "", "old", True, {})], columns)
    outputs = spark.createDataFrame([(1, "MFDS-001", "plan", None)], "output_key int, output_id string, output_name string, aliases array<string>")
    none = spark.createDataFrame([], "path string, target_name string")
    found = {(r.file_key, r.action, r.output_key) for r in leftover_updates(files, outputs, none, none.select("path"), "New site").collect()}
    assert found == {(2, "title_only", None), (3, "full", 1)}
