"""The score ladder on cases with known results."""

import pytest

from ledgerloom.operators.score import file_scores

FILES = "file_key string, stem string, title string, preview string, error string"
OUTPUTS = "output_key string, output_id string, output_name string, aliases array<string>"


CASES = [
    (("MFDS-PMC-06-RiskRegister_v1.0.xlsx",), ("MFDS-PMC-06", "OtherDocument"), None, None),
    (("MFDS-PMC-06-RiskRegister_v1.0.xlsx",), ("MFDS-PMC-99", "RiskRegister"), 0.94, 0.94),
    (("MFDS-PMC-06-RiskRegister_v1.0.xlsx",), ("MFDS-PMC-06", "RiskRegister"), 0.94, 1.0),
    (("MFDS-PMC-02-요구사항추적표(검사기준포함)_v1.0.xlsx",), ("MFDS-PMC-02", "요구사항추적표"), 0.94, 1.0),
    (("template.xlsx", None, "MFDS-PMC-06"), ("MFDS-PMC-06", "OtherDocument"), None, None),
    (("RiskRegister.docm",), ("X-01", "Risk Register"), 0.97, 0.97),
    (("RiskRegister", "Risk Register"), ("X-01", "RiskRegister"), 1.0, 1.0),
    (("RiskRegister", None, "MFDS-PMC-06 cover"), ("MFDS-PMC-06", "RiskRegister"), 0.97, 1.0),
    (("RiskRegister", None, "MFDS-PMC-06 cover"), ("MFDS-PMC-06-Risk", "RiskRegister"), 0.97, 0.98),
    (("Risk",), ("X-01", "RiskRegister"), 0.86, 0.86),
    (("ABC-77 Risk",), ("X-01", "RiskRegister"), None, None),
    (("Risk", "Something else"), ("X-01", "RiskRegister"), None, None),  # titles differ
    (("Risk", "RiskRegistry"), ("X-01", "RiskRegister"), 0.86, 0.86),  # nearly the same title
    (("RiskRegister", "Something else"), ("X-01", "RiskRegister"), 0.97, 0.97),  # the name holds the alias
    (("Risk", "Something else", None, "unreadable"), ("X-01", "RiskRegister"), 0.86, 0.86),
    (("Register of risks [별첨 1] x",), ("X-01", "Registers", ["Register of risks"]), 0.97, 0.97),
    ((None,), ("X-01", "RiskRegister"), None, None),
    (("RiskRegister",), (None, "RiskRegister"), 0.97, 0.97),
    (("ＲｉｓｋＲｅｇｉｓｔｅｒ",), ("X-01", "Risk Register"), 0.97, 0.97),
    (("통합테스트결과서",), ("X-01", "통합시험결과서"), 0.97, 0.97),
]


@pytest.mark.parametrize("use_output_id", [False, True])
def test_scores(spark, use_output_id):
    """All files and outputs at once: each case's own pair has its score or none."""
    files = spark.createDataFrame([(str(i), *(*f, None, None, None)[:4]) for i, (f, *_) in enumerate(CASES)], FILES)
    outputs = spark.createDataFrame([(str(i), *(*o, None)[:3]) for i, (_, o, *_) in enumerate(CASES)], OUTPUTS)
    found = {r.file_key: r.score for r in file_scores(files, outputs, use_output_id=use_output_id).where("file_key = output_key").collect()}
    assert [found.get(str(i)) for i in range(len(CASES))] == [c[3 if use_output_id else 2] for c in CASES]


def test_empty_tables_give_no_scores(spark):
    files, outputs = spark.createDataFrame([("f", "name", None, None, None)], FILES), spark.createDataFrame([("o", "A-01", "name", None)], OUTPUTS)
    assert file_scores(files.limit(0), outputs).count() == 0 and file_scores(files, outputs.limit(0)).count() == 0
    assert file_scores(files.union(files), outputs).count() == 2


def test_parentheses_of_any_depth(spark):
    from ledgerloom.functions.titles import title_key, without_parentheses

    deep = "a" + "(" * 9 + "x" + ")" * 9 + "b"
    rows = spark.createDataFrame([(deep,), ("plain",), (None,), ("a（b(c)d）e (f",), ("((",)], "t string")
    from pyspark.sql import functions as F

    assert [r[0] for r in rows.select(F.regexp_replace(without_parentheses(F.col("t")), " +", " ")).collect()] == ["a b", "plain", None, "a e (f", "(("]
    assert rows.select(title_key(F.col("t"))).first()[0] == "ab"


def test_files_of_one_content_are_scored_once(spark, monkeypatch):
    """Before, each of them was prepared for itself and scored in each of its pairs."""
    from ledgerloom.operators import score

    seen, prepared = [], score.prepared_files
    monkeypatch.setattr(score, "prepared_files", lambda files: (seen.append(files.count()), prepared(files))[1])
    texts = [("Risk", None, "", None), ("Risk", "", None, ""), ("Risk", "x", "", "unreadable"), ("RiskRegister", "Risk", "", ""), ("Ris", "kRisk", "", ""), (None, "RiskRegister", "", ""), ("", "RiskRegister", "", "")]
    files = spark.createDataFrame([(f"{i}-{n}", *texts[i]) for i in range(len(texts)) for n in range(5)] + [(None, *texts[0])], FILES)
    outputs = spark.createDataFrame([("a", "X-01", "RiskRegister", None), ("b", None, "Risk Register", [])], OUTPUTS)
    found = sorted((r.file_key, r.output_key, r.score) for r in score.file_scores(files, outputs, use_output_id=True).collect())
    assert seen == [4]  # the first three are one content, the last two another
    assert found == sorted((f"{i}-{n}", o, s) for i, s in ((0, 0.86), (1, 0.86), (2, 0.86), (3, 0.97)) for n in range(5) for o in "ab")


def test_keys_are_written_before_their_joins(spark, sf_dir):
    """Before, the keys of all files were computed anew for each side of each join, in one task, and planned as often."""
    from ledgerloom.plans import registry

    plan = registry.QUERIES["score_ladder_ids"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1  # the ratio of titles alone
