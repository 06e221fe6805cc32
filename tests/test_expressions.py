from pyspark.sql import functions as F

from ledgerloom.functions.arrays import column_letters, column_number, ends_with_parts, missing_numbers, split_names, subpath_index
from ledgerloom.functions.dates import revision_date
from ledgerloom.functions.titles import name_key, without_leading_ids, without_parentheses
from ledgerloom.functions.keys import all_ids, file_stem, file_suffix, folded, id_shape, prefix_related, render_tokens, sheet_title
from ledgerloom.sources.listing import list_files
from ledgerloom.sources.packages import read_package_text, read_workbook_cells


def values(spark, expression, *rows, names=("a", "b")):
    return [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ["i", *names[: len(rows[0])]]).orderBy("i").select(expression).collect()]


def test_keys(spark):
    assert values(spark, name_key(F.col("a")), ("MFDS-ADT-01-단위시험결과서_SFR-IIL-002_v0.1.hwpx",), ("Risk Register v1.2.xlsx",)) == ["mfdsadt01단위시험결과서", "riskregister"]
    assert values(spark, folded(F.col("a")), ("ABC",), ("Ａｂ①",), ("ß",)) == ["abc", "ab1", "ss"]
    assert values(spark, without_parentheses(F.col("a")), ("a(b(c)d)e",), ("x",)) == ["a e", "x"]
    assert values(spark, without_leading_ids(F.col("a")), ("MFDS-PMC-02-요구",), ("12_34 name",)) == ["요구", "name"]
    assert values(spark, id_shape(F.col("a")), ("SFR-OOO-13",), ("SFR-A1-2",)) == ["A-A-N", "A-X-N"]
    assert values(spark, prefix_related(F.col("a"), F.col("b")), ("SFR-1", "SFR-1-2"), ("SFR-1", "SFR-12")) == [True, False]
    assert values(spark, file_suffix(F.col("a")), ("d/x.tar.gz",), (".bashrc",)) == [".gz", ""]
    assert values(spark, file_stem(F.col("a")), ("d/x.tar.gz",), (".bashrc",)) == ["x.tar", ".bashrc"]
    assert values(spark, sheet_title(F.col("a")), ("a/b" * 20,), ("",)) == [("a_b" * 20)[:31], "sheet"]


def test_tokens_are_rendered_once(spark):
    rendered = render_tokens(F.col("a"), {"X": F.col("b"), "Y": F.lit("y")})
    assert values(spark, rendered, ("{{X}}-{{ Y }}-{{Z}}", "{{Y}}"), ("none", "b")) == ["{{Y}}-y-", "none"]
    assert values(spark, render_tokens(F.col("a"), {"X": F.col("b")}, unknown=None), ("{{X}}{{Z}}", "1")) == ["1{{Z}}"]


def test_arrays(spark):
    parts = lambda c: F.split(c, "/")
    assert values(spark, subpath_index(parts(F.col("a")), parts(F.col("b"))), ("x/y/z", "y/z"), ("x", "x/y"), ("a/b", "c")) == [1, -1, -1]
    assert values(spark, ends_with_parts(parts(F.col("a")), parts(F.col("b"))), ("x/y/z", "y/z"), ("x", "x/y")) == [True, False]
    assert values(spark, split_names(F.col("a")), ("A, B; A\nC & D and E",)) == [["A", "B", "C", "D", "E"]]
    assert values(spark, missing_numbers(F.array(F.lit(1), F.lit(3)), F.col("a").cast("int")), (4,), (0,)) == [[2, 4], []]
    assert values(spark, column_number(F.col("a")), ("A1",), ("Z9",), ("AA1",), ("XFD1",)) == [1, 26, 27, 16384]
    assert values(spark, column_letters(F.col("a")), (1,), (26,), (27,), (702,), (703,), (16384,)) == ["A", "Z", "AA", "ZZ", "AAA", "XFD"]
    assert values(spark, all_ids(F.col("a"), r"(?i)SFR-\d+"), ("sfr-1 SFR-2 SFR-1",)) == [["SFR-1", "SFR-2"]]


def test_dates(spark):
    assert values(spark, revision_date(F.col("a")), ("2024.3.5",), ("2024",), ("2024-11",), ("2024년 3월 5일",), ("soon/now",)) == ["2024-03-05", "2024-00-00", "2024-11-00", "2024-03-05", "soon-now"]


def test_listing(spark, tmp_path):
    for f in ("a/x.hwpx", "a/bak/y.xlsx", "b/~$z.xlsx", "b/Thumbs.db", "b/w.XLSX", "n.txt"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_text("1")
    out = list_files(spark, str(tmp_path), [".hwpx", ".xlsx"], ignored_folders=("bak",))
    assert sorted(r["path"] for r in out.collect()) == ["a/x.hwpx", "b/w.XLSX"]
    assert [r["path"] for r in list_files(spark, str(tmp_path), [".hwpx", ".xlsx"], only_under=[["a", "bak"]]).collect()] == ["a/bak/y.xlsx"]


def test_packages(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "book.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", '<workbook><sheets><sheet name="표지" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>Title &amp; more</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet><sheetData><row r="2"><c r="B2" t="s"><v>0</v></c><c r="C2"><v>7</v></c><c r="D2" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>')
    with zipfile.ZipFile(tmp_path / "doc.hwpx", "w") as z:
        z.writestr("Contents/section0.xml", "<hp:p><hp:t>가나</hp:t><hp:t>SFR-001</hp:t></hp:p>")
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    files = list_files(spark, str(tmp_path), contents=True)
    cells = read_workbook_cells(files).where("error is null").orderBy("row", "col").collect()
    assert [(r.sheet, r.ref, r.row, r.col, r.text) for r in cells] == [("표지", "B2", 2, 2, "Title & more"), ("표지", "C2", 2, 3, "7"), ("표지", "D2", 2, 4, "in")]
    assert {r.path: bool(r.error) for r in read_workbook_cells(files).select("path", "error").distinct().collect()} == {"book.xlsx": False, "bad.xlsx": True}
    texts = {r.path: r.text for r in read_package_text(files).collect()}
    assert texts["doc.hwpx"] == "가나\nSFR-001"


def test_status_stream(spark, tmp_path):
    from ledgerloom.streaming.state import latest_status_stream

    schema = "job string, status string, ts timestamp"
    source = tmp_path / "in"
    frame = spark.createDataFrame([("a", "queued", "2024-01-01 00:00:00"), ("a", "done", "2024-01-01 00:05:00"), ("b", "queued", "2024-01-01 00:01:00")], "job string, status string, ts string").selectExpr("job", "status", "cast(ts as timestamp) ts")
    frame.write.parquet(str(source))
    stream = latest_status_stream(spark.readStream.schema(schema).parquet(str(source)), ["job"], "status", "ts")
    query = stream.writeStream.format("memory").queryName("status_now").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination()
    assert {(r.job, r.status) for r in spark.table("status_now").collect()} == {("a", "done"), ("b", "queued")}


def test_similarity_and_completion(spark):
    from difflib import SequenceMatcher

    from ledgerloom.functions.completion import completed, json_object
    from ledgerloom.functions.similarity import title_similarity

    pairs = [("risk register", "risk registers"), ("abc", "abc"), ("plan", "register of risks"), ("ab", "abc")]
    expected = [0.9, 1.0, SequenceMatcher(None, *pairs[2]).ratio(), SequenceMatcher(None, *pairs[3]).ratio()]
    assert values(spark, title_similarity(F.col("a"), F.col("b")), *pairs) == expected

    def ask(prompt):
        if prompt == "bad":
            raise TimeoutError("late")
        return 'Here: {"n": 3} done'

    out = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None)], "i int, p string").select("i", completed(F.col("p"), ask).alias("c")).select("i", "c.*", json_object(F.col("c.text"), "n int").alias("o")).orderBy("i").collect()
    assert out[0].o.n == 3 and out[1].error == "TimeoutError: late" and out[1].o is None and out[2].text is None


def test_header_quadruple_and_states(spark):
    from ledgerloom.operators.cells import sliding_four
    from ledgerloom.operators.status import cover_status

    cells = spark.createDataFrame([("f", 1, c, t) for c, t in enumerate(["MFDS-PMC-06", "v1.0", "2024-01-02", "Kim", "x"])] + [("g", 1, c, t) for c, t in enumerate(["MFDS-PMC-07", "nope", "2024-01-02", "Kim"])], "path string, row int, col int, text string")
    out = sliding_four(cells, ["path"], r"^[A-Z]+-[A-Z]+-\d\d$", r"^[vV]?\d+(\.\d+)*$", r"^\d{4}-\d\d?-\d\d?$").collect()
    assert [(r.path, r.code, r.version, r.date, r.author) for r in out] == [("f", "MFDS-PMC-06", "v1.0", "2024-01-02", "Kim")]
    rows = spark.createDataFrame([("a", "b", "t", "u", 2, ""), ("a", "b", "t", "u", 1, ""), ("a", "a", "t", "t", 0, ""), ("a", "b", "t", "t", 0, "boom"), ("a", "b", "t", "t", 0, None)], "a string, b string, c string, d string, n int, e string")
    assert [r[0] for r in rows.select(cover_status("a", "b", "c", "d", "n", "e")).collect()] == ["updated", "partial", "unchanged", "failed", "unchanged"]


def test_containment_of_short_patterns(spark):
    from ledgerloom.operators.match import containment_join

    texts = ["one two three four", "xone two", "ab", "", None, "é日本 x", "a  b c", "one"]
    patterns = ["one", "ne tw", "one two three", "two", "ab", "a", "", " ", "日本", "本 x", "a  b", "nothing", "ab ", None]
    t = spark.createDataFrame(list(enumerate(texts)), "t long, text string")
    p = spark.createDataFrame(list(enumerate(patterns)), "p long, pattern string")
    found = sorted((r.t, r.p) for r in containment_join(t, "text", p, "pattern").collect())
    assert found == sorted((i, k) for i, x in enumerate(texts) for k, y in enumerate(patterns) if x is not None and y is not None and y in x)
