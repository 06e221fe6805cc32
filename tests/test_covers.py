"""Cover text of packages, shapes of slides and titles."""

import io
import random
import time
import tracemalloc
import zipfile
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.slides import slide_identities
from ledgerloom.operators.title_match import best_titles, contenders
from ledgerloom.sources.covers import cover_members, cover_text, limited, register_covers, text_nodes
from ledgerloom.sources.slides import read_slide_shapes


def package(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name, text)


def nodes(*texts):
    return "<r>" + "".join(f"<a:t>{t}</a:t>" for t in texts) + "</r>"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("covers")
    (root / "deep").mkdir()
    package(root / "a.pptx", {"ppt/slides/slide2.xml": nodes("no"), "ppt/slides/slide1.xml": nodes(" one ", "", "two &amp; <b>x</b>")})
    package(root / "b.hwpx", {"Contents/section10.xml": nodes("ten"), "Contents/section2.xml": nodes("second"), "Contents/section0.xml": nodes("zero"), "other.xml": nodes("no")})
    package(root / "deep" / "c.xlsx", {"xl/worksheets/sheet1.xml": nodes("cell"), "xl/sharedStrings.xml": "<sst><si><t xml:space='preserve'> shared </t></si><si><t/></si></sst>"})
    package(root / "d.docx", {"word/styles.xml": nodes("style"), "_rels/x.xml": nodes("no")})  # no document: all XML members
    package(root / "long.docx", {"word/document.xml": nodes("x" * 9000, "y")})
    package(root / "empty.docx", {"word/document.xml": "<r/>"})
    (root / "broken.pptx").write_bytes(b"PK not a package")
    (root / "notes.txt").write_text("no")
    return root


def test_covers_of_a_folder(spark, folder):
    register_covers(spark)
    read = lambda **o: {r.path.split("/")[-1]: r for r in spark.read.format("package_covers").options(**o).load(str(folder)).collect()}
    rows = read(filesPerPartition="2")
    assert {k: r.text for k, r in rows.items()} == {"a.pptx": "one\ntwo &amp; <b>x</b>", "b.hwpx": "zero\nsecond\nten", "c.xlsx": "shared\ncell", "d.docx": "style", "long.docx": "x" * 5000, "empty.docx": "", "broken.pptx": None}
    assert [k for k, r in rows.items() if r.error] == ["broken.pptx"]
    assert {r.text for r in read(maxChars="4").values()} == {"one", "zero", "shar", "styl", "xxxx", "", None}
    assert spark.read.format("package_covers").option("filesPerPartition", "2").load(str(folder)).rdd.getNumPartitions() == 4


def test_text_nodes_in_pieces_of_any_size():
    rng = random.Random(1)
    for _ in range(300):
        texts = ["".join(rng.choices(" ab<é한", k=rng.randint(0, 12))) for _ in range(rng.randint(0, 6))]
        xml = "".join(rng.choice(["<tbl>", "<hp:t/>", "<p>", ""]) + f"<hp:t a='1'>{t}</hp:t>" for t in texts).encode()
        n = rng.randint(1, 9)
        assert list(text_nodes((xml[i : i + n] for i in range(0, len(xml), n)), 100)) == [t.strip() for t in texts if t.strip()]
    assert list(text_nodes([b"<t>  ab   ", b"   </t><t>abcdef  </t>", b"<t>abc  d</t>"], 4)) == ["ab", "abcd", "abc "]
    assert limited(iter(["ab", "cd", "ef"]), 5) == "ab\ncd"
    assert cover_members(".pptx", ["ppt/slides/slide3.xml", "_rels/y.xml"]) == ["ppt/slides/slide3.xml"]


def test_huge_member_is_read_in_constant_memory(tmp_path):
    with zipfile.ZipFile(tmp_path / "huge.docx", "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z, z.open("word/document.xml", "w", force_zip64=True) as member:
        piece = b"<p><s>" + b" " * (1 << 20) + b"</s></p>"
        for _ in range(500):
            member.write(piece)
        member.write(nodes("at the end").encode())
    tracemalloc.start()
    with open(tmp_path / "huge.docx", "rb") as f:
        assert cover_text(f, ".docx") == "at the end"
    assert tracemalloc.get_traced_memory()[1] < 8_000_000
    tracemalloc.stop()
    package(tmp_path / "early.docx", {"word/document.xml": nodes("x" * 6000) + "<s>" + " " * 300_000_000 + "</s>"})
    start = time.perf_counter()
    with open(tmp_path / "early.docx", "rb") as f:
        assert cover_text(f, ".docx") == "x" * 5000
    assert time.perf_counter() - start < 0.2


SLIDE = """<p:sld xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><p:cSld><p:spTree>{}</p:spTree></p:cSld></p:sld>"""
SHAPE = """<p:sp><p:spPr><a:xfrm><a:off x="{}" y="{}"/></a:xfrm></p:spPr><p:txBody>{}</p:txBody></p:sp>"""


def paragraph(text, size):
    return f'<a:p><a:r><a:rPr sz="{size}"/><a:t>{text}</a:t></a:r></a:p>'


def test_shapes_and_titles_of_a_slide(spark):
    shapes = [SHAPE.format(5, 300, paragraph("문서번호", 1200) + paragraph("PMC-AB-01", 1200)), SHAPE.format(0, 100, paragraph("통합  포털", 2000)), SHAPE.format(0, 200, paragraph("업무 정의서", 4000)), SHAPE.format(0, 400, paragraph("below", 9000)), "<p:sp/>"]
    buffer = io.BytesIO()
    package(buffer, {"ppt/slides/slide1.xml": SLIDE.format("".join(shapes))})
    files = spark.createDataFrame([("s.pptx", ".pptx", bytearray(buffer.getvalue())), ("bad.pptx", ".PPTX", bytearray(b"x")), ("t.txt", ".txt", bytearray(b"x"))], "path string, suffix string, content binary")
    rows = read_slide_shapes(files).cache()
    assert {(r.path, r.pos, r.x, r.y, r.font_size, r.text) for r in rows.where("error is null").collect()} == {("s.pptx", 0, 5, 300, 1200, "문서번호 PMC-AB-01"), ("s.pptx", 1, 0, 100, 2000, "통합 포털"), ("s.pptx", 2, 0, 200, 4000, "업무 정의서"), ("s.pptx", 3, 0, 400, 9000, "below")}
    assert [r.path for r in rows.where("error is not null").collect()] == ["bad.pptx"]
    (one,) = slide_identities(rows.where("error is null"), ["path"]).collect()
    assert (one.project_title, one.document_title, one.document_number) == ("업무", "정의서", "PMC-AB-01")
    assert one.preview_text == "통합 포털\n업무 정의서\n문서번호 PMC-AB-01\nbelow"


def test_titles_of_odd_slides(spark):
    rows = [("none", 0, 0, 0, 10, None), ("none", 1, 0, 0, 10, " - "), ("dates", 0, 0, 0, 10, "2024.10"), ("row", 0, 0, 5, 10, "left"), ("row", 1, 9, 5, 20, "right"), ("label", 0, 0, 0, 10, "Version 3"), ("label", 1, 0, 50, 10, "name"), ("maker", 0, 0, 0, 99, "Maker site"), ("maker", 1, 0, 9, 1, "WBS")]
    df = spark.createDataFrame(rows, "k string, pos int, x int, y int, font_size int, text string")
    found = {r.k: (r.project_title, r.document_title) for r in slide_identities(df, ["k"], publishers=("Maker",)).collect()}
    assert found == {"none": ("", ""), "dates": ("", "2024.10"), "row": ("left", "right"), "label": ("", "name"), "maker": ("", "WBS")}


def reference_ratio(a, b):
    if a == b:
        return 1.0
    if min(len(a), len(b)) >= 6 and (a in b or b in a):
        return 0.9
    return SequenceMatcher(None, a, b).ratio()


def test_best_titles_equal_brute_force_with_few_ratios(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcde통합포", k=rng.randint(1, 8)))
    titles = [(g, p, " ".join(word() for _ in range(rng.randint(1, 4)))) for g in range(60) for p in range(40)]
    expected = [(g, rng.choice([" ".join(word() for _ in range(3)), titles[g * 40 + 5][2] + word(), "q" * 250, ""])) for g in range(60)]
    titles += [(0, 99, None), (1, 99, "--"), (2, 3, titles[2 * 40 + 3][2]), (3, 50, "사업명: " + expected[3][1]), (99, 0, "no expected title")]
    key = lambda x: "".join(c for c in (x or "").removeprefix("사업명: ").lower() if c.isalnum())
    best = {}
    for g, e in expected:
        seen = set()
        for gg, p, t in sorted(titles, key=lambda x: x[1]):
            if gg == g and key(t) and key(e) and key(t) not in seen:
                seen.add(key(t))
                s = reference_ratio(key(t), key(e))
                if s >= 0.58 and s > best.get(g, ("", 0))[1]:
                    best[g] = (t.removeprefix("사업명: "), s)
    c, e = spark.createDataFrame(titles, "g int, pos int, title string"), spark.createDataFrame(expected, "g int, expected_title string")
    assert {r.g: (r.best_title, r.score) for r in best_titles(c, e, ["g"]).collect()} == best and len(best) > 20
    computed = contenders(c, e, ["g"]).where("_cheap is null").count()
    assert computed < 0.4 * len(titles)


def test_title_keys(spark):
    rows = spark.createDataFrame([(1, 1, '프로젝트 명 : "2024년도 통합-포털.pptx"'), (2, 1, " x "), (2, 2, None)], "g int, pos int, title string")
    expected = spark.createDataFrame([(1, "통합 포털"), (2, None)], "g int, expected_title string")
    assert [tuple(r) for r in best_titles(rows, expected, ["g"]).collect()] == [(1, "2024년도 통합-포털.pptx", 1.0)]
    assert best_titles(rows.limit(0), expected, ["g"]).count() == 0
    assert best_titles(rows.withColumn("title", F.lit("")), expected, ["g"]).count() == 0
