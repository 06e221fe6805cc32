"""Cells of workbooks and text of zipped XML documents, read on the executors from binaryFile contents.

A file that can't be read gives one row with its error, never a failed job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS = "path string, sheet_pos int, sheet string, row int, col int, ref string, text string, error string"


def read_workbook_cells(files: DataFrame) -> DataFrame:
    """files: path, suffix, content -> a row per filled cell."""

    def read(path: str, content: bytes):
        import io
        import re
        import zipfile
        from html import unescape

        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                part = lambda name: z.read(name).decode("utf-8", "replace") if name in z.namelist() else ""
                text_of = lambda xml: unescape("".join(re.findall(r"<t(?:\s[^>]*)?>([^<]*)</t>", xml)))
                shared = [text_of(x) for x in re.findall(r"<si>(.*?)</si>", part("xl/sharedStrings.xml"), re.S)]
                attribute = lambda tag, name: (re.search(rf'\b{name}="([^"]*)"', tag) or [None, ""])[1]
                targets = {attribute(t, "Id"): attribute(t, "Target") for t in re.findall(r"<Relationship\s[^>]*>", part("xl/_rels/workbook.xml.rels"))}
                for n, tag in enumerate(re.findall(r"<sheet\s[^>]*>", part("xl/workbook.xml"))):
                    target = targets.get(attribute(tag, "r:id"), "")
                    xml = part(target.lstrip("/") if target.startswith("/") else f"xl/{target}")
                    for open_, body in re.findall(r"<c\s([^>]*?)(?:/>|>(.*?)</c>)", xml, re.S):
                        ref, kind = attribute(f" {open_}", "r"), attribute(f" {open_}", "t")
                        value = (re.search(r"<v>([^<]*)</v>", body) or [None, ""])[1]
                        text = text_of(body) if kind == "inlineStr" else shared[int(value)] if kind == "s" and value else unescape(value)
                        if text:
                            letters, row = re.match(r"([A-Z]+)(\d+)", ref).groups()
                            col = 0
                            for c in letters:
                                col = col * 26 + ord(c) - 64
                            yield path, n, unescape(attribute(tag, "name")), int(row), col, ref, text, None
        except Exception as e:  # any broken file is data
            yield path, None, None, None, None, None, None, f"{type(e).__name__}: {e}"

    return mapped(files.where(F.col("suffix").isin(".xlsx", ".xlsm")), read, CELLS)


def read_package_text(files: DataFrame) -> DataFrame:
    """path, text (text nodes by line, parts in order of name), error, for zipped XML documents."""

    def read(path: str, content: bytes):
        import io
        import re
        import zipfile
        from html import unescape

        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                names = sorted((n for n in z.namelist() if n.endswith(".xml") and "_rels/" not in n), key=lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)])
                nodes = [unescape(t) for n in names for t in re.findall(r"<(?:\w+:)?t(?:\s[^>]*)?>([^<]+)</(?:\w+:)?t>", z.read(n).decode("utf-8", "replace"))]
                yield path, "\n".join(nodes), None
        except Exception as e:  # any broken file is data
            yield path, None, f"{type(e).__name__}: {e}"

    return mapped(files.where(F.col("suffix").isin(".hwpx", ".docx", ".pptx", ".xlsx", ".xlsm")), read, "path string, text string, error string")


def mapped(files: DataFrame, read, schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frames):
        import pandas as pd

        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                rows = list(read(path, content))  # one file at a time
                if rows:
                    yield pd.DataFrame(rows, columns=names, dtype=object)

    return files.select("path", "content").mapInPandas(run, schema)
