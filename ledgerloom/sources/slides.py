"""Shapes of first slides: their text, place and largest font, read on the executors from binaryFile contents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .covers import SLIDES
from .packages import mapped

SHAPES = "path string, pos int, x bigint, y bigint, font_size bigint, text string, error string"


def read_slide_shapes(files: DataFrame) -> DataFrame:
    """files: path, suffix, content -> a row for each shape with text, in the slide's order (pos).

    A file that can't be read, or without a first slide, gives one row with its error. Shapes without a place stand at 0, 0.
    """

    def read(path: str, content: bytes):
        import io
        import xml.etree.ElementTree as ET
        import zipfile

        p, a = "{http://schemas.openxmlformats.org/presentationml/2006/main}", "{http://schemas.openxmlformats.org/drawingml/2006/main}"
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                tree = ET.fromstring(z.read("ppt/slides/slide1.xml").decode("utf-8", "ignore")).find(f".//{p}spTree")
            rows = []
            for shape in tree if tree is not None else []:
                paragraphs = (" ".join("".join(t.text or "" for t in x.iter(f"{a}t")).split()) for x in shape.iter(f"{a}p"))
                text = " ".join(x for x in paragraphs if x)
                off = next((o for form in (a, p) for o in shape.findall(f".//{form}xfrm/{a}off")), None)
                sizes = [int(s) for r in shape.iter(f"{a}rPr") if (s := r.get("sz", "")).isdigit()]
                if text:
                    at = (0, 0) if off is None else (int(off.get("x") or 0), int(off.get("y") or 0))
                    rows.append((path, len(rows), *at, max(sizes, default=0), text, None))
            yield from rows
        except Exception as e:  # any broken file is data
            yield path, None, None, None, None, None, f"{type(e).__name__}: {e}"

    return mapped(files.where(F.lower("suffix").isin(*SLIDES)), read, SHAPES)
