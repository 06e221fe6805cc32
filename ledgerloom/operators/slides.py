"""What a first slide says of its document: titles and number out of shapes with a place and a font size.

shapes: keys, pos (the slide's own order), x, y, font_size, text. A slide is one part of a file, so its shapes are one
array: a single group per slide and no join. Null texts and shapes of nothing but space count as noise; equal shapes keep their
order; a slide without shapes has no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.titles import EDGE, OUTPUT_ID, trimmed

# Fixed values.
METADATA_LABELS = ("문서번호", "Version", "버전", "개정일자", "작성자")
SLIDE_TITLE_KEYWORDS = ("계획서", "결과서", "정의서", "시나리오", "케이스", "매뉴얼", "보고서", "대장", "목록", "추적표", "회의록", "WBS", "교육자료")
MANUAL, MANUAL_KINDS = "매뉴얼", ("사용자", "운영자", "관리자")
COMPANY = r"\A(?:\(주\)|㈜)"
DATE_LIKE = r"\A(?:20)?\d{2}(?:\d{1,2})?\z"
NUMBER_AFTER_LABEL = r"문서번호\s*[:：]?\s*([A-Za-z0-9][A-Za-z0-9-]+)"


def cover_line(value: Column) -> Column:
    """Entities of &, < and > decoded, one space for any white space, no spaces or hyphens at the ends."""
    decoded = F.replace(F.replace(F.replace(value, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    return trimmed(F.regexp_replace(decoded, r"(?U)\s+", " "), EDGE)


def has_metadata_label(text: Column) -> Column:
    return text.rlike("|".join(METADATA_LABELS))


def is_cover_noise(line: Column, publishers: tuple[str, ...] = ()) -> Column:
    """Of a cleaned line: empty, a publisher's or company's name, an output id, or a label. publishers: beginnings of lines that name who publishes."""
    out = (line == "") | line.rlike(COMPANY) | line.rlike(rf"\A{OUTPUT_ID}\z") | has_metadata_label(line)
    for name in publishers:
        out = out | F.startswith(line, F.lit(name))
    return out


def is_date_like(line: Column) -> Column:
    return F.regexp_replace(line, r"(?U)[\s.년월/-]+", "").rlike(DATE_LIKE)


def title_shapes(shapes: Column, publishers: tuple[str, ...] = ()) -> Column:
    """The shapes above the first label that are neither noise nor dates; without any, all that are no noise."""
    label_y = F.array_min(F.transform(F.filter(shapes, lambda s: has_metadata_label(s["text"])), lambda s: s["y"]))
    quiet = F.filter(shapes, lambda s: ~is_cover_noise(s["line"], publishers))
    above = F.filter(quiet, lambda s: (label_y.isNull() | (s["y"] < label_y)) & ~is_date_like(s["line"]))
    return F.when(F.size(above) > 0, above).otherwise(F.filter(quiet, lambda s: ~has_metadata_label(s["text"])))


def title_place(shapes: Column) -> Column:
    """Place (from 0) of the shape with the document's title: the largest font, then the lowest, of those with a keyword, else of all; null for none."""
    ranked = F.transform(shapes, lambda s, i: F.struct(s["text"].rlike("|".join(SLIDE_TITLE_KEYWORDS)).alias("key"), s["font_size"].alias("font"), s["y"].alias("y"), (-i).alias("first")))
    return -F.array_max(ranked)["first"]


def split_combined(line: Column) -> Column:
    """Struct project, document of a line "project document" whose last word has a keyword; null for other lines."""

    def of_words(words: Column) -> Column:
        manual = (F.element_at(words, -1) == MANUAL) & F.get(words, F.size(words) - 2).isin(*MANUAL_KINDS)
        n = F.when(F.coalesce(manual, F.lit(False)), 2).otherwise(1)
        out = F.struct(F.array_join(F.slice(words, F.lit(1), F.size(words) - n), " ").alias("project"), F.array_join(F.slice(words, F.size(words) - n + 1, n), " ").alias("document"))
        return F.when((F.size(words) > n) & F.element_at(words, -1).rlike("|".join(SLIDE_TITLE_KEYWORDS)), out)

    return let(F.split(line, " "), lambda words: let(of_words(words), lambda s: F.when((cover_line(s["project"]) != "") & (cover_line(s["document"]) != ""), F.struct(cover_line(s["project"]).alias("project"), cover_line(s["document"]).alias("document")))))


def slide_identities(shapes: DataFrame, keys: list[str], publishers: tuple[str, ...] = ()) -> DataFrame:
    """keys, project_title, document_title, document_number, preview_text; empty where the slide has none."""
    text = F.coalesce("text", F.lit(""))
    one = F.struct("y", "x", "pos", text.alias("text"), cover_line(text).alias("line"), "font_size")
    slides = shapes.groupBy(*keys).agg(F.sort_array(F.collect_list(one)).alias("_s"))
    slides = slides.withColumn("_s", F.filter("_s", lambda s: s["text"] != "")).withColumn("_t", title_shapes(F.col("_s"), publishers)).withColumn("_i", title_place(F.col("_t")))
    own = F.get("_t", F.col("_i"))
    slides = slides.withColumns({"_own": own, "_both": split_combined(own["line"])})
    above = F.filter("_t", lambda s: s["y"] < F.col("_own.y"))
    before = F.coalesce(F.try_element_at(above, F.lit(-1)), F.when(F.col("_i") > 0, F.get("_t", F.col("_i") - 1)))
    joined = F.array_join(F.transform("_s", lambda s: s["text"]), " ")
    numbers = F.regexp_extract(joined, NUMBER_AFTER_LABEL, 1), F.regexp_extract(joined, rf"\b{OUTPUT_ID}\b", 0)
    empty = F.lit("")
    return slides.select(
        *keys,
        F.coalesce("_both.project", before["line"], empty).alias("project_title"),
        F.coalesce("_both.document", "_own.line", empty).alias("document_title"),
        F.when(numbers[0] != "", cover_line(numbers[0])).otherwise(numbers[1]).alias("document_number"),
        F.array_join(F.transform("_s", lambda s: s["text"]), "\n").alias("preview_text"),
    )
