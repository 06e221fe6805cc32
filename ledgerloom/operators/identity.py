"""What a document is: project and document title out of its first lines.

Lines are an array of a text's lines without noise; nothing is exploded and nothing shuffled. A null text has no lines;
an empty string stands for "not found"; of several candidates the first counts; very long lines are no cover values.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.titles import DOCUMENT_LABEL, OUTPUT_ID, PROJECT_LABEL, composed_key, composed_text, document_title, has_title_keyword, head_before_metadata, project_and_document, project_title

# Fixed values.
NOISE_PREFIXES = ("식품의약품안전처", "개 정 이 력", "개정 이력", "<목 차>", "&lt;목 차&gt;")
METADATA_LABEL = r"^(?:문서번호|문서버전|개정일자|작성자|버전|개정사유|개정내역|승인)(?:\s|$)"
LINE_END = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x85  ]"


def decoded(text: Column) -> Column:
    """Character references resolved and characters composed, line by line; plain ASCII goes to Python as null."""

    def decode(values: pd.Series) -> pd.Series:
        import unicodedata
        from html import unescape

        lines = lambda t: "\n".join(unicodedata.normalize("NFKC", " ".join(unescape(x).splitlines())) for x in t.splitlines())
        return values.map(lambda t: None if t is None else lines(t))

    special = (F.octet_length(text) != F.length(text)) | F.contains(text, F.lit("&"))
    return F.coalesce(F.pandas_udf(decode, StringType()).asNondeterministic()(F.when(special, text)), text)  # so that it stays a column of its own


def clean_line(line: Column) -> Column:
    """A decoded line; if it has fields in angle brackets, only these."""
    fields = F.filter(F.transform(F.regexp_extract_all(line, F.lit(r"<([^<>]*)>"), F.lit(1)), composed_text), lambda x: x != "")
    return F.trim(composed_text(F.when(F.size(fields) > 0, F.array_join(fields, " ")).otherwise(line)), F.lit("<>"))


def starts_with_any(value: Column, prefixes: tuple[str, ...]) -> Column:
    test = F.lit(False)
    for p in prefixes:
        test = test | F.startswith(value, F.lit(p))
    return test


def is_noise(line: Column) -> Column:
    """Brackets, up to twelve CJK ideographs, or nothing that can be read."""
    return line.rlike(r"\A[<>]+\z") | line.rlike(r"\A[一-鿿]{1,12}\z") | ~line.rlike("[가-힣A-Za-z0-9]")


def meaningful_lines(df: DataFrame, text: str, out: str = "lines") -> DataFrame:
    """Adds an array: cleaned lines without empty ones, noise prefixes, numbers and dates alone, and noise. No limit on length."""
    lines = F.transform(F.split(F.coalesce("_decoded", F.lit("")), LINE_END), clean_line)
    kept = F.filter(lines, lambda x: (x != "") & ~starts_with_any(x, NOISE_PREFIXES) & ~x.rlike(r"\A[\d.\-_/()'\"]+\z") & ~is_noise(x))
    return df.withColumn("_decoded", decoded(F.col(text))).withColumn(out, kept).drop("_decoded")


def is_cover_value(line: Column) -> Column:
    """A line that can be a title: up to 120 characters, no id, label, company or noise."""
    company = starts_with_any(line, ("(주)", "㈜"))
    return (line != "") & (F.length(line) <= 120) & ~line.rlike(rf"\A{OUTPUT_ID}\z") & ~starts_with_any(line, NOISE_PREFIXES) & ~line.rlike(METADATA_LABEL) & ~company & ~is_noise(line)


def both(project: Column, document: Column) -> Column:
    return F.struct(project.alias("project"), document.alias("document"))


def neither() -> Column:
    return both(F.lit(""), F.lit(""))


def places_of(lines: Column, test) -> Column:
    """Places (from 0) of the lines that pass the test."""
    return F.filter(F.transform(lines, lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull())


def cover_titles(lines: Column) -> Column:
    """The first two cover values, if both stand before a document number line or among the first eight lines."""
    places = places_of(lines, is_cover_value)
    second = F.get(places, 1)
    number = F.array_max(places_of(lines, lambda x: F.startswith(x, F.lit("문서번호"))))
    found = both(project_title(F.get(lines, F.get(places, 0))), document_title(F.get(lines, second)))
    return F.when((second < number) | (second < 8), found).otherwise(neither())


def labelled(lines: Column, label: str, clean) -> Column:
    """What stands behind the first label and colon, or on the line below a bare label."""
    inline = rf"{label}\s*[:：]\s*(.+)"
    value = F.transform(lines, lambda x, i: F.when(x.rlike(inline), F.regexp_extract(x, inline, 1)).when(x.rlike(rf"\A{label}\z"), F.get(lines, i + 1)))
    return F.coalesce(clean(F.get(F.filter(value, lambda v: v.isNotNull()), 0)), F.lit(""))


def combined_titles(lines: Column) -> Column:
    """Project and document title of the first of twenty lines that holds both."""
    heads = F.transform(F.slice(lines, F.lit(1), F.lit(20)), lambda x: project_and_document(head_before_metadata(x)))
    return F.coalesce(F.get(F.filter(heads, lambda h: h.isNotNull()), 0), neither())


def keyword_title(lines: Column) -> Column:
    """The first of forty lines that is a cover value with a title keyword."""
    return F.coalesce(document_title(F.get(F.filter(F.slice(lines, F.lit(1), F.lit(40)), lambda x: is_cover_value(x) & has_title_keyword(x)), 0)), F.lit(""))


def project_near(lines: Column, document: Column) -> Column:
    """The nearest of the four lines above the document's title that is short and no title itself."""
    key = composed_key(document)
    above = lambda i: F.reverse(F.slice(lines, F.greatest(i - 3, F.lit(1)), F.least(i, F.lit(4))))
    fits = lambda i: F.get(F.filter(above(i), lambda x: ~has_title_keyword(x) & (F.length(x) <= 120)), 0)
    found = F.transform(F.filter(places_of(lines, lambda x: composed_key(x) == key), lambda i: i > 0), fits)
    return F.when(document != "", F.coalesce(project_title(F.get(F.filter(found, lambda x: x.isNotNull()), 0)), F.lit(""))).otherwise("")


def rule_titles(text: Column) -> Column:
    """The two lines above a bare document number label, else the first two lines."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), LINE_END), lambda x: F.trim(F.trim(x), F.lit("\"'`<>")))
    lines = F.filter(lines, lambda x: (x != "") & ~starts_with_any(x, ("식품의약품안전처", "㈜", "개 정 이 력", "<목 차>", "&lt;목 차&gt;")))
    at = F.get(F.filter(places_of(lines, lambda x: x == "문서번호"), lambda i: i >= 2), 0)
    pair = lambda i, j: both(F.get(lines, i), F.get(lines, j))
    return F.when(at.isNotNull(), pair(at - 2, at - 1)).when(F.size(lines) >= 2, pair(F.lit(0), F.lit(1))).otherwise(neither())


def first_filled(*values: Column) -> Column:
    return F.coalesce(*[F.when(v != "", v) for v in values], F.lit(""))


def cover_identities(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, project, document: by label, cover, combined line, rule; a document also by keyword, a project by nearness."""
    lines = F.col("_lines")
    valid = lambda x: F.when(is_cover_value(x), x).otherwise("")
    own = df.select(*keys, F.left(text, F.lit(8000)).alias("_head"), rule_titles(F.col(text)).alias("_rule"))
    own = meaningful_lines(own, "_head", "_lines").withColumns({"_cover": cover_titles(lines), "_combined": combined_titles(lines)})
    document = first_filled(labelled(lines, DOCUMENT_LABEL, document_title), F.col("_cover.document"), F.col("_combined.document"), valid(document_title(F.col("_rule.document"))), keyword_title(lines))
    project = first_filled(labelled(lines, PROJECT_LABEL, project_title), F.col("_cover.project"), F.col("_combined.project"), valid(project_title(F.col("_rule.project"))))
    own = own.withColumns({"project": project, "document": document})
    return own.select(*keys, first_filled(F.col("project"), project_near(lines, F.col("document"))).alias("project"), "document")


def standard_project_title(lines: Column, marker: str = "문서관리표준") -> Column:
    """The project of a standard: before the marker on its line, else the line above, else behind the marker; else by label."""
    filled = lambda x: F.when(F.trim(x) != "", x)
    at = lambda x: F.instr(x, F.lit(marker))
    near = lambda x, i: F.coalesce(filled(F.substring(x, F.lit(1), at(x) - 1)), F.when(i > 0, F.get(lines, i - 1)), filled(F.substring(x, at(x) + len(marker), F.length(x))))
    marked = F.filter(F.transform(lines, lambda x, i: F.when(at(x) > 0, near(x, i))), lambda x: x.isNotNull())
    label = r"(?:사업명|프로젝트\s*명)\s*[:：]?\s*(.+)"
    labels = F.filter(F.transform(lines, lambda x: F.when(x.rlike(label), F.regexp_extract(x, label, 1))), lambda x: x.isNotNull())
    return F.coalesce(project_title(F.get(marked, 0)), project_title(F.get(labels, 0)), F.lit(""))
