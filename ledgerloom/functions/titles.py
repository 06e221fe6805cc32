"""Names, titles and output ids as column expressions.

Null in, null out, unless a function says otherwise. All stay in codegen but `nfkc`, an Arrow function to which ASCII
values go as nulls; functions of composed values do without it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .arrays import let

# Fixed values.
DOCUMENT_SUFFIXES = ("hwp", "hwpx", "doc", "docx", "docm", "ppt", "pptx", "pptm", "xls", "xlsx", "xlsm", "pdf", "txt", "csv", "zip")
VERSION = r"[_-]?[vV]\d+(?:\.\d+)*"
REQUIREMENT = r"(?i)SFR-[A-Za-z0-9-]+"
OUTPUT_ID = r"(?:MFDS-\d{3,6}|[A-Za-z]{2,10}(?:-[A-Za-z0-9]{1,12})*-\d{2})"
NUMBER_ID = r"\d{4,}(?:\([^)]*\))?"
ID_IN_NAME = OUTPUT_ID + r"(?:-[가-힣A-Za-z0-9()]+)?(?![A-Za-z0-9])"
ATTACHMENT_IN_BRACKETS = r"[\s_-]*[\[\(（［｛]\s*(?:별첨|첨부)\s*\d*[^)\]\}）］｝]*[\)\]\}）］｝].*$"
ATTACHMENT_WORD = r"[\s_-]*(?:별첨|첨부)\s*\d+.*$"
PARENTHESES = r"\([^()]*\)|（[^（）]*）"
UNSAFE_IN_FILE_NAMES = r'[<>:"/\\|?*\x00-\x1f]+'
TITLE_KEYWORDS = ("계획서", "결과서", "정의서", "시나리오", "케이스", "매뉴얼", "보고서", "대장", "목록", "추적표", "회의록", "WBS")
PROJECT_LABEL = r"(?:사업명|프로젝트\s*명|프로젝트\s*제목)"
DOCUMENT_LABEL = r"(?:문서명|문서\s*제목|파일\s*제목)"
METADATA_MARKERS = ("문서번호", "문서버전", "Version", "개정일자", "작성자")

EDGE = " -\t\r\n"
NAME_EDGE = " -_\t\r\n"


def nfkc(value: Column) -> Column:
    """Compatibility composition, which Spark SQL lacks; the function travels with the plan."""

    def compose(values: pd.Series) -> pd.Series:
        import unicodedata

        return values.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return F.coalesce(F.pandas_udf(compose, StringType())(F.when(F.octet_length(value) != F.length(value), value)), value)


def trimmed(value: Column, chars: str = EDGE) -> Column:
    return F.trim(value, F.lit(chars))


def composed_text(value: Column) -> Column:
    """clean_text of a value that is composed already; usable inside lambdas."""
    return trimmed(F.regexp_replace(F.replace(value, F.lit("⦁"), F.lit(" ")), r"(?U)\s+", " "))


def clean_text(value: Column) -> Column:
    """Composed, bullets as spaces, one space for any white space, no spaces or hyphens at the ends."""
    return composed_text(nfkc(value))


def without_document_suffix(value: Column) -> Column:
    """The file name's stem if it ends in a document suffix; else the value as it is."""
    return F.regexp_replace(value, rf"(?i)\A(?:[^\n\r]*/)?([^/\n\r]+)\.(?:{'|'.join(DOCUMENT_SUFFIXES)})\s*\z", "$1")


def composed_key(value: Column) -> Column:
    """name_key of a value that is composed already; usable inside lambdas."""
    name = F.regexp_replace(F.regexp_replace(without_document_suffix(value), VERSION, ""), REQUIREMENT, "")
    return F.lower(F.regexp_replace(F.replace(name, F.lit("테스트"), F.lit("시험")), r"[^0-9A-Za-z가-힣]+", ""))


def name_key(value: Column) -> Column:
    """Key for comparing names: no document suffix, version, requirement id or separators; letters, digits and Hangul."""
    return composed_key(nfkc(value))


def without_attachment_tail(value: Column) -> Column:
    """The stem without an attachment note, bracketed or not, and all behind it."""
    stem = without_document_suffix(value)
    bracketed, word = (trimmed(F.regexp_replace(stem, "(?i)" + p, ""), NAME_EDGE) for p in (ATTACHMENT_IN_BRACKETS, ATTACHMENT_WORD))
    return F.when(bracketed != stem, bracketed).otherwise(word)


def without_parentheses(value: Column) -> Column:
    """Parentheses become a space, the innermost first, as often as there are any: nesting of any depth goes."""
    times = lambda x: F.length(x) - F.length(F.regexp_replace(x, "[(（]", ""))
    bare = let(value, lambda x: F.aggregate(F.sequence(F.lit(1), times(x)), x, lambda out, _: F.regexp_replace(out, PARENTHESES, " ")))
    return F.when(value.rlike("[(（]"), bare).otherwise(value)


def id_and_name(value: Column) -> tuple[Column, Column]:
    """Id and name of "ID-name"; the whole text and "" if what stands before the last hyphen is no id."""
    text = trimmed(value)
    before, name = trimmed(F.regexp_extract(text, r"(?s)\A(.*)-([^-]*)\z", 1)), trimmed(F.regexp_extract(text, r"(?s)\A(.*)-([^-]*)\z", 2))
    splits = F.contains(text, F.lit("-")) & ~name.rlike(r"\A\d+\z") & before.rlike(rf"\A(?:{OUTPUT_ID}|{NUMBER_ID})\z")
    return F.when(splits, before).otherwise(text), F.when(splits, name).otherwise(F.lit(""))


def id_prefix(output_id: Column) -> Column:
    prefix = id_and_name(clean_text(output_id))[0]
    return F.when(prefix == "", output_id).otherwise(prefix)


def name_in_id(output_id: Column) -> Column:
    return trimmed(id_and_name(clean_text(output_id))[1])


def without_leading_ids(value: Column) -> Column:
    """No output ids or numbers of up to six digits at the start."""
    return trimmed(F.regexp_replace(trimmed(value, NAME_EDGE), rf"(?i)\A(?:\s*(?:{OUTPUT_ID}|\d{{1,6}})[\s_-]*)+", ""), NAME_EDGE)


def keys_of(*values: Column) -> Column:
    """Keys of composed values, each with and without parenthetical content; distinct, without empty ones, in order."""
    return F.array_distinct(F.filter(F.array(*[composed_key(v) for x in values for v in (x, without_parentheses(x))]), lambda k: k != ""))


def title_key(value: Column) -> Column:
    return composed_key(without_parentheses(nfkc(value)))


def safe_stem(value: Column, default: str = "renamed_output") -> Column:
    """A cleaned file name without characters that file systems refuse."""
    clean = F.trim(F.regexp_replace(clean_text(value), UNSAFE_IN_FILE_NAMES, "_"), F.lit(" ._"))
    return F.when(clean == "", F.lit(default)).otherwise(clean)


def project_title(value: Column) -> Column:
    """A composed project title without its label."""
    return F.trim(F.regexp_replace(composed_text(value), rf"\A{PROJECT_LABEL}\s*[:：]?\s*", ""), F.lit(" -"))


def document_title(value: Column) -> Column:
    """A composed document title without its label."""
    return F.trim(F.regexp_replace(composed_text(value), rf"\A(?:{DOCUMENT_LABEL}|제목)\s*[:：]?\s*", ""), F.lit(" -"))


def has_title_keyword(value: Column) -> Column:
    return value.rlike("|".join(TITLE_KEYWORDS))


def head_before_metadata(value: Column) -> Column:
    """A composed line up to the first marker, in the markers' order, that stands behind its start."""

    def head(text: Column) -> Column:
        out = text
        for marker in reversed(METADATA_MARKERS):
            out = F.when(F.instr(text, F.lit(marker)) > 1, F.substring(text, F.lit(1), F.instr(text, F.lit(marker)) - 1)).otherwise(out)
        return composed_text(out)

    return let(composed_text(value), head)


def project_and_document(value: Column) -> Column:
    """Struct project, document of "project document": the shortest tail of words with a title keyword; null if there is none.

    A manual keeps the word before it that says whose it is.
    """

    def cuts(parts: Column) -> Column:
        def cut(i: Column) -> Column:
            manual = (F.element_at(parts, -1) == "매뉴얼") & F.get(parts, i - 1).isin("사용자", "운영자", "관리자")
            return let(F.when(manual, i - 1).otherwise(i), at_place)

        def at_place(at: Column) -> Column:
            project = F.when(at > 0, F.array_join(F.slice(parts, F.lit(1), at), " ")).otherwise("")
            return F.struct(project_title(project).alias("project"), document_title(F.array_join(F.slice(parts, at + 1, F.size(parts)), " ")).alias("document"))

        places = F.when(F.size(parts) > 1, F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
        return F.get(F.filter(F.transform(places, cut), lambda c: (c["project"] != "") & has_title_keyword(c["document"])), 0)

    return let(F.split(composed_text(value), " "), cuts)


def first_output_id(value: Column) -> Column:
    return F.regexp_extract(value, rf"\b{OUTPUT_ID}\b", 0)


def slide_name(value: Column) -> Column:
    """A file name without output ids, leading numbers, dates and versions."""
    text = clean_text(value)
    for noise in (rf"\b{OUTPUT_ID}\b", r"\A\d{4,}(?:\([^)]*\))?\s*[-_]\s*", r"\([^)]*(?:\d{2,4}[./년-]\s*\d{1,2}|\d{6,8})[^)]*\)", r"[_-][vV]\d+(?:\.\d+)*\b", r"\b\d{6,8}\b"):
        text = F.regexp_replace(text, noise, " ")
    return composed_text(text)


def safe_relative_path(path: Column, fallback: str = "file") -> Column:
    """A relative path without empty, . and .. parts and without characters that file systems refuse; null gives the fallback."""
    parts = F.split(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")), "/")
    kept = F.filter(parts, lambda p: (F.trim(p) != "") & ~p.isin(".", ".."))
    safe = F.array_join(F.transform(kept, lambda p: F.regexp_replace(F.trim(p), UNSAFE_IN_FILE_NAMES, "_")), "/")
    return F.when(F.size(kept) > 0, safe).otherwise(fallback)
