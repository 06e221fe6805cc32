"""Labels, identifiers and file names as column expressions; null in, null out.

All stay in codegen but nfkc_fold, an Arrow function to which ASCII values go as nulls. Keys of names and titles are in
`titles`.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def nfkc_fold(value: Column) -> Column:
    """NFKC and case folding, which Spark SQL lacks; the function travels with the plan."""

    def fold(values: pd.Series) -> pd.Series:
        import unicodedata

        return values.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())

    return F.pandas_udf(fold, StringType())(value)


def folded(value: Column) -> Column:
    """Case-folded compatibility form."""
    return F.coalesce(nfkc_fold(F.when(F.octet_length(value) != F.length(value), value)), F.lower(value))


def compact_space(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"(?U)\s+", " "))


def label_key(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)\s+", "")


def separator_key(value: Column) -> Column:
    """Without white space, underscores, hyphens, dots and brackets; lower case; other symbols stay."""
    return F.lower(F.regexp_replace(value, r"[\s_\-.()\[\]{}]+", ""))


def identifier_key(value: Column) -> Column:
    return F.lower(F.regexp_replace(value, r"[^0-9A-Za-z가-힣]+", ""))


def sheet_title(value: Column, default: str = "sheet") -> Column:
    """At most the 31 characters that a sheet name may have."""
    clean = F.left(F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"[\\/*?:\[\]]", "_")), F.lit(31))
    return F.when(clean == "", F.lit(default)).otherwise(clean)


def without_sequence_marker(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(value, r"^\s*\d+\s*[.)]\s*", ""), r"^\s*[①-⑳]\s*", ""))


def without_tags(value: Column) -> Column:
    return compact_space(F.regexp_replace(value, r"<[^>]*>", " "))


def last_part(title: Column, fallback: Column, separator: str = " - ") -> Column:
    return F.when(F.contains(title, F.lit(separator)), F.trim(F.substring_index(title, separator, -1))).otherwise(fallback)


def hidden_urls(value: Column) -> Column:
    return F.regexp_replace(value, r"https?://[^\s\"'<>]+", "[hidden-url]")


def id_shape(value: Column) -> Column:
    """Segments of an id as N (digits), A (letters) or X (mixed)."""
    kind = lambda s: F.when(s.rlike(r"^\d+$"), "N").when(s.rlike(r"^[A-Za-z]+$"), "A").otherwise("X")
    return F.array_join(F.transform(F.split(value, "-"), kind), "-")


def last_number(value: Column) -> Column:
    """Last segment of digits, null if there is none."""
    return F.try_element_at(F.filter(F.split(value, "-"), lambda s: s.rlike(r"^\d+$")), F.lit(-1))


def prefix_related(a: Column, b: Column) -> Column:
    return F.startswith(a, F.concat(b, F.lit("-"))) | F.startswith(b, F.concat(a, F.lit("-")))


def all_ids(value: Column, pattern: str) -> Column:
    """All ids in upper case, first occurrence first, without repeats."""
    return F.array_distinct(F.transform(F.regexp_extract_all(value, F.lit(pattern), F.lit(0)), lambda x: F.upper(x)))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_suffix(path: Column) -> Column:
    """Last suffix with its dot; a name that begins with its only dot has none."""
    return F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def render_tokens(template: Column, values: dict[str, Column], unknown: str | None = "") -> Column:
    """{{NAME}} replaced in one pass: values are not searched again. unknown None leaves unknown tokens as they stand."""
    gaps = F.split(template, r"\{\{\s*[A-Z0-9_]+\s*\}\}", -1)
    tokens = F.regexp_extract_all(template, F.lit(r"\{\{\s*[A-Z0-9_]+\s*\}\}"), F.lit(0))
    table = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])

    def value_of(token: Column) -> Column:
        name = F.regexp_replace(token, r"[{}\s]+", "")
        return F.coalesce(F.try_element_at(table, name), token if unknown is None else F.lit(unknown))

    return F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(F.transform(tokens, value_of), i), F.lit("")))), "")
