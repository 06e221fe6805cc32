"""Test cases out of answers: JSON of any shape parsed as variants, checked, and projected to the fixed columns.

A broken answer is one row with its error and no case, never a null that nobody sees: no object, no list of cases, a list
that is none, or a case that is no object (the whole answer then counts as broken, as its numbering can't be trusted). One
object instead of a list is a list of one; an empty list gives no row. Missing values and nulls are empty; numbers and
nested values become their JSON text. Null answers and answers with a key twice are broken; repeated rows are answers each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import without_sequence_marker
from .checks import is_bad_title

# Columns of a case, in order.
CASE_COLUMNS = ("단위시험_ID", "화면명", "수행자", "단위시험_명", "수행_일자", "사전조건", "화면_ID", "순서", "테스트_케이스", "테스트_데이터", "예상_결과", "수행_결과")
NO_OBJECT, NO_CASES, NO_LIST, BAD_CASE = "the answer is no JSON object", "no key test_cases", "test_cases is no list", "case {} is no object"


def kind_of(value: Column) -> Column:
    """OBJECT, ARRAY or the name of a plain type."""
    return F.regexp_extract(F.schema_of_variant(value), r"\A(\w+)", 1)


def checked_cases(answer: Column) -> Column:
    """Struct cases (array of variants), error."""
    whole = F.try_parse_json(F.nullif(F.regexp_extract(F.coalesce(answer, F.lit("")), r"(?s)(\{.*\})", 1), F.lit("")))
    held = F.try_variant_get(whole, "$.test_cases", "variant")
    cases = F.when(kind_of(held) == "OBJECT", F.array(held)).otherwise(F.try_variant_get(held, "$", "array<variant>"))
    bad = F.array_position(F.transform(cases, lambda c: (F.coalesce(kind_of(c), F.lit("VOID")) != "OBJECT").cast("int")), 1)
    error = F.when(whole.isNull(), NO_OBJECT).when(held.isNull(), NO_CASES).when(cases.isNull(), NO_LIST).when(bad > 0, F.format_string(BAD_CASE.replace("{}", "%d"), bad))
    return F.struct(F.when(error.isNull(), cases).alias("cases"), error.alias("error"))


def test_cases(answers: DataFrame, keys: list[str], answer: str, screen_id: Column, unit_test_id: Column, screen_name: Column | None = None, title: Column | None = None) -> DataFrame:
    """keys, pos (from 1), the columns of a case, 단위시험_제목 and error: a row for each case, and one for each broken answer.

    Ids that are given take the place of the answer's; markers before steps and results go; data are empty; the screen's name
    stands for a bad name, the title (else the screen's name) for both titles; a case without a number gets its place.
    """
    given = {"_screen": screen_id, "_unit": unit_test_id, "_name": screen_name if screen_name is not None else F.lit(""), "_title": title if title is not None else F.lit("")}
    rows = answers.withColumns({k: F.coalesce(v, F.lit("")) for k, v in given.items()} | {"_c": checked_cases(F.col(answer))})
    one = F.when(F.col("_c.error").isNull(), F.col("_c.cases")).otherwise(F.array(F.lit(None).cast("variant")))
    each = rows.select(*keys, *given, F.col("_c.error").alias("error"), F.posexplode(one).alias("_pos", "_case"))
    own = {k: F.coalesce(F.try_variant_get("_case", f"$['{k}']", "string"), F.lit("")) for k in CASE_COLUMNS}
    each = each.withColumns({f"_{i}": v for i, v in enumerate(own.values())})
    value = {k: F.col(f"_{i}") for i, k in enumerate(CASE_COLUMNS)}
    name, heading = F.col("_name"), F.when(F.col("_title") != "", F.col("_title")).otherwise(F.col("_name"))
    screen = F.when(F.col("_screen") != "", F.col("_screen")).otherwise(value["화면_ID"])
    unit = F.when(F.col("_unit") != "", F.col("_unit")).otherwise(value["단위시험_ID"])
    fixed = value | {
        "화면_ID": screen,
        "단위시험_ID": unit,
        "테스트_데이터": F.lit(""),
        "테스트_케이스": without_sequence_marker(value["테스트_케이스"]),
        "예상_결과": without_sequence_marker(value["예상_결과"]),
        "화면명": F.when((name != "") & is_bad_title(value["화면명"], F.col("_screen"), F.col("_unit")), name).otherwise(value["화면명"]),
        "단위시험_명": F.when(heading != "", heading).otherwise(value["단위시험_명"]),
        "순서": F.when(value["순서"].isin("", "0", "false"), (F.col("_pos") + 1).cast("string")).otherwise(value["순서"]),
    }
    good = F.col("error").isNull()
    return each.select(*keys, F.when(good, F.col("_pos") + 1).alias("pos"), *[F.when(good, fixed[k]).alias(k) for k in CASE_COLUMNS], F.when(good, heading).alias("단위시험_제목"), "error")
