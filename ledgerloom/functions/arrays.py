"""Path parts and other arrays as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def subpath_index(parts: Column, wanted: Column) -> Column:
    """Zero-based place of the first contiguous run `wanted` in `parts`; -1 without one or for an empty run."""
    starts = F.when(F.size(wanted).between(1, F.size(parts)), F.sequence(F.lit(1), F.size(parts) - F.size(wanted) + 1)).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.get(F.filter(starts, lambda i: F.slice(parts, i, F.size(wanted)) == wanted), 0) - 1, F.lit(-1))


def has_subpath(parts: Column, wanted: Column) -> Column:
    return subpath_index(parts, wanted) >= 0


def starts_with_parts(parts: Column, prefix: Column) -> Column:
    return F.slice(parts, F.lit(1), F.size(prefix)) == prefix


def ends_with_parts(parts: Column, suffix: Column) -> Column:
    return (F.size(suffix) <= F.size(parts)) & (F.reverse(F.slice(F.reverse(parts), F.lit(1), F.size(suffix))) == suffix)


def split_names(value: Column) -> Column:
    """Names of a cell: split on commas, semicolons, line ends, ampersands and the word and; trimmed, no empty ones, no repeats."""
    return F.array_distinct(F.filter(F.transform(F.split(value, r"(?i)[,;\n&＆]|\s+and\s+"), lambda x: F.trim(x)), lambda x: x != ""))


def missing_numbers(numbers: Column, upto: Column) -> Column:
    """Numbers of 1..upto that are not in the array, ascending."""
    return F.when(upto >= 1, F.array_sort(F.array_except(F.sequence(F.lit(1), upto), numbers))).otherwise(F.array().cast("array<int>"))


def column_number(ref: Column) -> Column:
    """A1-style reference to its column number: A is 1, AA is 27."""
    letters = F.upper(F.regexp_extract(ref, r"^([A-Za-z]+)", 1))
    return F.aggregate(F.filter(F.split(letters, ""), lambda c: c != ""), F.lit(0), lambda n, c: n * 26 + F.ascii(c) - 64)


def column_letters(number: Column) -> Column:
    """Column number to letters, up to three of them."""
    letter = lambda n: F.chr((n % 26 + 65).cast("bigint"))
    n = number - 1
    first, second = F.floor((n - 26 - 676) / 676), F.floor((n - 26) / 26)
    return (
        F.when(number <= 26, letter(n))
        .when(number <= 702, F.concat(letter(second), letter(n)))
        .otherwise(F.concat(letter(first), letter(F.floor((n - 702) / 26)), letter(n - 702)))
    )


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often body uses it. value holds no Python function."""
    return F.get(F.transform(F.array(value), body), 0)


def match_spans(text: Column, pattern: str) -> Column:
    """Array of struct start, end, match of all matches, from 0; none for null. pattern has no groups that capture.

    Offsets are summed by blocks of the square root of the number of matches, so long texts don't take its square.
    """
    matches = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    parts = F.arrays_zip(F.transform(F.split(text, pattern, -1), lambda g: F.length(g)).alias("gap"), matches.alias("match"))
    kind = "array<struct<start:int,end:int,match:string>>"
    empty = F.array().cast(kind)
    width = lambda p: p["gap"] + F.coalesce(F.length(p["match"]), F.lit(0))

    def step(state: Column, p: Column) -> Column:
        start, end = state["at"] + p["gap"], state["at"] + width(p)
        span = F.struct(start.alias("start"), end.alias("end"), p["match"].alias("match"))
        return F.struct(end.alias("at"), F.when(p["match"].isNotNull(), F.concat(state["found"], F.array(span))).otherwise(state["found"]).alias("found"))

    def by_blocks(parts: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(parts))).cast("int")
        return let(F.transform(F.sequence(F.lit(0), ((F.size(parts) - 1) / size).cast("int")), lambda b: F.slice(parts, b * size + 1, size)), placed)

    def placed(blocks: Column) -> Column:
        widths = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda n, p: n + width(p)))
        starts = F.aggregate(widths, F.array(F.lit(0)), lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n)))
        return F.flatten(F.zip_with(blocks, F.slice(starts, F.lit(1), F.size(blocks)), lambda block, at: F.aggregate(block, F.struct(at.alias("at"), empty.alias("found")), step, lambda state: state["found"])))

    return F.when(text.rlike(pattern), let(parts, by_blocks)).otherwise(empty)
