"""A hook for text completion: any callable from prompt to answer, run in Arrow batches; answers are checked, never trusted."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

ANSWER = StructType([StructField("text", StringType()), StructField("error", StringType())])


def completed(prompt: Column, ask: Callable[[str], str]) -> Column:
    """struct(text, error). A call that raises gives its error as data, so one bad answer can't end a job."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p in batch:
                try:
                    rows.append((None if p is None else ask(p), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["text", "error"], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, ANSWER)(prompt)


def json_object(answer: Column, schema: str) -> Column:
    """The object between the first and the last brace; null if there is none or it can't be parsed."""
    return F.from_json(F.nullif(F.regexp_extract(answer, r"(?s)(\{.*\})", 1), F.lit("")), schema, {"mode": "PERMISSIVE"})


def completion_limits(steps: Column, length: Column) -> Column:
    """Tokens and seconds by the size of a block."""
    limits = lambda t, s: F.struct(F.lit(t).alias("tokens"), F.lit(s).alias("seconds"))
    return F.when((steps >= 9) | (length >= 3000), limits(4096, 180)).when((steps >= 4) | (length >= 1500), limits(2048, 90)).otherwise(limits(1024, 60))


SELECTED = r'"selected"\s*:\s*\[([^\]]*)'


def selected_numbers(answer: Column) -> Column:
    """Sorted distinct numbers of the list "selected" of an answer, also a broken one; none if it holds names, or no list."""
    body = F.regexp_extract(F.coalesce(answer, F.lit("")), SELECTED, 1)
    numbers = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(body, F.lit(r"\b(\d+)\b"), F.lit(1)), lambda x: x.cast("bigint"))))
    return F.when(body.rlike('"[^"]+"'), F.array().cast("array<bigint>")).otherwise(numbers)


def selected_names(answer: Column) -> Column:
    """Names of the list "selected", in order."""
    return F.array_distinct(F.regexp_extract_all(F.regexp_extract(F.coalesce(answer, F.lit("")), SELECTED, 1), F.lit('"([^"]+)"'), F.lit(1)))
