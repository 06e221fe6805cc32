"""The best of many candidate titles for an expected one, with the exact gestalt ratio only where it can decide.

The ratio is 2 M / T, with M matched characters of T in both keys. M is at most the characters that both keys share as
multisets, and at least the common beginning or end. Bounds and the cheap scores (equal keys, one key in the other) are columns;
pairs whose upper bound is below the threshold, or below what another candidate surely reaches, are ruled out before any
ratio is computed.

Defined cases: null or empty titles and candidates without a key give nothing; of candidates with equal keys the first
counts; of equal scores the first wins; repeated rows change nothing; a group without a candidate at the threshold has no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import file_stem
from ..functions.similarity import TITLE_THRESHOLD, gestalt_ratio
from ..functions.titles import PROJECT_LABEL, nfkc, trimmed

# Fixed values.
LEAST_CONTAINED, CONTAINED = 6, 0.9
TITLE_EDGE = " -\t\r\n\"'`<>"
JUNK_FROM = 200  # from this length of the second key on, the ratio leaves frequent characters out, so only upper bounds hold


def clean_title(value: Column) -> Column:
    """Composed text, one space for white space, without a label and without quotes, brackets and hyphens at the ends."""
    strip = lambda x: trimmed(F.regexp_replace(x, r"(?U)\s+", " "), TITLE_EDGE)
    return strip(F.regexp_replace(strip(nfkc(F.coalesce(value, F.lit("")))), rf"\A{PROJECT_LABEL}\s*[:：]?\s*", ""))


def title_match_key(title: Column) -> Column:
    """Key of a clean title: no suffix, year or separator; letters, digits and Hangul."""
    text = F.when(F.contains(title, F.lit(".")), file_stem(title)).otherwise(title)
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"(?U)\b20\d{2}\s*년도?", ""), r"[^0-9A-Za-z가-힣]+", ""))


def shared_characters(a: Column, b: Column) -> Column:
    """Size of the multiset of characters that two strings share: at least what any matching can match."""
    times = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    return F.aggregate(F.array_distinct(F.split(a, "")), F.lit(0), lambda n, c: n + F.when(c == "", 0).otherwise(F.least(times(a, c), times(b, c))))


def common_edge(a: Column, b: Column) -> Column:
    """The longer of the common beginning and the common end."""

    def common(x: Column, y: Column) -> Column:
        lengths = F.sequence(F.lit(0), F.least(F.length(x), F.length(y)))
        return F.array_max(F.filter(lengths, lambda n: F.left(x, n) == F.left(y, n)))

    return F.greatest(common(a, b), common(F.reverse(a), F.reverse(b)))


def bounded_scores(pairs: DataFrame, candidate: str, expected: str) -> DataFrame:
    """pairs with _cheap (exact score where no ratio is needed), _upper and _lower, for keys that aren't empty."""
    c, e = F.col(candidate), F.col(expected)
    long_ = (F.length(c) >= LEAST_CONTAINED) & (F.length(e) >= LEAST_CONTAINED)
    cheap = F.when(c == e, 1.0).when(long_ & (F.contains(c, e) | F.contains(e, c)), CONTAINED)
    total = F.length(c) + F.length(e)
    upper = F.coalesce("_cheap", F.lit(2.0) * shared_characters(c, e) / total)
    lower = F.coalesce("_cheap", F.when(F.length(e) < JUNK_FROM, F.lit(2.0) * common_edge(c, e) / total).otherwise(0.0))
    return pairs.withColumn("_cheap", cheap).withColumns({"_upper": upper, "_lower": lower})


def contenders(candidates: DataFrame, expected: DataFrame, keys: list[str], threshold: float = TITLE_THRESHOLD) -> DataFrame:
    """keys, pos, value, _key, _expected, _cheap of the candidates that bounds don't rule out.

    candidates: keys, pos, title; expected: keys, expected_title, one row a group.
    """
    titles = candidates.select(*keys, "pos", clean_title(F.col("title")).alias("value")).withColumn("_key", title_match_key(F.col("value"))).where("value <> '' and _key <> ''")
    first = titles.groupBy(*keys, "_key").agg(F.min_by(F.struct("pos", "value"), "pos").alias("f")).select(*keys, "f.*", "_key")
    wanted = expected.select(*keys, title_match_key(clean_title(F.col("expected_title"))).alias("_expected")).where("_expected <> ''")
    pairs = bounded_scores(first.join(wanted, keys), "_key", "_expected").where(F.col("_upper") >= threshold)
    sure = pairs.groupBy(*keys).agg(F.max("_lower").alias("_sure"))
    return pairs.join(sure, keys).where(F.col("_upper") >= F.col("_sure")).drop("_upper", "_lower", "_sure")


def best_titles(candidates: DataFrame, expected: DataFrame, keys: list[str], threshold: float = TITLE_THRESHOLD) -> DataFrame:
    """keys, best_title, score: the best candidate of each group from the threshold on, the first of equals."""
    left = contenders(candidates, expected, keys, threshold)
    exact = left.where("_cheap is null").withColumn("score", gestalt_ratio(F.col("_key"), F.col("_expected")))
    scored = left.where("_cheap is not null").withColumn("score", F.col("_cheap")).unionByName(exact).where(F.col("score") >= threshold)
    best = scored.groupBy(*keys).agg(F.max_by(F.struct("value", "score"), F.struct("score", -F.col("pos"))).alias("b"))
    return best.select(*keys, F.col("b.value").alias("best_title"), F.col("b.score").alias("score"))
