"""Quality rules by document and by host.

Every document gets counts over its whole text and a vector of rule failures. Failures are summed by host, each host's
failure rate is shrunk towards an empirical beta prior fitted over all hosts (method of moments), and the verdicts are
joined back: in a host that a rule condemns, the documents that fail that rule go; everywhere, documents that fail the
base limits go. Clean documents of a condemned host stay.

Defined cases: null or empty text has zero words and fails the base; a null host is a host of its own; null ids are kept; repeated rows each
count and each get a row; an empty table gives an empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialise, words_of

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Soft rules: name -> failure over the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.
RULES = {
    "short": lambda c: c("n_words") < 40,
    "long_words": lambda c: c("word_chars") > 14 * c("n_words"),
    "short_words": lambda c: 2 * c("word_chars") < 5 * c("n_words"),
    "symbols": lambda c: 5 * c("n_symbols") > c("n_words"),
    "dup_lines": lambda c: 10 * c("n_dup_lines") > c("n_words"),
    "repeats": lambda c: 5 * c("n_repeat_words") > c("n_words"),
}
MAX_HOST_RATE = 0.5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(words: Column) -> Column:
    """Words inside 8-word windows that the text holds twice or more, the first occurrence included."""

    def covered(at: Column) -> Column:  # starts of repeated windows, ascending; each covers up to the next start
        return F.aggregate(
            F.transform(at, lambda p, j: F.least(F.coalesce(F.get(at, j + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)).cast("long")),
            F.lit(0).cast("long"),
            lambda total, x: total + x,
        )

    def repeated(sorted_: Column) -> Column:
        same = lambda e, other: F.coalesce(e["h"] == other["h"], F.lit(False))
        flagged = F.filter(sorted_, lambda e, j: same(e, F.get(sorted_, j - 1)) | same(e, F.get(sorted_, j + 1)))
        return let(F.array_sort(F.transform(flagged, lambda e: e["i"])), covered)

    def widened(by: int):  # hashes of i words starting at each word become hashes of i + by words
        return lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + by)))

    def windows(hashes: Column) -> Column:
        wide = let(let(widened(1)(hashes), widened(2)), widened(4))  # the last 7 are cut short
        return let(F.slice(wide, F.lit(1), F.size(hashes) - (WINDOW - 1)), any_repeat)

    def any_repeat(h: Column) -> Column:
        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(F.array_sort(pairs), repeated)).otherwise(F.lit(0).cast("long"))

    return F.when(F.size(words) > WINDOW, let(F.transform(words, lambda w: F.xxhash64(w)), windows)).otherwise(F.lit(0).cast("long"))


def document_counts(docs: DataFrame, id_col: str, text_col: str, host_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document with the counts of COUNTS (long)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col), F.col(host_col).alias("_host"), *keep, text.alias("_text"), words_of(text).alias("_words"))
    n_words = F.size("_words").cast("long")
    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return own.select(
        id_col,
        "_host",
        *keep,
        n_words.alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        repeat_words(F.col("_words")).alias("n_repeat_words"),
    )


def host_rates(failures: DataFrame, rules: dict) -> DataFrame:
    """Host verdicts: per rule the failure rate shrunk by a beta prior whose mean and weight come from all hosts."""
    sums = failures.groupBy("_host").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"f_{r}").cast("long")).alias(r) for r in rules])
    prior = sums.agg(*[x for r in rules for x in (F.avg(F.col(r) / F.col("n")).alias(f"m_{r}"), F.var_samp(F.col(r) / F.col("n")).alias(f"v_{r}"))]).first()
    out = sums
    for r in rules:
        m, v = (F.lit(prior[f"{x}_{r}"]).cast("double") for x in "mv")
        # weight of the prior in documents; hosts that all agree (variance 0 or one host) tell nothing, then one document
        weight = F.greatest(F.coalesce(F.when(v > 0, m * (1 - m) / v - 1), F.lit(1.0)), F.lit(1.0))
        out = out.withColumn(f"rate_{r}", (F.col(r) + m * weight) / (F.col("n") + weight))
    return out.select("_host", *[f"rate_{r}" for r in rules])


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", keep: tuple[str, ...] = (), rules: dict | None = None, max_host_rate: float = MAX_HOST_RATE
) -> DataFrame:
    """docs' ids with COUNTS, base_failed, host_failed and kept. keep: further columns of docs to carry along."""
    rules = RULES if rules is None else rules
    counts = document_counts(docs, id_col, text_col, host_col, keep)
    for r, failed in rules.items():
        counts = counts.withColumn(f"f_{r}", failed(F.col))
    counts = materialise(counts)  # the texts are read once; hosts and documents both start from these few numbers
    hosts = host_rates(counts, rules)
    joined = counts.alias("d").join(hosts.withColumnRenamed("_host", "_h"), F.col("_host").eqNullSafe(F.col("_h")))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    host = F.lit(False)
    for r in rules:
        host = host | (F.col(f"f_{r}") & (F.col(f"rate_{r}") > max_host_rate))
    return joined.select(id_col, *keep, *COUNTS, base.alias("base_failed"), host.alias("host_failed"), (~(base | host)).alias("kept"))
