"""Matching names and texts: containment, scores, priorities and fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scores of the rule ladder, highest rule first.
TITLE_EQUAL, NAME_EQUAL, TITLE_HOLDS, NAME_HOLDS, PREVIEW_HOLDS, ALIAS_HOLDS = 1.00, 0.97, 0.96, 0.94, 0.90, 0.86


def containment_join(texts: DataFrame, text: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """Pairs where the text holds the pattern, by an equi-join on the pattern's longest inner word.

    A text that holds a pattern holds the pattern's inner words as whole words, so one of them finds all candidates; there
    is no nested loop. Words go to the join with a hash of their text only; texts are fetched for the hits. Patterns of under three words have no inner word; their first three characters (all, if there are
    fewer) stand somewhere in the text and find the candidates. An empty pattern is in every text.
    """
    words = F.split(pattern, " ")
    inner = F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))
    longest = F.get(F.transform(F.array_sort(F.transform(inner, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda s: s["w"]), 0)
    anchored = patterns.select(pattern, longest.alias("_anchor")).where(F.col("_anchor").isNotNull()).distinct()
    own = texts.select(text).where(F.col(text).isNotNull()).distinct()
    found = own.withColumn("_hash", F.xxhash64(text)).select("_hash", F.explode(F.array_distinct(F.split(text, " "))).alias("_anchor")).join(anchored, "_anchor").select("_hash", pattern)
    short = patterns.where(F.col(pattern).isNotNull() & longest.isNull()).select(pattern, F.left(pattern, F.lit(3)).alias("_anchor")).distinct()
    for n in sorted(r[0] for r in short.select(F.length("_anchor")).distinct().collect()):  # at most 0, 1, 2, 3
        last = F.greatest(F.length(text) - (n - 1), F.lit(1))
        grams = F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(F.col(text), i, F.lit(n)))) if n else F.array(F.lit(""))  # noqa: B023
        held = own.withColumn("_hash", F.xxhash64(text)).select("_hash", F.explode(grams).alias("_anchor"))
        found = found.unionByName(held.join(short.where(F.length("_anchor") == n), "_anchor").select("_hash", pattern))
    hits = found.distinct().withColumnRenamed(pattern, "_pattern")
    pairs = texts.withColumn("_hash", F.xxhash64(text)).join(hits, "_hash").where(F.contains(F.col(text), F.col("_pattern")))
    return pairs.join(patterns.withColumn("_pattern", F.col(pattern)), "_pattern").drop("_pattern", "_hash")


def longest_match(pairs: DataFrame, keys: list[str], length: Column, order: list[Column]) -> DataFrame:
    """Of a key's matches the longest, then the first."""
    return pairs.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(length.desc(), *order))).where("_r = 1").drop("_r")


def name_score(title: Column, name: Column, preview: Column, alias: Column) -> Column:
    """Score of one alias; null if the name shares nothing with it or no rule holds."""
    shares = F.contains(name, alias) | ((F.length(name) >= 4) & F.contains(alias, name))
    ladder = (
        F.when(title == alias, TITLE_EQUAL)
        .when(name == alias, NAME_EQUAL)
        .when(F.contains(title, alias), TITLE_HOLDS)
        .when(F.contains(name, alias), NAME_HOLDS)
        .when(F.contains(preview, alias), PREVIEW_HOLDS)
        .when((F.length(name) >= 4) & F.contains(alias, name), ALIAS_HOLDS)
    )
    return F.when(shares, ladder)


def priority_join(left: DataFrame, lookup: DataFrame, rules: list[tuple[Column, Column]], keys: list[str], order: list[Column]) -> DataFrame:
    """The first lookup row by rule order, then lookup order. Each rule (left key, lookup key) is an equi-join of its own."""
    parts = []
    for rank, (a, b) in enumerate(rules, 1):
        parts.append(left.withColumn("_k", a).join(lookup.withColumn("_j", b), F.col("_k") == F.col("_j")).drop("_k", "_j").withColumn("rule", F.lit(rank)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("rule", *order))).where("_r = 1").drop("_r")


def keyword_score(text: Column, keywords: list[str]) -> Column:
    """100 and the keyword's length for each keyword that the text holds."""
    return sum((F.when(F.contains(text, F.lit(k)), 100 + len(k)).otherwise(0) for k in keywords), F.lit(0))


def overlap_scores(left: DataFrame, right: DataFrame, item: str, left_key: str, right_key: str) -> DataFrame:
    """left_key, right_key, shared: items in common. Only pairs with a shared item are made, one row per pair and item."""
    return left.select(left_key, item).distinct().join(right.select(right_key, item).distinct(), item).groupBy(left_key, right_key).agg(F.count(F.lit(1)).alias("shared"))
