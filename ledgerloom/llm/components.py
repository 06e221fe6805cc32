"""Connected components of a link table as repeated joins, for links between distinct keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

MAX_ROUNDS = 60
MAX_SENT = 200_000


def connected_components(links: DataFrame) -> DataFrame:
    """links: a, b (comparable keys, any order, repeats allowed). Returns node, component (its least node), linked nodes only.

    Alternates large-star (a node's larger neighbours hang on its least neighbour) and small-star (a node and its smaller
    neighbours hang on the least of them) until the star forest stays the same; the rounds grow with the logarithm of
    the longest path, and MAX_ROUNDS, far above that, raises an error. Each round's links are written to the shared folder.
    A hot node's neighbours meet only in a min per key (partial aggregation) and a join on that key, which adaptive
    execution splits; up to MAX_SENT links, counted, the least neighbours are sent to all tasks instead.
    """
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(MAX_ROUNDS + 1):
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b") % 1000003).alias("s"), F.sum(F.xxhash64("b", "a") % 998244353).alias("t")).first()
        if state == before:
            roots = edges.select(F.col("b").alias("node")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
        before = state
        sent = F.broadcast if state.n <= MAX_SENT else lambda df: df
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(sent(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(sent(down), "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = materialise(small.distinct())
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
