"""Corpus-wide line dedup: lines whose key stands in many documents go from all of them.

Lines are exploded as (document, position, key hash); documents are counted per hash; the positions of frequent lines go
back to their documents by a semi-join and a group per document; the text is put together again from the other positions.

Defined cases: null or empty text is one empty line (key of zero code points, never dropped); a document that repeats a
line counts once for it, and so do repeated rows of one document; rows of one doc_id with other texts are told apart and
count as one document; rows without an id are kept, and count as one document together; an empty table gives an empty result. Clashing names in docs do no harm: only the named columns
are read, and keep's columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, lower_ascii, materialise

MIN_DOCUMENTS = 10


def line_key(line):
    return lower_ascii(F.trim(line, F.lit(SPACE_CHARS)))


def exploded_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _text_hash, _pos and the key's hash (two longs with unlike seeds, so that chance collisions don't matter)."""
    keys = F.transform(F.split(text_col, "\n"), line_key)
    lines = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_text_hash"), F.posexplode(keys).alias("_pos", "_key"))
    return lines.where(F.length("_key") >= 1).select("_id", "_text_hash", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit("line"), "_key").alias("_h2"))


def frequent_lines(lines: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """Hashes found in at least so many documents. The first group spreads a frequent line over all partitions."""
    once = lines.select("_h1", "_h2", "_id").distinct()
    return once.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_documents).select("_h1", "_h2")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """id, keep, text without frequent lines, n_lines (before), n_dropped; a row for each row of docs."""
    lines = materialise(exploded_lines(docs, id_col, text_col))  # read twice below; some 30 bytes a line
    frequent = materialise(frequent_lines(lines, min_documents))  # a few of the hashes; of known size when the join is planned
    dropped = lines.join(frequent, ["_h1", "_h2"], "left_semi").groupBy("_id", "_text_hash").agg(F.collect_set("_pos").alias("_drop"))
    own = docs.select(F.col(id_col).alias("_own_id"), *[F.col(c) for c in keep], F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_own_hash"))
    joined = own.join(dropped.hint("shuffle_hash"), F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("_own_hash") == F.col("_text_hash")), "left")
    text = F.coalesce("_text", F.lit(""))
    parts = F.split("_text", "\n")
    rest = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "_drop")  # linear, in order
    return joined.withColumn("_parts", parts).select(
        F.col("_own_id").alias(id_col),
        *keep,
        F.when(F.col("_drop").isNull(), text).otherwise(F.array_join(F.transform(rest, lambda i: F.get("_parts", i)), "\n")).alias(text_col),
        F.coalesce(F.size("_parts"), F.lit(1)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def dedup_digest(docs: DataFrame, **options) -> DataFrame:
    out = dedup_lines(docs, **options)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))
