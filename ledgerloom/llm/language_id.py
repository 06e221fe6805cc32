"""Language identification by Bayesian fusion of text, declared language, address suffix and host priors.

Text: naive Bayes over hashed byte trigrams of the whole lower-cased text, trained on a bounded sample of labelled rows
(TRAIN_ROWS, an equal share for every language of all labelled rows: its distinct texts with the least hashes), tempered by TEMPER because trigrams aren't independent. The text's own
posterior is summed by grouped aggregation into (a) how often each language declares each markup language, (b) stands
under each address suffix and (c) on each host. Host priors are smoothed towards the host's domain and domains towards the
whole table, without the row itself. The four log terms add up to the posterior.

Defined cases: null, empty and unlettered texts have no text evidence, so priors decide (all equal without any: the first
language by name); null declared language or suffix is no evidence; a null host has the table's prior only; null ids are kept; repeated rows
each count and get a row; without labelled rows or without rows at all the result is empty; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytetext import bytes_of, slices
from .common import materialise, ship_package

TRAIN_ROWS = 4000
MAX_SENT = 100_000
BUCKETS = 1 << 16
TEMPER = 0.1
WEIGHT = 20.0  # pseudo-rows of a prior
LOWER = np.array([b + 32 if 65 <= b <= 90 else b if b >= 97 and b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each byte trigram with a letter in the middle, its row, and the offsets."""
    data, offsets = bytes_of(column)
    b = LOWER[data].astype(np.int64)
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), offsets
    at = np.flatnonzero(b[1:-1] != 32)
    row = np.searchsorted(offsets, at + 1, "right") - 1
    inside = (at >= offsets[row]) & (at + 3 <= offsets[row + 1])
    at, row = at[inside], row[inside]
    return ((b[at] * 0x9E37 + b[at + 1] * 0x79B9 + b[at + 2] * 0x1F35) ^ (b[at + 2] << 7)) & (BUCKETS - 1), row, offsets


def train(labelled: DataFrame, max_rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """labelled: text, label -> languages, log probabilities (BUCKETS, languages)."""
    own = labelled.where("label is not null and length(text) > 0").withColumn("h", F.xxhash64("text", "label"))
    known = own.select("label", "h").distinct()
    n_labels = known.select("label").distinct().count()
    quota = -(-max_rows // max(1, n_labels))
    least = Window.partitionBy("label").orderBy("h")
    limits = known.withColumn("r", F.row_number().over(least)).where(F.col("r") <= quota).groupBy("label").agg(F.max("h").alias("limit"))
    limits = F.broadcast(limits) if n_labels <= MAX_SENT else limits  # a row for each label
    sample = own.join(limits, "label").where(F.col("h") <= F.col("limit")).dropDuplicates(["label", "h"])

    def count(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                bucket, row, _ = trigrams(part.column("text"))
                names, code = np.unique(np.array(part.column("label").to_pylist(), object).astype(str), return_inverse=True)
                key, n = np.unique(code[row] * BUCKETS + bucket, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(names[key // BUCKETS].tolist(), pa.string()), pa.array(key % BUCKETS, pa.int64()), pa.array(n, pa.int64())], names=["label", "bucket", "n"])

    rows = sample.select("text", "label").mapInArrow(count, "label string, bucket bigint, n bigint").groupBy("label", "bucket").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r["label"] for r in rows})
    if not languages:
        return [], np.zeros((BUCKETS, 0))
    counts = np.full((BUCKETS, len(languages)), 0.1)
    for r in rows:
        counts[r["bucket"], languages.index(r["label"])] += r["n"]
    return languages, np.log(counts / counts.sum(0))


def text_evidence(df: DataFrame, languages: list[str], logs: np.ndarray) -> DataFrame:
    """id, declared, host, domain, suffix, text (log likelihoods, array<double>)."""
    n_languages = len(languages)
    sent = df.sparkSession.sparkContext.broadcast(logs.astype(np.float32))

    def score(batches):
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                bucket, row, _ = trigrams(part.column("text"))
                total = np.stack([np.bincount(row, sent.value[bucket, k], len(part)) for k in range(n_languages)], 1)
                total = TEMPER * (total - total.max(1, keepdims=True))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * n_languages), pa.array(total.ravel()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("id", "declared", "host")], lists], names=["id", "declared", "host", "text"])

    scored = df.select("id", F.coalesce("text", F.lit("")).alias("text"), "declared", "host").mapInArrow(score, f"id {df.schema['id'].dataType.simpleString()}, declared string, host string, text array<double>")
    labels = F.split("host", r"\.")
    return scored.withColumn("domain", F.when(F.size(labels) > 1, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(F.col("host"))).withColumn("suffix", F.when(F.size(labels) > 1, F.element_at(labels, -1)))


def softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    powers = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, y: a + y))


def summed(df: DataFrame, key: str, n_languages: int) -> DataFrame:
    """key, {key}_n: the sum of the rows' text posteriors, by language."""
    sums = df.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.sum(F.col("own")[k]).alias(f"s{k}") for k in range(n_languages)])
    return sums.select(key, F.array(*[f"s{k}" for k in range(n_languages)]).alias(f"{key}_n"))


def identify(rows: DataFrame, labelled: DataFrame, max_train_rows: int = TRAIN_ROWS) -> DataFrame:
    """rows: id, text, declared, host; labelled: text, label. Returns id, lang, confidence, declared, host."""
    ship_package(rows.sparkSession)
    languages, logs = train(labelled, max_train_rows)
    n = len(languages)
    if not n:
        return rows.limit(0).select("id", F.lit("").alias("lang"), F.lit(0.0).alias("confidence"), "declared", "host")
    scored = materialise(text_evidence(rows, languages, logs).withColumn("own", softmax(F.col("text"))))
    # one row of totals: the prior over the whole table
    total = scored.agg(*[F.coalesce(F.sum(F.col("own")[k]), F.lit(0.0)).alias(f"t{k}") for k in range(n)]).select(F.array(*[f"t{k}" for k in range(n)]).alias("total"))
    df = scored.crossJoin(F.broadcast(total))
    for key in ("declared", "suffix", "domain", "host"):
        df = df.join(materialise(summed(scored, key, n)), key, "left")  # small next to the texts; adaptive execution broadcasts or splits
    zeros = F.array(*[F.lit(0.0)] * n)
    rest = lambda c: F.zip_with(F.coalesce(c, zeros), F.when(c.isNotNull(), F.col("own")).otherwise(zeros), lambda a, b: F.greatest(a - b, F.lit(0.0)))  # noqa: E731  without the row itself
    sum_of = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)

    def smoothed(counts: Column, prior: Column) -> Column:
        return F.zip_with(counts, prior, lambda c, p: (c + WEIGHT * p) / (sum_of(counts) + WEIGHT))

    df = df.withColumn("p0", F.transform(rest(F.col("total")), lambda c: (c + 1) / (sum_of(rest(F.col("total"))) + n)))
    df = df.withColumn("p1", smoothed(rest(F.col("domain_n")), F.col("p0")))
    df = df.withColumn("prior", smoothed(rest(F.col("host_n")), F.col("p1")))

    def evidence(key: str) -> Column:  # log P(value | language) up to a constant: P(language | value) / P(language)
        return F.when(F.col(f"{key}_n").isNotNull(), F.zip_with(smoothed(rest(F.col(f"{key}_n")), F.col("p0")), F.col("p0"), lambda a, p: F.log(a / p))).otherwise(zeros)

    fused = F.zip_with(F.zip_with("text", F.transform("prior", lambda p: F.log(p)), lambda a, b: a + b), F.zip_with(evidence("declared"), evidence("suffix"), lambda a, b: a + b), lambda a, b: a + b)
    df = df.withColumn("posterior", softmax(fused))
    names = F.array(*[F.lit(x) for x in languages])
    best = F.array_max("posterior")
    return df.select("id", F.get(names, (F.array_position("posterior", best) - 1).cast("int")).alias("lang"), F.round(best, 6).alias("confidence"), "declared", "host")


def documents_and_pages(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """One table id, text, declared, host: documents by their source, pages (id -1 - page_id) by markup and address."""
    docs = documents.select(F.col("doc_id").alias("id"), "text", F.lit(None).cast("string").alias("declared"), F.col("source").alias("host"))
    plain = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<[^>]*>|&[a-zA-Z#0-9]+;", " ")
    declared = F.lower(F.regexp_extract("html", r"""(?i)<html[^>]*\blang\s*=\s*["']?([a-zA-Z]{2,3})""", 1))
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    web = pages.select((-1 - F.col("page_id")).alias("id"), plain.alias("text"), F.when(declared != "", declared).alias("declared"), F.when(host != "", host).alias("host"))
    return docs.union(web)


def language_digest(documents: DataFrame, pages: DataFrame) -> DataFrame:
    out = identify(documents_and_pages(documents, pages), documents.select("text", F.col("lang").alias("label")))
    return out.select(F.col("id").alias("doc_id"), "lang", "confidence", "declared", "host")
