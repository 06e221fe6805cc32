"""Ranked lexical search: a sharded inverted index, asked for the best documents of each query by MaxScore.

Index. Documents are read in slices of some SHARD_BYTES; a slice is a shard, one row that holds its documents' ids and
lengths and, for each term, the documents that hold it and how often. It is written once, so statistics and search read no
text again. With a vocabulary only postings of its terms are kept; lengths always count all terms.
Statistics. Numbers of documents and terms and document frequencies are sums over all shards, by Spark.
Search. A query's terms in a shard are sorted by upper bound (weight times the best impact there). Terms whose bounds
together stay below the score to beat are non-essential: candidates come from the essential lists only, and a
non-essential list is probed only for candidates that can still reach that score. The score to beat is that of the best k
so far, carried from block to block and from shard to shard of a task. Tasks return k rows a query at most, and a window
takes the best of these. No document is left out by anything but its score.

Queries go out in blocks of at most BLOCK_TERMS terms (a longer query is a block of its own), each of which reads the index once.

Defined cases: null and empty texts have no terms and aren't counted as documents of the statistics; a query without terms
has no results; repeated rows of documents are documents each, repeated queries are answered each; a null id comes after
all others among equal scores; a term found in no document adds nothing; empty tables give an empty result; a long text
is a shard of its own; only the named columns are read, so others may have any names.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytetext import bytes_of
from .common import materialise, ship_package

SHARD_BYTES = 8_000_000
SHARD_DOCS = 1 << 14
BLOCK_DOCS = 2048
BLOCK_TERMS = 300_000
VOCABULARY_TERMS = 300_000
TOP = 10

#: Terms: digits, letters and all that is not ASCII, of UTF-8 bytes in lower case.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

#: Fixed values of the score.
FLAT, SLOPE, UNIT = 10, 90, 1_000_000_000


def terms_in(data: bytes) -> list[bytes]:
    """Terms in order; bytes.lower() changes A-Z only."""
    return TERM.findall(data.lower())


def query_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """q (a number for each row), id, terms (distinct, sorted)."""
    ship_package(items.sparkSession)
    own = items.select(F.monotonically_increasing_id().alias("q"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        for batch in batches:
            terms = [sorted(set(terms_in(t.encode()))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("id"), pa.array([[t.decode() for t in x] for x in terms], pa.list_(pa.string()))], ["q", "id", "terms"])

    return own.mapInArrow(run, f"q bigint, id {own.schema['id'].dataType.simpleString()}, terms array<string>")


class Shard:
    """Postings of consecutive documents."""

    def __init__(self):
        self.ids, self.lengths, self.size = [], [], 0
        self.number, self.held, self.times = {}, [], []

    def add(self, doc_id, data: bytes, vocabulary: frozenset[bytes] | None) -> None:
        words = terms_in(data)
        found, number = Counter(words if vocabulary is None else filter(vocabulary.__contains__, words)), self.number
        self.ids.append(doc_id)
        self.lengths.append(len(words))
        self.size += len(data)
        self.held.append(np.fromiter([number.setdefault(w, len(number)) for w in found], np.int64, len(found)))
        self.times.append(np.fromiter(found.values(), np.int64, len(found)))

    def row(self, shard: int, schema: pa.Schema) -> pa.RecordBatch:
        held = np.concatenate(self.held)
        holders = np.repeat(np.arange(len(self.ids)), [len(h) for h in self.held])
        order = np.argsort(held, kind="stable")
        spread = np.bincount(held, minlength=len(self.number))
        lengths = np.array(self.lengths, np.int64)
        values = shard, int((lengths > 0).sum()), int(lengths.sum()), self.ids, lengths, [w.decode() for w in self.number], spread, holders[order], np.concatenate(self.times)[order]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: frozenset[str] | None = None, shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """A row for each shard, written: shard, n_docs (with terms), n_terms, doc_ids, lengths, terms, and lists one after another of holders and times, spread by term."""
    ship_package(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    only = None if vocabulary is None else frozenset(t.encode() for t in vocabulary)

    def run(batches):
        current, n, schema = Shard(), 0, None
        for batch in batches:
            long, each = pa.int64(), pa.list_(pa.int32())
            schema = pa.schema([("shard", long), ("n_docs", long), ("n_terms", long), ("doc_ids", pa.list_(batch.schema.field("id").type)), ("lengths", each), ("terms", pa.list_(pa.string())), ("spread", each), ("holders", each), ("times", each)])
            data, offsets = bytes_of(batch.column("text"))
            for i, doc_id in enumerate(batch.column("id").to_pylist()):
                current.add(doc_id, data[offsets[i] : offsets[i + 1]].tobytes(), only)
                if current.size >= shard_bytes or len(current.ids) >= shard_docs:
                    yield current.row(TaskContext.get().partitionId() << 32 | n, schema)
                    current, n = Shard(), n + 1
        if current.ids:
            yield current.row(TaskContext.get().partitionId() << 32 | n, schema)

    kind = own.schema["id"].dataType.simpleString()
    shards = own.mapInArrow(run, f"shard bigint, n_docs bigint, n_terms bigint, doc_ids array<{kind}>, lengths array<int>, terms array<string>, spread array<int>, holders array<int>, times array<int>")
    return materialise(shards, compression="zstd")


def weighted(index: DataFrame, queries: DataFrame, n_docs: int) -> DataFrame:
    """q, terms, weights, of the terms that the index holds: floor(1000 ln((2N + 2) / (2 df + 1)))."""
    listed = index.select(F.explode(F.arrays_zip("terms", "spread")).alias("x"))
    frequency = listed.groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.spread").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    each = queries.select("q", F.explode("terms").alias("term")).join(frequency, "term").select("q", F.struct("term", weight.cast("long").alias("w")).alias("x"))
    return each.groupBy("q").agg(F.sort_array(F.collect_list("x")).alias("x")).select("q", F.col("x.term").alias("terms"), F.col("x.w").alias("weights"))


class Best:
    """The best k documents of a query so far: scores and ids, equal scores by id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.bar = k, [], [], 1

    def offer(self, scores: np.ndarray, ids: list) -> None:
        both = sorted(zip([-s for s in self.scores] + (-scores).tolist(), self.ids + ids, strict=True), key=lambda x: (x[0], x[1] is None, x[1] if x[1] is not None else 0))[: self.k]
        self.scores, self.ids = [-s for s, _ in both], [i for _, i in both]
        if len(both) == self.k:
            self.bar = self.scores[-1]  # an equal score may still win by its id


def max_score(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, ids: list, best: Best) -> None:
    """Offers to best the documents of a shard that can be among the best. lists: places in order, and scores that they add."""
    lists = sorted(lists, key=lambda x: int(x[1].max()))
    bounds = np.cumsum([int(add.max()) for _, add in lists])
    for low in range(0, n_docs, BLOCK_DOCS):
        high = min(low + BLOCK_DOCS, n_docs)
        first = int(np.searchsorted(bounds, best.bar))  # lists before it can't reach the bar together
        if first == len(lists):
            return
        total = np.zeros(high - low, np.int64)
        for places, add in lists[first:]:
            a, b = np.searchsorted(places, (low, high))
            total[places[a:b] - low] += add[a:b]
        found = np.flatnonzero(total)
        for i in range(first - 1, -1, -1):
            found = found[total[found] + bounds[i] >= best.bar]
            if not len(found):
                break
            places, add = lists[i]
            at = np.minimum(np.searchsorted(places, found + low), len(places) - 1)
            hit = places[at] == found + low
            total[found[hit]] += add[at[hit]]
        found = found[total[found] >= best.bar]
        if len(found) > best.k:  # of equal scores at the end all go on
            found = found[total[found] >= np.partition(total[found], -best.k)[-best.k]]
        if len(found):
            best.offer(total[found], [ids[low + i] for i in found.tolist()])


def search(index: DataFrame, queries: DataFrame, k: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """q, rank (from 1), doc, score: for each q the k best documents with a score above 0. queries: q, terms (distinct)."""
    spark = index.sparkSession
    ship_package(spark)
    counts = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    n_docs, n_terms = counts.n or 0, counts.l or 0
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    ranked = f"q bigint, doc {kind}, score bigint"

    def searched(block: list[tuple[int, list[str], list[int]]]) -> DataFrame:
        wanted = {t for _, terms, _ in block for t in terms}

        def run(batches):
            best = {q: Best(k) for q, _, _ in block}
            for batch in batches:
                for row in range(batch.num_rows):
                    column = {c: batch.column(c)[row] for c in batch.schema.names}
                    lengths, spread, holders, times = (np.asarray(column[c].values).astype(np.int64) for c in ("lengths", "spread", "holders", "times"))
                    ids, ends = column["doc_ids"].as_py(), np.cumsum(spread)
                    slow = FLAT + SLOPE * lengths * n_docs // max(n_terms, 1)
                    impact = UNIT * times // (1000 * times + 8 * slow[holders])
                    postings = {t: slice(int(e - s), int(e)) for t, s, e in zip(column["terms"].as_py(), spread, ends, strict=True) if t in wanted}
                    for q, terms, weights in block:
                        lists = [(holders[postings[t]], w * impact[postings[t]]) for t, w in zip(terms, weights, strict=True) if w and t in postings]
                        if lists:
                            max_score(lists, len(ids), ids, best[q])
            rows = [(q, i, s) for q, b in best.items() for i, s in zip(b.ids, b.scores, strict=True)]
            schema = pa.schema([("q", pa.int64()), ("doc", batch.schema.field("doc_ids").type.value_type), ("score", pa.int64())]) if rows else None
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

        return index.drop("n_docs", "n_terms", "shard").mapInArrow(run, ranked)

    found, block, size = [], [], 0
    for r in materialise(weighted(index, queries, n_docs)).toLocalIterator():
        if block and size + len(r.terms) > block_terms:
            found.append(searched(block))
            block, size = [], 0
        block.append((r.q, r.terms, r.weights))
        size += len(r.terms)
    out = searched(block)
    for more in found:
        out = out.union(more)
    best = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("q", "rank", "doc", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP, vocabulary_terms: int = VOCABULARY_TERMS, **options) -> DataFrame:
    """item_id, rank, doc_id, score: the k best of all documents for each item. Postings are kept for the items' terms, or for all terms if the items have more than vocabulary_terms."""
    queries = materialise(query_terms(items))
    terms = [r.term for r in queries.select(F.explode("terms").alias("term")).distinct().limit(vocabulary_terms + 1).collect()]
    index = build_index(docs, vocabulary=frozenset(terms) if len(terms) <= vocabulary_terms else None, **options)
    found = search(index, queries.select("q", "terms"), k)
    return found.join(queries.select("q", F.col("id").alias("item_id")), "q").select("item_id", "rank", F.col("doc").alias("doc_id"), "score")
