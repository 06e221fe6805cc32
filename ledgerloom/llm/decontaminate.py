"""Benchmark decontamination: documents that hold a passage near a benchmark item.

Texts are read as words of ASCII letters and digits and of other characters, A-Z lower-cased, all else a separator. A
document's item-sized windows get SimHash fingerprints over their five-word shingles; a multi-index of eight blocks
returns every item whose fingerprint is within RADIUS (some block then differs in at most RADIUS // 8 bits); the
multisets of shingles of window and item are then compared exactly (sum of minima over sum of maxima, 0.8 or more).
Windows that hold too few shingles of every item of their size can't reach that similarity and are skipped before
fingerprinting; all others are looked at, in whatever order their shingles stand.

The benchmark is read in slices of at most MAX_ITEMS items, each sent to all tasks, so what is sent is bounded however
large the benchmark is; documents are read once per slice and never shuffled.

Defined cases: null and empty texts and items match nothing; an item of under five words has one shingle, all its words;
a document shorter than an item is one window; null document ids are kept; repeated rows of documents give repeated rows; an empty table of either
kind gives no rows; of several windows for one item the most similar counts, then the first; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import bytes_of, mix, slices, word_hash
from .common import ship_package

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 23
MAX_ITEMS = 20_000
#: Byte -> what it counts as: 0 separator, else the lower-cased byte.
BYTES = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)


def word_hashes(column: pa.Array, table: np.ndarray = BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of all texts, and where each text's words begin (n + 1). table: what each byte counts as."""
    data, offsets = bytes_of(column)
    data = table[data]
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = data != 0
    first = inside[:-1].copy()
    first[1:] &= ~inside[:-2]
    first[offsets[:-1][offsets[:-1] < len(data)]] |= inside[:-1][offsets[:-1][offsets[:-1] < len(data)]]  # texts don't run together
    start = np.flatnonzero(first)
    last = inside[:-1] & ~inside[1:]
    last[offsets[1:][offsets[1:] > 0] - 1] |= inside[:-1][offsets[1:][offsets[1:] > 0] - 1]
    end = np.flatnonzero(last) + 1
    return word_hash(data, start, end), np.searchsorted(start, offsets)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """At each word the hash of the `size` words from it on (shorter by size - 1)."""
    n = max(0, len(words) - size + 1)
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(0x100000001B3) + words[k : k + n])
    return out


def fingerprint(shingles: np.ndarray) -> int:
    ones = np.unpackbits(np.ascontiguousarray(shingles).view(np.uint8).reshape(-1, 8), axis=1).sum(0)
    return int.from_bytes(np.packbits(2 * ones > len(shingles)).tobytes(), "big")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    keys, which = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.bincount(which[: len(a)], minlength=len(keys)), np.bincount(which[len(a) :], minlength=len(keys))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


class HammingIndex:
    """All fingerprints within radius of a query: eight byte blocks, each with every value near an item's block."""

    def __init__(self, fingerprints: list[int], radius: int):
        self.prints, self.radius = np.array(fingerprints, np.uint64), radius
        blocks = self.prints.astype(">u8").view(np.uint8).reshape(-1, 8)
        distance = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8))
        near = [np.flatnonzero(distance[v] <= radius // 8) for v in range(256)]
        self.tables = []
        for b in range(8):
            held = [np.flatnonzero(blocks[:, b] == v) for v in range(256)]
            self.tables.append([np.concatenate([held[v] for v in near[value]]) for value in range(256)])

    def within(self, query: int) -> np.ndarray:
        found = np.unique(np.concatenate([t[v] for t, v in zip(self.tables, query.to_bytes(8, "big"), strict=True)]))
        return found[np.bitwise_count(self.prints[found] ^ np.uint64(query)) <= self.radius]


class Benchmark:
    def __init__(self, items: list[tuple], shingle: int = SHINGLE, least: float = SIMILARITY, radius: int = RADIUS):
        words, starts = word_hashes(pa.array([t or "" for _, t in items], pa.string()))
        self.least, self.ids, self.sizes, self.shingles, self.spans = least, [], [], [], []
        for (item, _), a, b in zip(items, starts[:-1], starts[1:], strict=True):
            if b > a:
                self.ids.append(item)
                self.sizes.append(int(b - a))
                self.spans.append(min(shingle, int(b - a)))
                self.shingles.append(shingle_hashes(words[a:b], self.spans[-1]))
        prints = [fingerprint(s) for s in self.shingles]
        self.by_span = {}
        for span in sorted(set(self.spans)):
            own = [i for i, s in enumerate(self.spans) if s == span]
            keys = np.concatenate([self.shingles[i] for i in own])
            item = np.repeat(own, [len(self.shingles[i]) for i in own])
            place = np.concatenate([np.arange(len(self.shingles[i])) for i in own])
            order = np.argsort(keys, kind="stable")
            mask = np.zeros(1 << 20, bool)
            mask[keys >> np.uint64(44)] = True
            self.by_span[span] = (keys[order], item[order], place[order], mask, HammingIndex([prints[i] for i in own], radius), np.array(own))

    def windows(self, hits: np.ndarray, starts: np.ndarray, span: int) -> list[tuple]:
        """(row, first word, words) of every item-sized window that holds enough shingles of an item to reach the least similarity.

        hits: row, item, place, sorted and distinct. The sum of minima is at most the window's places with a shingle of the
        item, and minima and maxima add up to the shingles of both.
        """
        cuts = np.flatnonzero(np.any(hits[1:, :2] != hits[:-1, :2], axis=1)) + 1 if len(hits) else np.zeros(0, np.int64)
        low, high = np.concatenate([[0], cuts])[: len(hits)], np.concatenate([cuts, [len(hits)]])[: len(hits)]
        row, size = hits[low, 0], np.array(self.sizes)[hits[low, 1]]
        width = np.minimum(size, starts[row + 1] - starts[row])
        inner = width - span + 1
        need = self.least / (1 + self.least) * (inner + size - span + 1) - 1e-6
        found = set()
        for k in np.flatnonzero((high - low >= need) & (inner > 0)).tolist():
            at, r, w, m = hits[low[k] : high[k], 2], int(row[k]), int(width[k]), int(inner[k])
            first = np.arange(max(starts[r], at[0] - m + 1), min(starts[r + 1] - w, at[-1]) + 1)
            held = np.searchsorted(at, first + m) - np.searchsorted(at, first)
            found.update((r, a, w) for a in first[held >= need[k]].tolist())
        return sorted(found)

    def matches(self, words: np.ndarray, starts: np.ndarray) -> list[tuple]:
        """(row, item id, first word, words, similarity): the best window for each row and item."""
        best: dict = {}
        for span, (keys, item, place, mask, index, own) in self.by_span.items():
            all_shingles = shingle_hashes(words, span)
            at = np.flatnonzero(mask[all_shingles >> np.uint64(44)])
            low, high = np.searchsorted(keys, all_shingles[at], "left"), np.searchsorted(keys, all_shingles[at], "right")
            n = high - low
            at, hit = np.repeat(at, n), np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            row = np.searchsorted(starts, at, "right") - 1
            inside = at + span <= starts[row + 1]
            at, hit, row = at[inside], hit[inside], row[inside]
            for r, a, w in self.windows(np.unique(np.stack([row, item[hit], at], 1), axis=0), starts, span):
                shingles = all_shingles[a : a + w - span + 1]
                for i in own[index.within(fingerprint(shingles))].tolist():
                    s = similarity(shingles, self.shingles[i]) if min(self.sizes[i], starts[r + 1] - starts[r]) == w else 0
                    if s >= self.least and s > best.get((r, i), (0,))[0]:
                        best[r, i] = (s, a - int(starts[r]), w)
        return [(r, self.ids[i], a, w, s) for (r, i), (s, a, w) in sorted(best.items())]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_items: int = MAX_ITEMS, least: float = SIMILARITY) -> DataFrame:
    """Rows id, text_hash (xxhash64 of the text), item, first_word, n_words, similarity: documents and the items they hold."""
    spark = docs.sparkSession
    ship_package(spark)
    own = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).where(F.length("text") > 0)
    schema = f"doc_id {own.schema['doc_id'].dataType.simpleString()}, text_hash bigint, item_id {items.schema['item_id'].dataType.simpleString()}, first_word bigint, n_words bigint, similarity double"
    count = items.count()
    n_slices = -(-count // max_items)
    parts = []
    for k in range(n_slices):
        part = items if n_slices == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_slices)) == k)
        sent = spark.sparkContext.broadcast(Benchmark([tuple(r) for r in part.orderBy("item_id", "text").collect()], least=least))

        def run(batches, sent=sent):
            bench = sent.value
            for batch in batches:
                for part in slices(batch, "text"):
                    found = bench.matches(*word_hashes(part.column("text")))
                    if found:
                        rows = pa.array([r for r, *_ in found])
                        columns = [part.column("doc_id").take(rows), part.column("text_hash").take(rows), *map(pa.array, list(zip(*found, strict=True))[1:])]
                        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "item_id", "first_word", "n_words", "similarity"])

        parts.append(own.mapInArrow(run, schema))
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], schema)
