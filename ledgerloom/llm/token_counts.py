"""Token counts without token ids: pieces are counted once per distinct pre-token and joined to document frequencies.

The model's vocabulary has no piece with a space mark after another character, so merges never cross from a word to the
next space: a text's pieces are the sum over its pre-tokens (a run of spaces and the word behind it).

Frequencies. Documents are read in slices of some SLICE_BYTES. A slice lists each of its pre-tokens once, by bucket of the
pre-token's hash, with the documents that hold it and how often. This is written once.
Pieces. The lists meet by bucket, and the library counts each distinct pre-token of the corpus once. A pre-token found
everywhere is one entry per slice, so no bucket depends on how many documents hold it.
Join. The counts go back to their slices, where frequency x pieces is summed by document. A slice is of bounded size, so
every group here is.

Defined cases: null text is empty (0 bytes, 0 tokens); null ids are kept; repeated rows give repeated results; an empty table gives an empty
result; a very long text is a slice of its own; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship_package

LIMIT = 4096
SLICE_BYTES = 16_000_000
SLICE_DOCS = 1 << 16
MARK = "▁"  # the model's own sign for a space


@lru_cache(maxsize=2)
def processor(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    if any(MARK in model.id_to_piece(i).lstrip(MARK) for i in range(model.get_piece_size())):
        raise ValueError("this vocabulary joins words, so pre-tokens can't be counted apart")
    return model


def pre_tokens(text: str) -> Counter:
    """Frequencies of pre-tokens, each without its first space mark (the library puts one before every text)."""
    if MARK in text:
        text = text.replace(MARK, " ")
    words = text.split(" ")
    if "" not in words:
        return Counter(words)
    out, spaces = Counter(), ""
    if text:
        for word in words[:-1]:
            if word:
                out[spaces + word] += 1
                spaces = ""
            else:
                spaces += " "
        out[spaces + words[-1]] += 1  # "" after a last space: one piece, the mark alone
    return out


def planes(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as four planes of bytes: small numbers then compress to little."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def gaps(holders: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """The first holder of each pre-token as it is, the others as steps from the one before."""
    first = np.cumsum(spread) - spread
    out = np.diff(holders, prepend=0)
    out[first] = holders[first]
    return out


def from_gaps(steps: np.ndarray, spread: np.ndarray) -> np.ndarray:
    total, first = np.cumsum(steps, dtype=np.int64), np.cumsum(spread, dtype=np.int64) - spread
    return total - np.repeat(total[first] - steps[first], spread)


class Slice:
    """Pre-tokens of consecutive documents, each with its holders."""

    def __init__(self):
        self.number, self.held, self.times, self.ids, self.n_bytes = {}, [], [], [], []

    def add(self, doc_id, n_bytes: int, text: str) -> None:
        found, number = pre_tokens(text), self.number
        self.held.append(np.fromiter([number.setdefault(w, len(number)) for w in found], np.int64, len(found)))
        self.times.append(np.fromiter(found.values(), np.int64, len(found)))
        self.ids.append(doc_id)
        self.n_bytes.append(n_bytes)

    def rows(self, slice_id: int, buckets: int):
        """The row of the documents, then a row for each bucket of pre-tokens; holders are in the order of these rows."""
        words = list(self.number)
        bucket = np.fromiter((zlib.crc32(w.encode()) % buckets for w in words), np.int64, len(words))
        order = np.array(sorted(range(len(words)), key=lambda i: (bucket[i], words[i])), np.int64)
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        held = place[np.concatenate(self.held)]
        holder = np.repeat(np.arange(len(self.ids)), [len(h) for h in self.held])
        by_word = np.argsort(held, kind="stable")
        spread = np.bincount(held, minlength=len(words))
        yield slice_id, None, None, None, self.ids, self.n_bytes, planes(gaps(holder[by_word], spread)), planes(np.concatenate(self.times)[by_word]), planes(spread)
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(words)], strict=False):  # no cuts if there are no words
            part = [words[i] for i in order[a:b]]
            yield slice_id, int(bucket[order[a]]), "".join(part), planes(np.fromiter(map(len, part), np.int64, len(part))), None, None, None, None, None


def frequencies(docs: DataFrame, id_col: str, text_col: str, buckets: int, slice_bytes: int, slice_docs: int) -> DataFrame:
    """Rows of slices: documents with holders (bucket null), and pre-tokens by bucket."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))

    def run(batches):
        current, size, n, schema = Slice(), 0, 0, None

        def closed():
            for row in current.rows(TaskContext.get().partitionId() << 32 | n, buckets):
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            kinds = {"slice": pa.int64(), "bucket": pa.int32(), "words": pa.string(), "lengths": pa.binary(), "doc_ids": pa.list_(batch.schema.field("doc_id").type), "n_bytes": pa.list_(pa.int64()), "holders": pa.binary(), "times": pa.binary(), "spread": pa.binary()}
            schema = pa.schema(list(kinds.items()))
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for row in zip(*(part.column(c).to_pylist() for c in ("doc_id", "n_bytes", "text")), strict=True):
                    current.add(*row)
                    size += row[1]
                    if size >= slice_bytes or len(current.ids) >= slice_docs:
                        yield from closed()
                        current, size, n = Slice(), 0, n + 1
        if current.ids:
            yield from closed()

    id_type = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"slice bigint, bucket int, words string, lengths binary, doc_ids array<{id_type}>, n_bytes array<bigint>, holders binary, times binary, spread binary")


def words_in(words: str, lengths: bytes) -> list[str]:
    ends = np.cumsum(from_planes(lengths)).tolist()
    return [words[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def count_pieces(words: DataFrame, path: str) -> DataFrame:
    """slice, bucket, words, lengths -> slice, bucket, pieces: each distinct pre-token goes to the library once."""

    def run(table: pa.Table) -> pa.Table:
        lists = [words_in(w, n) for w, n in zip(table.column("words").to_pylist(), table.column("lengths").to_pylist(), strict=True)]
        model, pieces = processor(path), {}
        distinct = list(set().union(*lists))
        for at in range(0, len(distinct), 2000):
            part = distinct[at : at + 2000]
            pieces.update(zip(part, map(len, model.encode(part, num_threads=1)), strict=True))
        pieces[""] = 1
        counts = [planes(np.fromiter(map(pieces.__getitem__, own), np.int64, len(own))) for own in lists]
        return pa.table({"slice": table.column("slice"), "bucket": table.column("bucket"), "pieces": pa.array(counts, pa.binary())})

    return words.groupBy("bucket").applyInArrow(run, "slice bigint, bucket int, pieces binary")


def sum_pieces(slices: DataFrame, pieces: DataFrame, id_type: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens: frequency x pieces, summed by document in each slice."""

    def run(slices: pa.Table, pieces: pa.Table) -> pa.Table:
        counts = [from_planes(x) for x in pieces.sort_by("bucket").column("pieces").to_pylist()]
        row = {c: slices.column(c)[0] for c in slices.column_names}
        steps, times, spread = (from_planes(row[c].as_py()) for c in ("holders", "times", "spread"))
        each = np.repeat(np.concatenate(counts) if counts else spread[:0], spread) * times.astype(np.int64)
        sums = np.zeros(len(row["n_bytes"].values), np.int64)
        np.add.at(sums, from_gaps(steps, spread), each)
        return pa.table({"doc_id": row["doc_ids"].values, "n_bytes": row["n_bytes"].values, "n_tokens": sums})

    return slices.groupBy("slice").cogroup(pieces.groupBy("slice")).applyInArrow(run, f"doc_id {id_type}, n_bytes bigint, n_tokens bigint")


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT, slice_bytes: int = SLICE_BYTES, slice_docs: int = SLICE_DOCS
) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit. path: the model file, on every machine; by default the installed one."""
    spark = docs.sparkSession
    ship_package(spark)
    buckets = 4 * max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = materialise(frequencies(docs, id_col, text_col, buckets, slice_bytes, slice_docs), compression="zstd")
    words = found.where("bucket is not null").select("slice", "bucket", "words", "lengths")
    slices = found.where("bucket is null").select("slice", "doc_ids", "n_bytes", "holders", "times", "spread")
    pieces = count_pieces(words, path or public_tokenizers.path("piece_bpe_32k.model"))
    counted = sum_pieces(slices, pieces, docs.schema[id_col].dataType.simpleString())
    return counted.select(F.col("doc_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
