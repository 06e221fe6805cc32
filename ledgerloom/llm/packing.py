"""Lexical retrieval packing: BM25 neighbours of a seed document fill the rest of its window.

Documents are tokenised once and written as packed ids with two content keys: the least hashes, by two orders, of their
words. Documents with like words tend to share such keys, so rows are dealt out and sorted by them: a shard is a run of
SHARD_DOCS documents in key order, wherever its documents stood in the input, and a group of copies is cut by place like
any other run, so no key meets in one task. Each shard has an inverted index of its documents' tokens. BM25's document
frequencies, number of documents and mean length are those of all documents (one sum per token of the vocabulary, which
bounds what is sent). A seed opens a window; the unused documents of its shard with the best score against it fill the
window one after the other. What doesn't fit is cut: the rest of a document seeds the next window, so windows are full.
Only the last window of a task can stay short; it is cut at powers of two, which need no padding.

Defined cases: null or empty text is one token, the end id; repeated rows are packed each; an empty table gives no rows;
a document longer than the window goes over several windows in order; ties in score take the earlier document in key
order; null ids are kept; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import bytes_of, mix, slices, word_hash
from .common import materialise, ship_package

WINDOW = 4096
END = 2
SHARD_DOCS = 4096
SHARD_TOKENS = 3_000_000
TABLE_SIZE = 500_000
SLICE = 1_000_000
K1, B = 1.2, 0.75
SEPARATOR = "<|startoftext|>"
SCHEMA = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
STOPS = frozenset(".,;:!?")
#: Byte -> what it counts as: 0 between words (the vocabulary drops these), else itself with A-Z lower-cased.
#: The library composes and lower-cases characters; for ASCII letters the order of these steps makes no difference.
BYTES = np.array([0 if b in b" \t\n\r" else b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
OPENING = b"<|"  # begins every special string; words with it keep their case
NUL = np.uint8(255)  # stands for a zero byte, which is no space; 255 is in no UTF-8


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def byte_characters() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from U+0100 on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def word_spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts with spaces as zero, starts and ends of the words, and where each text's words begin (n + 1)."""
    raw, offsets = bytes_of(column)
    data = BYTES[raw]
    data[raw == 0] = NUL
    inside = np.zeros(len(data) + 2, bool)  # inside[i + 1]: byte i is of a word
    inside[1:-1] = data != 0
    first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    bounds = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]  # texts don't run together
    first[bounds] |= inside[1:-1][bounds]
    last[bounds - 1] |= inside[1:-1][bounds - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    for i in set(np.searchsorted(start, np.flatnonzero((raw[:-1] == OPENING[0]) & (raw[1:] == OPENING[1])), "right") - 1):
        own = raw[start[i] : end[i]]  # the library looks for special strings before it lower-cases
        data[start[i] : end[i]] = np.where(own == 0, NUL, own)
    return data, start, end, np.searchsorted(start, offsets)


class TokenTable:
    """Word -> ids as the library gives them. The vocabulary drops white space, so words can be encoded apart."""

    def __init__(self, path: str, size: int = TABLE_SIZE):
        self.model, self.size = tokenizer(path), size
        self.bpe, self.separator = self.model.model, self.model.token_to_id(SEPARATOR)
        self.stops = {s: self.model.encode(s, add_special_tokens=False).ids for s in STOPS}
        self.byte = byte_characters()
        self.clear()

    def clear(self):
        """keys: sorted hashes of the words held, rows: their rows; row i has the ids flat[starts[i] : starts[i] + sizes[i]]."""
        self.keys, self.rows, self.used = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        self.starts, self.sizes, self.flat = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32)
        self.hits = np.zeros(1024, np.int32)  # slices of text that had the word

    def forget(self):
        """Drops the words met in one slice only, or all if that leaves over half of the table."""
        often = np.flatnonzero(self.hits[self.rows] > 1)
        keys, sizes, starts = self.keys[often], self.sizes[self.rows[often]], self.starts[self.rows[often]]
        ends = np.cumsum(sizes)
        flat = self.flat[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        self.clear()
        if 2 * len(keys) <= self.size:
            self.put(keys, sizes, flat)

    def letters(self, word: str) -> list[int]:
        """Lower-case letters are one pre-token, which the library's BPE takes as byte characters."""
        return [t.id for t in self.bpe.tokenize(word if word.isascii() else "".join([self.byte[b] for b in word.encode()]))]

    def ids_of(self, words: list[str]) -> list[list[int]]:
        """Letters that the library's normaliser leaves as they are, and a stop behind them, are pre-tokens of their own;

        all other words go through the whole library.
        """
        found, other = [], []
        for w in words:
            core, stop = (w[:-1], w[-1]) if w[-1] in STOPS else (w, "")
            if core.isalpha() and core.islower() and (core.isascii() or (core.lower() == core and unicodedata.is_normalized("NFC", core))):
                found.append(self.letters(core) + self.stops[stop] if stop else self.letters(core))
            else:
                found.append(None)
                other.append(w)
        others = dict(self.library(other))
        return [others[w] if x is None else x for w, x in zip(words, found, strict=True)]

    def add(self, keys: np.ndarray, words: list[str]) -> None:
        """keys: sorted hashes of the words, none held so far."""
        found = self.ids_of(words)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.put(keys, sizes, np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum())))

    def put(self, keys: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> None:
        n, more = len(self.keys), len(keys)
        while n + more > len(self.starts):
            self.starts, self.sizes, self.hits = (np.resize(x, 2 * len(x)) for x in (self.starts, self.sizes, self.hits))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(flat)] = flat
        self.starts[n : n + more] = self.used + np.cumsum(sizes) - sizes
        self.sizes[n : n + more], self.hits[n : n + more] = sizes, 0
        at = np.searchsorted(self.keys, keys)
        self.keys, self.rows = np.insert(self.keys, at, keys), np.insert(self.rows, at, n + np.arange(more))
        self.used += len(flat)

    def library(self, words: list[str]):
        """The ids of many words by one call each for a thousand, with a special token between the words."""
        for at in range(0, len(words), 1000):
            part = words[at : at + 1000]
            plain = [w for w in part if SEPARATOR not in w]
            ids = self.model.encode(SEPARATOR.join(plain), add_special_tokens=False).ids
            cuts = [-1, *[i for i, x in enumerate(ids) if x == self.separator], len(ids)]
            yield from ((w, ids[a + 1 : b]) for w, a, b in zip(plain, cuts[:-1], cuts[1:], strict=bool(plain)))
            yield from ((w, self.model.encode(w, add_special_tokens=False).ids) for w in part if SEPARATOR in w)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids, where each text's ids begin (n + 1), hash of every word, where each text's words begin (n + 1)."""
        data, start, end, text = word_spans(column)
        hashes = word_hash(data, start, end)
        distinct, which = np.unique(hashes, return_inverse=True)
        first = np.empty(len(distinct), np.int64)
        first[which[::-1]] = np.arange(len(hashes) - 1, -1, -1)
        new = self.missing(distinct)
        if len(self.keys) + len(new) > self.size:
            self.forget()
            new = self.missing(distinct)
        words = [data[a:b].tobytes().replace(b"\xff", b"\0").decode("utf-8", "surrogatepass") for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)]
        self.add(distinct[new], words)
        own = self.rows[np.searchsorted(self.keys, distinct)] if len(distinct) else np.zeros(0, np.int64)
        self.hits[own] += 1
        rows = own[which]
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.starts[rows] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.concatenate([[0], ends])[text], hashes, text

    def missing(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys that the table doesn't hold."""
        if not len(self.keys):
            return np.arange(len(keys))
        return np.flatnonzero(self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] != keys)


@lru_cache(maxsize=1)
def token_table(path: str) -> TokenTable:
    """One per worker process: tasks that follow find its words. What it holds never changes a result."""
    return TokenTable(path)


class Corpus:
    """Statistics of all documents for BM25: how many hold each token, the mean number of tokens, their number."""

    def __init__(self, df: np.ndarray, documents: int, tokens: int):
        self.idf = np.maximum(0, np.log((documents - df + 0.5) / (df + 0.5))).astype(np.float32)  # zero from half of all documents on
        self.mean = max(tokens / max(documents, 1), 1e-9)


class Index:
    """BM25 over the documents of a shard; a document is its array of tokens."""

    def __init__(self, docs: list[np.ndarray], corpus: Corpus):
        n = len(docs)
        sizes = np.fromiter(map(len, docs), np.int64, n)
        kind = np.int32 if n * len(corpus.idf) < 1 << 31 else np.int64
        tokens = np.concatenate(docs).astype(kind) if n else np.zeros(0, kind)
        idf = corpus.idf[tokens]
        keep = idf > 0
        key, tf = np.unique(tokens[keep] * kind(n) + np.repeat(np.arange(n, dtype=kind), sizes)[keep], return_counts=True)
        token, self.doc = key // max(n, 1), key % max(n, 1)
        norm = K1 * (1 - B + B * sizes / corpus.mean)
        self.impact = corpus.idf[token] * tf * (K1 + 1) / (tf + norm[self.doc])
        new = np.ones(len(token), bool)
        new[1:] = np.diff(token) != 0
        self.start, self.n = np.append(np.flatnonzero(new), len(token)), n
        order = np.argsort(self.doc, kind="stable")
        self.term_of, self.doc_start = (np.cumsum(new) - 1)[order], np.searchsorted(self.doc[order], np.arange(n + 1))

    def scores(self, seed: int) -> np.ndarray:
        terms = self.term_of[self.doc_start[seed] : self.doc_start[seed + 1]]
        df = self.start[terms + 1] - self.start[terms]
        at = np.repeat(self.start[terms] - np.cumsum(df) + df, df) + np.arange(df.sum())
        return np.bincount(self.doc[at], self.impact[at], self.n)


class Packer:
    """Windows over shard after shard; yields pieces (document, start, length, crc, tokens, sequence, offset)."""

    def __init__(self, first_sequence: int, window: int = WINDOW):
        self.sequence, self.window, self.open, self.fill = first_sequence, window, [], 0

    def put(self, doc_id, ids: np.ndarray, start: int) -> int:
        """Puts ids from start on into the open window; the place after the last id put."""
        stop = min(len(ids), start + self.window - self.fill)
        self.open.append((doc_id, ids, start, stop))
        self.fill += stop - start
        return stop

    def close(self) -> list[tuple]:
        out, offset = [], 0
        for doc_id, ids, start, stop in self.open:
            out.append((doc_id, start, stop - start, zlib.crc32(ids[start:stop].astype("<u4").tobytes()), len(ids), self.sequence, offset))
            offset += stop - start
        self.sequence, self.open, self.fill = self.sequence + 1, [], 0
        return out

    def shard(self, docs: list[tuple], corpus: Corpus):
        """docs: of (document, ids)."""
        index, used, next_seed = Index([ids[:-1] for _, ids in docs], corpus), np.zeros(len(docs), bool), 0
        left = len(docs)
        seed, rest = None, 0
        while left or seed is not None:
            if seed is None:
                while used[next_seed]:
                    next_seed += 1
                seed, rest = next_seed, 0
                used[seed], left = True, left - 1
            doc_id, ids = docs[seed]
            while rest < len(ids):
                rest = self.put(doc_id, ids, rest)
                if self.fill == self.window:
                    yield from self.close()
            if not self.fill:
                seed = None
                continue
            if not left:
                return  # the window stays open for the next shard
            score = index.scores(seed)
            score[used] = -1
            seed = None
            while self.fill and left:
                best = int(np.argmax(score))
                score[best], used[best], left = -1, True, left - 1
                rest = self.put(*docs[best], 0)
                if self.fill == self.window:
                    yield from self.close()
                    if rest < len(docs[best][1]):
                        seed = best

    def finish(self):
        """The last window, cut at powers of two."""
        todo, self.open, fill, self.fill = self.open, [], self.fill, 0
        size = 1 << max(fill, 1).bit_length() - 1
        while todo:
            while size > fill:
                size //= 2
            room, part = size, []
            while room:
                doc_id, ids, start, stop = todo.pop(0)
                cut = min(stop, start + room)
                part.append((doc_id, ids, start, cut))
                room -= cut - start
                if cut < stop:
                    todo.insert(0, (doc_id, ids, cut, stop))
            self.open, fill = part, fill - size
            yield from self.close()


def least_of(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Least value of each run that starts give (n + 1); the largest number for an empty run."""
    out = np.full(len(starts) - 1, np.iinfo(np.uint64).max, np.uint64)
    full = np.flatnonzero(starts[1:] > starts[:-1])
    if len(full):
        out[full] = np.minimum.reduceat(values, starts[full])
    return out


def holders(ids: np.ndarray, sizes: np.ndarray, vocabulary: int) -> np.ndarray:
    """In how many documents, sizes ids each, every token stands: by marks for 64 long documents at a time, else by distinct pairs."""
    if len(sizes) * vocabulary > 100 * len(ids):
        return np.bincount(np.unique(np.repeat(np.arange(len(sizes)), sizes) * vocabulary + ids) % vocabulary, minlength=vocabulary)
    out, ends = np.zeros(vocabulary, np.int64), np.concatenate([[0], np.cumsum(sizes)])
    for a in range(0, len(sizes), 64):
        b = min(a + 64, len(sizes))
        seen = np.zeros((b - a) * vocabulary, bool)
        seen[np.repeat(np.arange(b - a) * vocabulary, sizes[a:b]) + ids[ends[a] : ends[b]]] = True
        out += seen.reshape(b - a, vocabulary).sum(0)
    return out


def tokenised(docs: DataFrame, path: str | None) -> DataFrame:
    """doc_id, text -> doc_id, ids (packed, with the end id), two content keys, place (row of the input); besides, a row per
    task with df, in how many of its documents each token stands."""
    id_type = docs.schema["doc_id"].dataType

    def run(batches):
        table = token_table(path or public_tokenizers.path("word_bpe_49k.json"))
        vocabulary = max(table.model.get_vocab_size(with_added_tokens=True), END + 1)
        width, df, place, schema = np.dtype(np.uint16 if vocabulary <= 1 << 16 else np.uint32), np.zeros(vocabulary, np.int64), TaskContext.get().partitionId() << 36, None
        lists = lambda n: pa.nulls(n, pa.list_(pa.int64()))
        for batch in batches:
            schema = batch.schema.field("doc_id").type
            for part in slices(batch, "text", SLICE):
                ids, starts, hashes, words = table.encode(part.column("text"))
                n, sizes = part.num_rows, np.diff(starts)
                df += holders(ids, sizes, vocabulary)
                with_end = np.insert(ids, starts[1:], END).astype(width)
                cuts = (starts + np.arange(n + 1)) * width.itemsize
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(with_end)]).cast(pa.binary())
                keys = [pa.array(least_of(mix(hashes + np.uint64(k)), words).view(np.int64)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), packed, *keys, pa.array(place + np.arange(n)), lists(n)], names=["doc_id", "ids", "key", "key2", "place", "df"])
                place += n
        if schema is not None:
            nulls = [pa.nulls(1, schema), pa.nulls(1, pa.binary()), *[pa.nulls(1, pa.int64())] * 3]
            yield pa.RecordBatch.from_arrays([*nulls, pa.array([df], pa.list_(pa.int64()))], names=["doc_id", "ids", "key", "key2", "place", "df"])

    return docs.mapInArrow(run, f"doc_id {id_type.simpleString()}, ids binary, key bigint, key2 bigint, place bigint, df array<bigint>")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, window: int = WINDOW, shard_docs: int = SHARD_DOCS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """A row per piece. path: the tokenizer file, on every machine; by default the installed one."""
    spark = docs.sparkSession
    ship_package(spark)
    table = materialise(tokenised(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), path))
    id_type = table.schema["doc_id"].dataType
    counted = table.select(F.posexplode("df").alias("token", "n")).where("n > 0").groupBy("token").agg(F.sum("n").alias("n")).collect()  # a row per token at most
    size = vocabulary_size(path)
    df = np.zeros(size, np.int64)
    df[[r.token for r in counted]] = [r.n for r in counted]
    width = np.dtype(np.uint16 if size <= 1 << 16 else np.uint32)
    rows_ = table.where("ids is not null")
    n, tokens = rows_.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("ids") / width.itemsize - 1), F.lit(0))).first()
    sent = spark.sparkContext.broadcast(Corpus(df, n, int(tokens)))

    def run(batches):
        packer, corpus = Packer(TaskContext.get().partitionId() << 36, window), sent.value
        held, tokens, arrow_id = [], 0, None

        def rows(pieces):
            pieces = list(pieces)
            if pieces:
                columns = list(zip(*pieces, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], arrow_id), *[pa.array(c, pa.int64()) for c in columns[1:]]], names=["doc_id", *[x.split()[0] for x in SCHEMA.split(", ")]])

        for batch in batches:
            arrow_id = batch.schema.field("doc_id").type
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                held.append((doc_id, np.frombuffer(ids, width)))
                tokens += len(held[-1][1])
                if len(held) >= shard_docs or tokens >= shard_tokens:
                    yield from rows(packer.shard(held, corpus))
                    held, tokens = [], 0
        if held:
            yield from rows(packer.shard(held, corpus))
        yield from rows(packer.finish())

    dealt = rows_.repartitionByRange("key", "key2", "place").sortWithinPartitions("key", "key2", "place")
    out = dealt.select("doc_id", "ids").mapInArrow(run, f"doc_id {id_type.simpleString()}, {SCHEMA}")
    return out.withColumnRenamed("doc_id", id_col)


def vocabulary_size(path: str | None) -> int:
    model = tokenizer(path or public_tokenizers.path("word_bpe_49k.json"))
    return max(model.get_vocab_size(with_added_tokens=True), END + 1)
