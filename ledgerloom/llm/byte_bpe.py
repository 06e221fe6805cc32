"""Byte-level BPE over a rank file: texts to token ids and back, by a sentencepiece model made from the ranks.

The model is serialised straight from the vocabulary, nothing is trained: each byte becomes a printable character, each
token the piece of its bytes' characters with score -rank, and text is taken as it is (identity normalisation, no space
put before it). The best pair is then the pair of the least rank, the leftmost first, as byte-level BPE has it. Texts are
cut into pre-tokens by the public pattern and each pre-token is encoded alone; a pre-token that is a token itself is that
token. Ids go back to bytes by the inverse mapping, whatever the bytes are.

Both ways are maps over rows without a shuffle, in slices of some two million bytes; each worker keeps the ids of
KEPT_WORDS pre-tokens at most and starts anew beyond them.

Defined cases: null text is empty and has no ids; null ids decode to null, no ids to no bytes; an id outside the vocabulary
is an error; special strings in texts are ordinary text; rows, also repeated ones and those with null ids, give a row each;
an empty table gives an empty result; a text of any length is one row; only the named columns are read, so others may have
any names.
"""

from __future__ import annotations

import base64
import struct
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import bytes_of, slices
from .common import ship_package

VOCABULARY = "byte_bpe_50k.tiktoken"
KEPT_WORDS = 400_000


def byte_characters() -> list[str]:
    """A printable character for each byte: visible Latin-1 characters stand for themselves, others follow from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(hidden)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in order of their ranks, which must be 0, 1, 2 and so on."""
    with open(path, "rb") as f:
        ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f))
    if [r for r, _ in ranked] != list(range(len(ranked))):
        raise ValueError("ranks have gaps")
    tokens = [t for _, t in ranked]
    if not {bytes([b]) for b in range(256)} <= set(tokens):
        raise ValueError("a byte without a token")
    return tokens


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def piece_model(tokens: list[bytes]) -> bytes:
    """The serialised model. Field numbers and types are those of sentencepiece's public model format."""
    normal, unknown, bpe = 1, 2, 2
    names = bytes(range(256)).decode("latin-1")
    to_characters = str.maketrans(names, "".join(byte_characters()))
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = token.decode("latin-1").translate(to_characters).encode()
        out += _block(1, _block(1, piece) + _varint(2 << 3 | 5) + struct.pack("<f", -rank) + _number(3, normal))
    out += _block(1, _block(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0) + _number(3, unknown))
    out += _block(2, _number(3, bpe) + _number(4, len(tokens) + 1) + _number(40, len(tokens)) + _number(41, -1) + _number(42, -1) + _number(43, -1))
    out += _block(3, _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0))
    return bytes(out)


class Codec:
    """Texts to ids and ids to bytes, for one worker."""

    def __init__(self, path: str):
        import sentencepiece

        self.tokens = read_ranks(path)
        self.ranks = {t: i for i, t in enumerate(self.tokens)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=piece_model(self.tokens))
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        self.to_characters = str.maketrans(bytes(range(256)).decode("latin-1"), "".join(byte_characters()))
        self.known: dict[str, list[int]] = {}
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)

    def learn(self, words: set[str]) -> None:
        """Puts the ids of words into known."""
        if len(self.known) > KEPT_WORDS:
            self.known = {}
        rest = []
        for word in words.difference(self.known):
            rank = self.ranks.get(data := word.encode())
            if rank is None:
                rest.append((word, data.decode("latin-1").translate(self.to_characters)))
            else:
                self.known[word] = [rank]
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            self.known.update(zip((w for w, _ in part), self.model.encode([c for _, c in part], num_threads=1), strict=True))

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        words = [self.find(t) if t else [] for t in texts]
        self.learn(set().union(*words))
        known = self.known
        each = [list(chain.from_iterable(map(known.__getitem__, w))) for w in words]
        offsets = np.zeros(len(each) + 1, np.int32)
        np.cumsum(np.fromiter(map(len, each), np.int64, len(each)), out=offsets[1:])
        ids = np.fromiter(chain.from_iterable(each), np.int32, int(offsets[-1]))
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        flat = np.asarray(ids.flatten())  # without what null lists may hide
        if ids.flatten().null_count or len(flat) and not 0 <= flat.min() <= flat.max() < len(self.tokens):
            raise ValueError("an id outside the vocabulary")
        counts = np.array([0 if n is None else n for n in ids.value_lengths().to_pylist()], np.int64)
        sizes = self.sizes[flat]
        ends = np.cumsum(sizes)
        data = self.bytes[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[flat] - ends + sizes, sizes)]
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        texts = (data[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False))
        return pa.array([t if ok else None for t, ok in zip(texts, ids.is_valid().to_pylist(), strict=True)], pa.binary())


@lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id, ids array<int>: a row for each row. path: a rank file, on every machine; by default the installed one."""
    ship_package(docs.sparkSession)
    path = path or public_tokenizers.path(VOCABULARY)
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("id"), codec(path).encode(part.column("text").to_pylist())], ["id", "ids"])

    return own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, ids array<int>").select(F.col("id").alias(id_col), "ids")


def id_slices(batch: pa.RecordBatch, size: int = 500_000):
    """Runs of whole rows with about so many ids; a longer row comes alone."""
    ends = np.cumsum([n or 0 for n in batch.column("ids").value_lengths().to_pylist()])
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """id, ids, decoded binary (a token may end inside a character): a row for each row."""
    ship_package(encoded.sparkSession)
    path = path or public_tokenizers.path(VOCABULARY)
    own = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))

    def run(batches):
        for batch in batches:
            for part in id_slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("ids"), codec(path).decode(part.column("ids"))], ["id", "ids", "decoded"])

    out = own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, ids array<int>, decoded binary")
    return out.select(F.col("id").alias(id_col), F.col("ids").alias(ids_col), "decoded")


def round_trip_digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by spaces), decoded_sha256: documents encoded, then decoded."""
    out = decode(encode(docs, **options))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.encode(ids, "utf-8"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
