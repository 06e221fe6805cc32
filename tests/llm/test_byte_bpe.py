"""Byte-level BPE against the library of the rank file, and exact round trips."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from ledgerloom.llm.byte_bpe import Codec, byte_characters, decode, encode, piece_model, round_trip_digest

EXTRA = [None, "", " ", "\n\n  x", "<|endoftext|> a<|endoftext|>", "don't I'LL we'll", "é ＡΣ 日本語 😀 ​ 　 ▁x", "\x00\x1c\x85\r\n", "a" * 1_000_000, "ab " * 200_000, " " * 50_000, "�\U0010ffff"]


@pytest.fixture(scope="module")
def library():
    tokens = Codec(public_tokenizers.path("byte_bpe_50k.tiktoken")).tokens
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    base = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(1_000_000 + i if i else None, t) for i, t in enumerate(EXTRA)], base.schema)
    return base.union(extra).union(base.where("doc_id = 7")).withColumns({c: F.lit("clash") for c in ("id", "ids", "decoded", "n_tokens")}).repartition(4).cache()


def test_ids_and_round_trip(docs, library):
    out = {(r.doc_id, r.ids_sha256): r for r in round_trip_digest(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len({tuple(r) for r in rows}) == len(out) == len(rows) - 1
    for i, text in rows:
        ids = library.encode_ordinary(text or "")
        r = out[i, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()]
        assert r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert round_trip_digest(docs).count() == len(rows)
    assert round_trip_digest(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_random_texts_and_code_points(name):
    codec = Codec(public_tokenizers.path(name))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(5)
    pool = [*"ab  \n\t'sdltrveém😀日本12!?-—\x1c\x85\r\x00", "'s", "'ll", "the ", "ing", "<|endoftext|>"]
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 60))) for _ in range(5000)]
    texts += [f"a{chr(c)}b 1{chr(c)}2 {chr(c)}{chr(c)} !{chr(c)}?" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c % 41 == 0)]
    for at in range(0, len(texts), 50_000):
        part = texts[at : at + 50_000]
        ids = codec.encode(part)
        assert ids.to_pylist() == library.encode_ordinary_batch(part)
        assert codec.decode(ids).to_pylist() == [t.encode() for t in part]


def test_model_alone_reaches_every_token():
    codec = Codec(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    pieces = [t.decode("latin-1").translate(codec.to_characters) for t in codec.tokens]
    assert codec.model.encode(pieces) == [[i] for i in range(len(pieces))]
    assert len(set(byte_characters())) == 256


def test_small_vocabulary_merges_by_rank_leftmost_first():
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"bc", b"aa", b"abc"]
    model = sentencepiece.SentencePieceProcessor(model_proto=piece_model(tokens))
    assert model.encode(["abc", "bcb", "aaa", "aab"]) == [[259], [257, 98], [258, 97], [97, 256]]


def test_decoding_alone(spark):
    rows = spark.createDataFrame([(1, [72, 256, 300]), (2, None), (3, []), (3, [])], "doc_id long, ids array<int>")
    tokens = Codec(public_tokenizers.path("byte_bpe_50k.tiktoken")).tokens
    out = sorted(((r.doc_id, None if r.decoded is None else bytes(r.decoded)) for r in decode(rows).collect()), key=str)
    assert out == [(1, tokens[72] + tokens[256] + tokens[300]), (2, None), (3, b""), (3, b"")]
    with pytest.raises(Exception, match="outside the vocabulary"):
        decode(spark.createDataFrame([(1, [50_256])], "doc_id long, ids array<int>")).collect()
    texts = spark.createDataFrame([(1, "round trip"), (2, None)], "key long, body string")
    back = decode(encode(texts, "key", "body"), "key")
    assert {(r.key, bytes(r.decoded)) for r in back.collect()} == {(1, b"round trip"), (2, b"")}
