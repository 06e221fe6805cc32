"""Words that clash under simple hashes, and special strings in any case, in packing and in similarity of shingles."""

import zlib

import numpy as np
import public_tokenizers
import pytest

from ledgerloom.llm import bytetext
from ledgerloom.llm.bytetext import prefix_sums, range_hash, word_hash
from ledgerloom.llm.packing import END, holders, pack, tokenizer
from ledgerloom.llm.similar_sets import at_own_key


def thue_morse(letters, n=2048):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


TWINS = [thue_morse("ab"), thue_morse("ba")]
SPECIAL = ["<|ENDOFTEXT|>", "a <|EndOfText|> b", "x <|ENDOFTEXT|> y", "x<|endoftext|>Y<|StartOfText|>Z", "A<|B", "<| ENDOFTEXT|>", "É<|ENDOFTEXT|>é", "<|", "A B<", "|>\x00<|\x00A", "<|endoftext|>", "<|STARTOFTEXT|><|startoftext|>"]


def test_words_that_clash_modulo_powers_of_two():
    data = np.frombuffer("".join(TWINS).encode(), np.uint8)
    start, end = np.array([0, 2048]), np.array([2048, 4096])
    assert len(set(range_hash(prefix_sums(data), start, end).tolist())) == 1
    assert len(set(word_hash(data, start, end).tolist())) == 2
    long_ = np.frombuffer((thue_morse("ab", 1 << 14) + thue_morse("ba", 1 << 14)).encode(), np.uint8)
    assert len(set(word_hash(long_, np.array([0, 1 << 14]), np.array([1 << 14, 1 << 15])).tolist())) == 2


def test_hash_is_that_of_the_bytes_wherever_they_stand(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    start = rng.integers(0, 4990, 3000)
    end = np.minimum(start + rng.choice([0, 1, 2, 3, 7, 8, 9, 16, 17, 40], 3000), 5000)
    for longest in (bytetext.LONG_WORD, 12):
        monkeypatch.setattr(bytetext, "LONG_WORD", longest)
        found = {}
        for h, a, b in zip(word_hash(data, start, end).tolist(), start.tolist(), end.tolist(), strict=True):
            found.setdefault(data[a:b].tobytes(), set()).add(h)
        assert all(len(v) == 1 for v in found.values()) and len(set().union(*found.values())) == len(found)
    assert word_hash(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []


@pytest.mark.parametrize("together", [True, False])
def test_packing_of_clashing_words_and_special_strings(spark, together):
    texts = [*TWINS, *SPECIAL, *[f"word {s} word" for s in SPECIAL]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(1 if together else 5)
    model = tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {}
    for r in pack(docs).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    for i, text in enumerate(texts):
        ids = np.array([*model.encode(text, add_special_tokens=False).ids, END], "<u4")
        own = sorted(pieces[i], key=lambda r: r.start)
        assert own[0].doc_tokens == len(ids), text
        assert [r.ids_crc32 for r in own] == [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own], text
        assert sum(r.length for r in own) == len(ids)


def test_a_pair_comes_out_at_one_key():
    low = [np.array(x, np.int64) for x in ([1, 5, 9], [5, 9], [7], [])]
    at = lambda key, r, c: at_own_key(key, low, low, np.array(r), np.array(c)).tolist()
    assert at(5, [0, 0, 2, 3], [1, 2, 2, 3]) == [True, True, False, True]
    assert at(9, [0, 1], [1, 0]) == [False, False]
    assert at(1, [], []) == []


def test_holders_of_tokens():
    rng = np.random.default_rng(2)
    for sizes in (rng.integers(0, 9, 50), rng.integers(300, 900, 150), np.zeros(3, np.int64), np.zeros(0, np.int64)):
        docs = [rng.integers(0, 70, n) for n in sizes]
        ids = np.concatenate([*docs, np.zeros(0, np.int64)]).astype(np.uint32)
        assert holders(ids, sizes, 70).tolist() == [sum(t in d for d in docs) for t in range(70)]
