"""Longest previous factors against a comparison of every pair of suffixes."""

import random

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import suffix_dedup as S


@pytest.mark.parametrize("values", [[], [3], [1, 1, 1, 1], [5, 4, 3, 2], [1, 2, 3, 2, 2, 9, 1], list(np.random.default_rng(3).integers(0, 9, 300))])
def test_previous_smaller(values):
    expected = [max((j for j in range(i) if values[j] < values[i]), default=-1) for i in range(len(values))]
    assert S.previous_smaller(np.array(values, np.int64)).tolist() == expected


@pytest.mark.parametrize("seed", range(8))
def test_factors_match_all_pairs(seed):
    draw = random.Random(seed)
    word = lambda n: bytes(draw.choice(b"ab") for _ in range(n))
    base, contexts, docs = word(60), [], []
    for _ in range(14):
        c = bytearray(base[draw.randint(0, 8) :] + word(20))
        if draw.random() < 0.3:
            c[draw.randrange(len(c))] = 0
        contexts.append(bytes(c)[: 2 * S.LENGTH - S.GRAM])
        docs.append(draw.randint(0, 5))
    ends = np.cumsum([len(c) for c in contexts])
    suffixes = [(e - len(c) + o, e, d) for c, e, d in zip(contexts, ends, docs, strict=True) for o in range(len(c) - S.LENGTH + 1)]
    text = b"".join(contexts)
    start, end, doc = (np.array(x, np.int64) for x in zip(*suffixes, strict=True))
    found = S.longest_previous_factors(np.frombuffer(text, np.uint8), start, end, doc)

    def common(i, j):
        n = 0
        while n < S.DEPTH and start[i] + n < end[i] and start[j] + n < end[j] and text[start[i] + n] == text[start[j] + n]:
            n += 1
        return n

    for i in range(len(doc)):
        best = max((common(i, j) for j in range(len(doc)) if doc[j] < doc[i]), default=0)
        assert (found[i] >= S.LENGTH) == (best >= S.LENGTH)  # what is removed is exact
        assert found[i] <= best and (best >= S.LENGTH or found[i] == best)  # beyond LENGTH the bytes behind a context may order it


def slice_of(texts):
    n = len(texts)
    return pa.record_batch([pa.array(range(n), pa.int64()), pa.array(range(100, 100 + n), pa.int64()), pa.array(texts)], names=["doc_id", "text_hash", "text"])


def compared(texts, turn=0, turns=1):
    names = [x.split()[0] for x in S.PACKED.split(", ")]
    rows = list(S.pack_anchors(slice_of(texts), 1 if turns == 1 else 8, turn, turns))
    return pa.Table.from_pylist([dict(zip(names, r, strict=True)) for r in rows])


def test_contexts_that_share_a_gram_by_chance_are_not_fetched():
    """Before, every context was whose gram stood in another document, so their share grew with the corpus."""
    draw = random.Random(7)
    letters = lambda n: "".join(draw.choice("abcdefghij") for _ in range(n))
    chance, repeat = letters(24), letters(60)
    texts = [letters(100) + chance + letters(100) for _ in range(200)]
    assert not any(S.compare_contexts(compared(texts))["fetch"].to_pylist())
    found = S.compare_contexts(compared([*texts, letters(40) + repeat + letters(40), letters(9) + repeat]))
    assert {d for d, f in zip(found["doc_id"].to_pylist(), found["fetch"].to_pylist(), strict=True) if f} == {200, 201}


def test_turns_share_out_the_anchors():
    """Before, the anchors of all grams were on disk at once."""
    draw = random.Random(8)
    texts = ["".join(draw.choice("ab ") for _ in range(3000)) for _ in range(20)]
    whole, parts = S.unpack(compared(texts, 0, 1)), [S.unpack(compared(texts, turn, S.PASSES)) for turn in range(S.PASSES)]
    for k in (0, 1):
        assert sorted(zip(*(x.tolist() for x in whole[k][-3:]), strict=True)) == sorted(r for p in parts for r in zip(*(x.tolist() for x in p[k][-3:]), strict=True))
    assert max(len(p[0][0]) for p in parts) < 0.8 * len(whole[0][0])


def test_exactly_as_long_strings_at_any_place(spark):
    """Strings of 49 to 60 bytes, anchors anywhere in them, at the ends of texts as well, against brute force."""
    draw = random.Random(9)
    letters = lambda n: "".join(draw.choice("abcdefgh") for _ in range(n))
    shared = [letters(draw.randint(49, 60)) for _ in range(60)]
    texts = []
    for _ in range(300):
        texts.append(letters(draw.choice([0, 0, 3, 20, 90])) + draw.choice(shared) + letters(draw.choice([0, 0, 1, 18, 90])))
    seen, expected = set(), []
    for t in texts:
        windows = [t[k : k + S.LENGTH] for k in range(len(t) - S.LENGTH + 1)]
        gone = {k + j for k, w in enumerate(windows) if w in seen for j in range(S.LENGTH)}
        expected.append(len(gone))
        seen.update(windows)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.n_removed for r in S.remove_repeats(docs).orderBy("doc_id").collect()] == expected
    assert 50 < sum(e > 0 for e in expected) < 290
