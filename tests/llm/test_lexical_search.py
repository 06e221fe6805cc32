"""Ranked search against a full scan of all documents."""

import collections
import math
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import lexical_search
from ledgerloom.llm.lexical_search import build_index, query_terms, ranked_search, search

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(t):
    return re.findall(TERM, (t or "").translate(LOWER))


def brute(docs, items, k=10):
    own = [(i, collections.Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(1 for _, c in own if c), sum(c.total() for _, c in own)
    df = collections.Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in own:
            s = 0
            for t in set(terms(text)) & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                m = 100 - 90 + 90 * c.total() * n_docs // total
                s += w * (1000000000 * c[t] // (1000 * c[t] + 8 * m))
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


EXTRA = [(None, "alpha beta"), (900_001, None), (900_002, ""), (900_003, "--- !!"), (900_004, "É日 É日 x_y É日"), (900_005, "alpha " * 30_000 + "beta"), (900_006, "the the of"), (900_006, "the the of"), (900_007, "ALPHA\x00beta")]
QUERIES = [(None, "alpha of"), (1, "É日 alpha beta"), (1, "É日 alpha beta"), (2, None), (3, "...!"), (4, "nosuchterm"), (5, "alpha alpha ALPHA")]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    base = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame(EXTRA, base.schema)
    again = base.where("doc_id < 9")
    return base.union(extra).union(again).withColumns({c: F.lit("clash") for c in ("q", "id", "shard", "terms", "rank", "score", "item_id", "doc")}).repartition(5).cache()


@pytest.fixture(scope="module")
def items(spark, sf_dir):
    base = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return base.union(spark.createDataFrame(QUERIES, base.schema)).withColumns({c: F.lit(1) for c in ("q", "id", "terms", "doc_id")}).cache()


@pytest.fixture(scope="module")
def expected(docs, items):
    return brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])


def test_best_documents_equal_a_full_scan(docs, items, expected):
    assert len(expected) > 300
    assert got(ranked_search(docs, items)) == expected


def test_small_shards_blocks_and_whole_vocabulary(docs, items, expected, monkeypatch):
    assert got(ranked_search(docs, items, vocabulary_terms=3, shard_docs=7, shard_bytes=20_000)) == expected
    queries = query_terms(items).cache()
    found = search(build_index(docs), queries, block_terms=40).join(queries, "q").select(F.col("id").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")
    assert got(found) == expected
    assert got(ranked_search(docs, items, k=1)) == sorted((r for r in expected if r[1] == 1), key=str)


def test_many_equal_scores_are_told_apart_by_id(spark):
    docs = spark.createDataFrame([(i, "one two" if i % 2 else "one two three") for i in range(5000, 0, -1)] + [(9000, "four")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "three one"), (2, "two"), (3, "four")], "item_id long, text string")
    out = got(ranked_search(docs, items, shard_docs=900))
    assert out == brute([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()])
    assert [r[2] for r in sorted(out) if r[0] == 1] == list(range(2, 22, 2))


def test_non_essential_lists_are_probed_only_for_candidates(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    n = 60_000
    common, rare = np.sort(rng.choice(n, 50_000, replace=False)), np.sort(rng.choice(n, 40, replace=False))
    lists = [(common, rng.integers(1, 50, len(common))), (rare, rng.integers(1000, 2000, len(rare)))]
    best, probed = lexical_search.Best(10), []
    search_sorted = np.searchsorted
    monkeypatch.setattr(lexical_search.np, "searchsorted", lambda a, v, *x: (probed.append(np.size(v)) if a is common and np.size(v) > 2 else None, search_sorted(a, v, *x))[1])
    lexical_search.max_score(lists, n, list(range(n)), best)
    total = np.zeros(n, np.int64)
    for places, add in lists:
        total[places] += add
    assert best.scores == sorted(total.tolist(), reverse=True)[:10]
    assert sum(probed) <= len(rare)


def test_empty_tables(docs, items):
    assert ranked_search(docs.limit(0), items).count() == 0
    assert ranked_search(docs, items.limit(0)).count() == 0
