import pytest

import corpus_pipeline
from ledgerloom.llm.common import materialise


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
        out.append(docs)
    return out


def test_stages_only_drop_and_keep_the_columns(spark, sf_dir, stages):
    before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for after in stages[:-1]:
        assert after.columns == before.columns
        assert after.join(before, "doc_id", "left_anti").count() == 0
        before = after
    assert stages[0].count() < 200 and stages[1].count() == stages[0].count()


def test_quality_keeps_what_its_operator_keeps(spark, sf_dir, stages):
    from ledgerloom.llm.quality import quality_rules

    kept = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).where("kept").select("doc_id")
    assert {r[0] for r in kept.collect()} == {r[0] for r in stages[0].select("doc_id").collect()}


def test_one_of_each_group_stays_and_leaks_go(spark, sf_dir, stages):
    from ledgerloom.llm.decontaminate import contaminated
    from ledgerloom.llm.simhash import near_duplicates

    groups = near_duplicates(stages[1], shingle=corpus_pipeline.PIPELINE_SHINGLE).toPandas()
    assert set(groups.component_id) == {r[0] for r in stages[2].select("doc_id").collect()}
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = {r[0] for r in contaminated(stages[2], bench).select("doc_id").collect()}
    assert {r[0] for r in stages[3].select("doc_id").collect()} == set(groups.component_id) - leaks


def test_packing_has_every_document(stages):
    assert {r[0] for r in stages[4].select("doc_id").collect()} == {r[0] for r in stages[3].select("doc_id").collect()}


def test_near_dedup_keeps_rows_without_ids(spark, sf_dir):
    long = " ".join(f"w{i}" for i in range(80))
    other = " ".join(f"v{i}" for i in range(80))
    third = " ".join(f"u{i}" for i in range(80))
    rows = [(None, long, "en", None, 1), (None, other, "en", None, 1), (None, other, "en", None, 1), (3, third, "en", None, 1), (3, third, "en", None, 1), (None, third, "en", None, 1), (9, third + " x", "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.STAGES[2][1](spark, docs, sf_dir).collect()
    assert sorted((r.doc_id or -1, r.text[:2]) for r in left) == [(-1, "v0"), (-1, "w0"), (3, "u0")]


def test_stages_take_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    assert all(stage(spark, docs, sf_dir).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_near_dedup_is_that_of_all_pairs(spark, sf_dir, stages, monkeypatch):
    """Groups of five-word similarity 0.8 or more by brute force, with near copies on both sides of the line and a dense group."""
    import random
    import re

    from ledgerloom.llm import similar_sets

    monkeypatch.setattr(similar_sets, "BLOCK", 8)  # several blocks to a key
    monkeypatch.setattr(similar_sets, "SMALL_KEY", 3)
    rng = random.Random(5)
    rows = [(r.doc_id, r.text) for r in stages[1].select("doc_id", "text").collect()]
    texts = [" ".join(f"q{rng.randrange(3000)}" for _ in range(120)) for _ in range(12)]
    for k, t in enumerate([t for t in texts for _ in range(8)] + [texts[0]] * 60):
        w = t.split(" ")
        for at in rng.sample(range(120), rng.randrange(1, 5)):
            w[at] = f"r{rng.randrange(10**6)}"
        rows.append((10_000 + k, " ".join(w)))
    rows += [(20_000 + i, t) for i, t in enumerate([None, "", " ", "one two", "One  two", "one two three"])]

    def shingles(t):
        w = re.findall("[^\x20\x09-\x0D]+", (t or "").lower())
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids, sides = sorted(sets), [0, 0]
    for k, b in enumerate(ids):
        for a in ids[:k]:
            shared = len(sets[a] & sets[b])
            if shared:
                near = shared >= 0.8 * len(sets[a] | sets[b])
                sides[near] += 0.7 < shared / len(sets[a] | sets[b]) < 0.9
                if near and find(a) != find(b):
                    root[max(find(a), find(b))] = min(find(a), find(b))
    assert min(sides) > 50
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", None, 1) for i, t in rows], schema)
    left = corpus_pipeline.STAGES[2][1](spark, docs, sf_dir).collect()
    assert sorted(r.doc_id for r in left) == sorted({find(i) for i in ids})


def test_near_dedup_takes_its_candidates_from_fingerprints(spark, sf_dir, monkeypatch):
    """Groups of fingerprints are the first candidates, and each is verified: a wrong group joins nothing."""
    from pyspark.sql import functions as F

    from ledgerloom.llm import simhash

    texts = [" ".join(f"{c}{i}" for i in range(60)) for c in "xyz"]
    rows = [(i, t, "en", None, 1) for i, t in enumerate([*texts, texts[0] + " q"])]
    docs, seen = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), []

    def one_group(*args):
        seen.append(args[0].columns)
        return args[0].select("doc_id", F.xxhash64("text").alias("text_hash"), F.lit(0).cast("long").alias("fp"), F.lit(0).cast("long").alias("component_id"))

    monkeypatch.setattr(simhash, "fingerprint_groups", one_group)
    left = corpus_pipeline.STAGES[2][1](spark, docs, sf_dir).collect()
    assert len(seen) == 1 and sorted(r.doc_id for r in left) == [0, 1, 2]


@pytest.mark.parametrize("sampled, most", [(1, 1_000_000), (1, 0)])
def test_counted_shingles_decide_no_group(spark, monkeypatch, sampled, most):
    """The sample of common_shingles and its limit give an order of shingles only: with all counted or none, groups are those of all pairs."""
    import random

    from ledgerloom.llm import similar_sets

    monkeypatch.setattr(similar_sets, "MAX_COMMON", most)
    rng = random.Random(11)
    texts = []
    for k in range(10):
        words = [f"q{rng.randrange(40)}" if k % 2 else f"u{k}x{i}" for i in range(90)]
        for _ in range(5):
            w = list(words)
            for at in rng.sample(range(90), rng.randrange(4)):
                w[at] = f"r{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    shingles = lambda t: {tuple(t.split(" ")[i : i + 5]) for i in range(86)}
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if len(x & y) >= 0.8 * len(x | y):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    assert 10 < len(set(root)) < len(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counted = similar_sets.common_shingles(docs, 5, sampled, 1)[0]
    assert (len(counted) == 0) == (sampled > 1 or most == 0) and len(counted) <= most
    found = similar_sets.near_duplicates(docs, shingle=5, sampled=sampled, min_sample=1)
    assert [r.component_id for r in found.orderBy("doc_id").collect()] == root
