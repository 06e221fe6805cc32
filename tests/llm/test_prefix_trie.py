"""The trie of conversation prefixes against a plain one built in memory."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.prefix_trie import conversation_trie, in_parts, keyed, nodes_of, peeled, prefix_trie, rebuilt, running

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = "conv_id long, turn long, role string, text string"


def content(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0, role, content(role, text)), (role, text)))
    turns = {c: [t for _, t in sorted(v, key=lambda x: x[0])] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 6
        seq = tuple(turns.get(c - c % 100, [])[:h] + turns[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(saved[k] for k in children[node])
    out = [(min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), leaves[k], saved[k], hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest()) for k, m in members.items()]
    return sorted(out, key=str)


def check(df):
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, conversation_trie(df).select(*COLUMNS).collect()), key=str) == brute(rows)


@pytest.fixture(scope="module")
def awkward(spark):
    """Shared beginnings, ties, nulls, repeated rows, ids without turns of their own, a group without its first conversation."""
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["", "a", "bb", "éé日"])) for c in [*range(60), *range(300, 340), 777, 778, 100_000] for t in range(rng.randint(1, 9))]
    rows += [(1000 + c, t, "user", "same") for c in range(40) for t in range(7)]
    rows += [(5, None, None, None), (5, None, None, "x"), (6, 2, "user", "a"), (6, 2, "user", "a"), (6, 2, "user", "a"), (7, 0, "userb", "b"), (7, 0, "user", "bb"), (None, 0, "user", "lost"), (0, 3, None, "long " * 200_000)]
    rows += [(1200 + c, 0, "user", "one turn only") for c in range(30)]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("depth", "place", "content", "size", "path", "_part", "_u")}).repartition(6).cache()


def test_awkward_conversations(awkward):
    check(awkward)


def test_given_tables(spark, sf_dir):
    check(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def test_long_conversation_and_long_chain_of_prefixes(spark):
    rows = [(0, t, "user", f"t{t}") for t in range(3000)] + [(100, t, "user", f"t{t}") for t in range(2999)]
    rows += [(10_000 + 100 * i, t, "user", "ab"[t % 2]) for i in range(40) for t in range(i + 1)]  # each one the beginning of the next
    df = spark.createDataFrame(rows, SCHEMA)
    check(df)
    waves = peeled(nodes_of(keyed(*rebuilt(df))))
    assert waves.count() < 10  # paths, for over 3,000 nodes


def test_empty_and_no_ids(spark):
    assert conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert conversation_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).count() == 0


def test_sums_go_on_from_part_to_part(spark):
    rows = spark.range(5000).select((F.col("id") % 7 == 3).cast("int").alias("k"), F.col("id").alias("v")).union(spark.createDataFrame([(2, 9), (2, 9), (2, 9)], "k int, v long"))
    parted = in_parts(rows, "k", [F.desc("v")])
    assert parted.select("_part").distinct().count() > 4
    out = running(parted, "k", [F.desc("v")], {"s": F.col("v"), "n": F.lit(1)}, {"all": F.col("v")}).toPandas().sort_values(["k", "n"])
    for _, part in out.groupby("k"):
        assert list(part.n) == list(range(1, len(part) + 1))
        assert list(part.s) == list(part.v.cumsum()) and (part["all"] == part.v.sum()).all() and part.v.is_monotonic_decreasing


def test_equal_keys_of_other_prefixes_are_an_error(spark):
    turns = spark.createDataFrame([(1, 1, bytearray(b"x"), 1), (2, 1, bytearray(b"y"), 1)], "conv_id long, place long, content binary, size long")
    rows = keyed(turns, turns.select("conv_id"))
    clash = rows.withColumns({"ka": F.lit(1).cast("long"), "kb": F.lit(1).cast("long")})
    with pytest.raises(Exception, match="two prefixes have one key"):
        nodes_of(clash).count()
    assert prefix_trie(turns, turns.select("conv_id")).count() == 3
