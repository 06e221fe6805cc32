"""Trie of conversation prefixes: every distinct sequence of first turns is a node; subtree totals by leaf peeling.

Keys. A turn's content is a SHA-256; a prefix's key is the sum, in four lanes of 32 bits, of a hash of depth and content of
each of its turns. Sums are taken along each conversation (in_parts, running): rows are dealt out by ranges of their order,
summed within a part, and what earlier parts hold is added, so a conversation of any length is spread over many tasks.
A node whose members differ in their last content or their parent is an error, so by induction over depth equal keys are
equal prefixes, and a clash can't pass unseen.

Peeling. Each node belongs to the path of its longest member (of the least id), so the nodes of a chain are one path, and
paths form a tree of few levels whatever the depth. A path holds a counter of the paths that hang on it and have not
reported; those with none left are complete, send leaves and saved tokens to the path that they hang on and leave the
table; rounds go on until only the root's path is left. Each round is a sum per receiver, joined to what still waits, and
is written. Then sums along each path give every node's totals.

Defined cases: null role or text is empty; a null turn comes first, equal turns are ordered by role, then by the content's
hash, repeated rows are turns each; rows without a conversation belong to none and are left out; conv_id % 100 is Spark's
(sign of the id); a conversation that borrows nothing and has no turns left is a member of the root only; an empty table
gives an empty result; texts of any length are read once, by the hash; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

GROUP = 100
SHARED = 6
LANES = ("_l0", "_l1", "_l2", "_l3")
MASK = (1 << 32) - 1
NODE = ("depth", "ka", "kb")


def in_parts(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """df written with _part: ranges of (key, order), as many as shuffle partitions and about equal. Rows equal in both must be equal in all columns."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = df.withColumn("_u", F.monotonically_increasing_id())  # so that even equal rows can be dealt to several parts
    return materialise(own.repartitionByRange(n, F.col(key), *order, F.col("_u")).withColumn("_part", F.spark_partition_id()))


def running(parted: DataFrame, key: str, order: list[Column], sums: dict[str, Column], totals: dict[str, Column] | None = None) -> DataFrame:
    """parted with, for each name, the sum over the rows of its key up to this row, or over all of them (totals).

    parted: as written by in_parts. Only the first and the last key of a part can go on in others; their sums by part, two
    rows a part at most, are added up and sent to all tasks.
    """
    totals = totals or {}
    edges = parted.groupBy("_part").agg(F.array_distinct(F.array(F.min(key), F.max(key))).alias("_k")).select("_part", F.explode("_k").alias(key))
    each = parted.join(F.broadcast(edges), ["_part", key]).groupBy("_part", key).agg(*[F.sum(v).alias(f"_b_{k}") for k, v in (sums | totals).items()])
    parts = Window.partitionBy(key).orderBy("_part")
    before = [F.coalesce(F.sum(f"_b_{k}").over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_b_{k}") for k in sums]
    whole = [F.sum(f"_b_{k}").over(Window.partitionBy(key)).alias(f"_b_{k}") for k in totals]
    carried = F.broadcast(each.select("_part", key, *before, *whole))
    here = Window.partitionBy("_part", key)
    local = parted.withColumns({f"_s_{k}": F.sum(v).over(here.orderBy(*order, "_u").rowsBetween(Window.unboundedPreceding, 0)) for k, v in sums.items()} | {f"_s_{k}": F.sum(v).over(here) for k, v in totals.items()})
    added = {k: F.col(f"_s_{k}") + F.coalesce(f"_b_{k}", F.lit(0)) for k in sums} | {k: F.coalesce(f"_b_{k}", f"_s_{k}") for k in totals}
    return local.join(carried, ["_part", key], "left").select(*parted.columns, *[v.alias(k) for k, v in added.items()])


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, content (SHA-256 of role and text), size (code points of the text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    content = F.unhex(F.sha2(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), "utf-8"), 256))
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), content.alias("content"), F.length(text).cast("long").alias("size"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, place, content, size) and conv_ids after each conversation has taken over the first turns of its group's first one."""
    turns = turns_of(conversations)
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("content")]
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    placed = running(in_parts(turns, "conv_id", order), "conv_id", order, {"place": F.lit(1)})
    first = turns.where(F.col("conv_id") % GROUP == 0).withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order))).where(F.col("place") < SHARED)
    heads = first.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.col("place").cast("long").alias("place"), "content", "size"))).alias("head"))
    members = materialise(turns.select("conv_id").distinct())
    taken = members.withColumn("_group", F.col("conv_id") - F.col("conv_id") % GROUP).join(heads.select(F.col("conv_id").alias("_group"), "head"), "_group")
    borrowed = taken.select("conv_id", F.explode("head").alias("x")).where(F.col("x.place") <= shared).select("conv_id", "x.place", "x.content", "x.size")
    return placed.where(F.col("place") > shared).select("conv_id", "place", "content", "size").union(borrowed), members


def keyed(turns: DataFrame, members: DataFrame) -> DataFrame:
    """A row for each conversation and depth, 0 included: conv_id, n_turns, depth, key (ka, kb), parent's key (pa, pb), content, size."""
    roots = members.select("conv_id", F.lit(0).cast("long").alias("place"), F.lit(b"").alias("content"), F.lit(0).cast("long").alias("size"))
    order = [F.asc("place")]
    parted = in_parts(turns.select(roots.columns).union(roots), "conv_id", order)
    deep = running(parted, "conv_id", order, {"_n": F.lit(1)}, {"_all": F.lit(1)}).withColumns({"depth": F.col("_n") - 1, "n_turns": F.col("_all") - 1}).drop("_n", "_all")
    digest = F.sha2(F.concat(F.col("depth").cast("string").cast("binary"), F.lit(b":"), F.col("content")), 256)
    lane = {f"_g{i}": F.when(F.col("depth") == 0, 0).otherwise(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")) for i in range(4)}
    summed = running(materialise(deep.withColumns(lane)), "conv_id", order, {name: F.col(f"_g{i}") for i, name in enumerate(LANES)})

    def key(lanes: list[Column]) -> list[Column]:
        lanes = [x.bitwiseAND(F.lit(MASK)) for x in lanes]
        return [F.shiftleft(a, 32).bitwiseOR(b) for a, b in (lanes[:2], lanes[2:])]

    ka, kb = key([F.col(name) for name in LANES])
    pa_, pb = key([F.col(name) - F.col(f"_g{i}") for i, name in enumerate(LANES)])
    return materialise(summed.select("conv_id", "n_turns", "depth", ka.alias("ka"), kb.alias("kb"), pa_.alias("pa"), pb.alias("pb"), "content", "size"))


def nodes_of(rows: DataFrame) -> DataFrame:
    """A row for each node: key and parent's key, conv_id, n_convs, path (its longest member), saved (of its own turn), n_children, parent's conv_id and path."""
    known = F.struct("content", "pa", "pb")
    found = rows.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max(F.struct("n_turns", (-F.col("conv_id")).alias("_minus"))).alias("_path"), F.min("size").alias("_size"), F.min(known).alias("_low"), F.max(known).alias("_high"))
    same = F.when(F.col("_low") == F.col("_high"), F.col("n_convs")).otherwise(F.raise_error(F.lit("two prefixes have one key")).cast("long"))
    nodes = materialise(found.select(*NODE, "_low.pa", "_low.pb", "conv_id", same.alias("n_convs"), (-F.col("_path._minus")).alias("path"), ((F.col("n_convs") - 1) * F.col("_size")).alias("saved")))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("ka"), F.col("pb").alias("kb")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("parent_conv_id"), F.col("path").alias("parent_path"))
    return materialise(nodes.join(parents, ["depth", "pa", "pb"], "left").join(children, list(NODE), "left").drop("pa", "pb").fillna(0, ["n_children"]))


def peeled(nodes: DataFrame) -> DataFrame:
    """path, parent_path, joint (the depth at which it hangs there), leaves and saved of all that is below its top, of every path."""
    top = F.min_by("parent_path", "depth")
    paths = nodes.groupBy("path").agg(F.min("depth").alias("_top"), top.alias("parent_path"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"), F.sum("saved").alias("saved"))
    paths = materialise(paths.withColumn("joint", F.col("_top") - 1).drop("_top"))
    hung = paths.groupBy(F.col("parent_path").alias("path")).agg(F.count(F.lit(1)).alias("remaining"))
    waiting = materialise(paths.join(hung, "path", "left").fillna(0, ["remaining"]))
    complete = []
    while True:
        ready = waiting.where("remaining = 0")
        complete.append(ready.drop("remaining"))
        mail = ready.groupBy(F.col("parent_path").alias("path")).agg(F.count(F.lit(1)).alias("_n"), F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
        rest = waiting.where("remaining > 0")
        if rest.isEmpty():
            out = complete[0]
            for more in complete[1:]:
                out = out.union(more)
            return out
        told = rest.join(mail, "path", "left").fillna(0, ["_n", "_leaves", "_saved"])
        waiting = materialise(told.select("path", "parent_path", (F.col("leaves") + F.col("_leaves")).alias("leaves"), (F.col("saved") + F.col("_saved")).alias("saved"), "joint", (F.col("remaining") - F.col("_n")).alias("remaining")))


def end_digests(rows: DataFrame) -> DataFrame:
    """Node key and ends_sha256 of its members that end there, ids ascending and joined by commas, for nodes with such members.

    Ids are sorted and joined by parts of a range; one hash then takes a node's joined parts in order, as a stream.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = rows.where("depth = n_turns").select(*NODE, "conv_id")
    parted = ends.repartitionByRange(n, *NODE, "conv_id").withColumn("_part", F.spark_partition_id())
    joined = F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",")
    pieces = parted.groupBy(*NODE, "_part").agg(joined.alias("ids")).repartition(n, *NODE).sortWithinPartitions(*NODE, "_part")

    def run(batches):
        last, state = None, None
        for batch in batches:
            out = []
            for *node, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
                if node == last:
                    state.update(b",")
                else:
                    if last is not None:
                        out.append((*last, state.hexdigest()))
                    last, state = node, hashlib.sha256()
                state.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], [*NODE, "ends_sha256"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*last, state.hexdigest())], [*NODE, "ends_sha256"])

    return pieces.select(*NODE, "ids").mapInArrow(run, "depth bigint, ka bigint, kb bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """A row for each node: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, place (their order, distinct in a conversation), content (binary), size; members: all conv_ids, each once.
    """
    rows = keyed(turns, members)
    nodes = nodes_of(rows)
    below = peeled(nodes).where("parent_path is not null").groupBy(F.col("parent_path").alias("path"), F.col("joint").alias("depth")).agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
    own = nodes.join(below, ["path", "depth"], "left").fillna(0, ["_leaves", "_saved"])
    own = own.withColumns({"_leaves": F.col("_leaves") + (F.col("n_children") == 0).cast("long"), "_saved": F.col("_saved") + F.col("saved")})
    upwards = [F.desc("depth")]
    out = running(in_parts(own, "path", upwards), "path", upwards, {"n_leaves": F.col("_leaves"), "saved_tokens": F.col("_saved")})
    nothing = hashlib.sha256().hexdigest()
    return out.join(end_digests(rows), list(NODE), "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    return prefix_trie(*rebuilt(conversations))
