"""Removal of byte strings that an earlier document also holds, exact for every string of LENGTH bytes.

Candidates. In each window of LENGTH bytes the places with the least hash of GRAM bytes are anchors (winnowing): equal
windows have equal anchors at equal offsets, so only one in some eighteen places has to be compared across documents. An
anchor's context is the up to 2 * LENGTH - GRAM bytes that all windows over it span. Anchors are shuffled as packed
arrays by gram hash, in PASSES turns of which each takes a share of the grams, so that only a share is on disk at once.
Where a smaller document holds the same context, the whole context is a repeat; contexts repeated inside one task's slice
are settled there, so a passage found everywhere sends one anchor per slice.

Longest previous factors. What is left are first contexts. The windows over an anchor are of SPANS kinds, by where they start;
those of a kind have some 42 bytes in common, so only contexts of which another document's first contexts have the bytes of
one kind too can share a window: ends of repeats, and little chance, where grams alone meet by chance the more, the larger
the corpus. Their bytes are fetched, and per bucket of grams a suffix array (to DEPTH bytes) is built of
the suffixes whose first LENGTH bytes have a hash that another document has too: no other can have a factor that long. Along suffix order the previous and the next suffix of a smaller document are the earlier
matches; the longer of the two common beginnings is the longest previous factor (up to DEPTH bytes, inside both contexts).
Factors of LENGTH bytes or more go from the later copy; of factors that another one covers nothing is written.

Documents are shuffled by id for each of two joins, the first of which ends with the factors written and its shuffles
deleted; everything else is in packed arrays.

Defined cases: null text is empty; texts shorter than LENGTH keep all; rows with one id never remove each other's bytes;
repeated rows give repeated results; a null id counts as larger than every other; an empty table gives an empty result;
one very long text is one slice of work; ids are whole numbers (others fail the job), of which 2**63 - 1 stands for null; other columns are ignored. Bytes are UTF-8; what is kept may cut characters.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import bytes_of, mix, powers, prefix_sums, range_hash, slices
from .common import drop_written, materialise, ship_package, shuffles_deleted, written

LENGTH = 50
GRAM = 16
DEPTH = 64  # suffixes are ordered by so many bytes, LENGTH or more
BUCKET_BYTES = 8_000_000  # text whose anchors meet in one bucket, so that buckets grow in number, not in size
REACH = LENGTH - GRAM  # an anchor's windows start at most so far before it
SPANS = [(low, min(low + 8, REACH)) for low in range(0, REACH + 1, 9)]  # kinds of windows: they start so far before an anchor
PASSES = 2
LAST = np.int64(2**63 - 1)
PACKED = "bucket int, grams binary, contexts binary, spans binary, counts binary, places binary, doc_ids binary, text_hashes binary"
MARKS = "doc_id bigint, text_hash bigint, places array<int>, fetch boolean"
FACTORS = "doc_id bigint, text_hash bigint, places array<int>, lengths array<int>"


def sliding(a: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over a[i : i + width], by doubling."""
    out, span = a, 1
    while span < width:
        step = min(span, width - span)
        out = pick(out[:-step], out[step:])
        span += step
    return out


def anchors_of(data: np.ndarray, offsets: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all anchors, and the gram hash at every place."""
    n = len(data) - GRAM + 1
    if n < REACH + 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    _, down = powers(1 << max(16, int(len(sums)).bit_length()))
    grams = mix((sums[GRAM : GRAM + n] - sums[:n]) * down[:n])
    least = sliding(grams, REACH + 1, np.minimum)
    valid = np.ones(len(least), bool)  # windows inside one text
    for k in range(len(offsets) - 1):
        valid[max(offsets[k], offsets[k + 1] - LENGTH + 1) : offsets[k + 1]] = False
    # a place is an anchor if it equals the least of some valid window that starts up to REACH before it
    reach = np.concatenate([np.zeros(REACH, np.uint64), np.where(valid, least, np.uint64(0)), np.zeros(REACH, np.uint64)])
    most = sliding(reach, REACH + 1, np.maximum)
    return np.flatnonzero(most[:n] == grams), grams


def by_bucket(bucket: np.ndarray):
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(bucket[part[0]]), part


def planes(numbers: np.ndarray) -> bytes:
    """All first bytes, then all second ones and so on, so that the zeros of small numbers stand together."""
    return numbers.view(np.uint8).reshape(len(numbers), -1).T.tobytes()


def from_planes(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def pack_anchors(part: pa.RecordBatch, buckets: int, turn: int = 0, turns: int = 1):
    """Rows of PACKED for a slice and the grams of one turn: anchors to compare, and (without grams) places already known as repeats."""
    data, offsets = bytes_of(part.column("text"))
    ids, hashes = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "text_hash"))
    sums = prefix_sums(data)
    at, grams = anchors_of(data, offsets, sums)
    at = at[(grams[at] >> np.uint64(32)) % np.uint64(buckets) % np.uint64(turns) == turn]
    owner = np.searchsorted(offsets, at, "right") - 1
    start, end = np.maximum(at - REACH, offsets[owner]), np.minimum(at + LENGTH, offsets[owner + 1])
    contexts = mix(range_hash(sums, start, end) + (at - start).astype(np.uint64))
    spans = np.stack([range_hash(sums, np.maximum(at - low, start), np.minimum(at - high + LENGTH, end)) >> np.uint64(48) for low, high in SPANS]).astype(np.uint16)
    order = np.lexsort((ids[owner], contexts))
    new = np.ones(len(order), bool)
    new[1:] = np.diff(contexts[order]) != 0
    least = ids[owner[order[new]]][np.cumsum(new) - 1] if len(order) else ids[:0]
    known = np.zeros(len(at), bool)
    known[order] = ids[owner[order]] > least
    bucket = (grams[at] >> np.uint64(32)).astype(np.int64) % buckets
    place = (at - offsets[owner]).astype(np.uint32)
    for settled in (False, True):
        own = np.flatnonzero(known == settled)
        for b, rows in by_bucket(bucket[own] if not settled else owner[own] % buckets):
            rows = own[rows]
            docs, counts = np.unique(owner[rows], return_counts=True)  # rows are in the order of their documents
            keys = (b"",) * 3 if settled else ((grams[at[rows]] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), contexts[rows].tobytes(), spans[:, rows].T.tobytes())
            yield (b, *keys, planes(counts.astype(np.uint32)), planes(place[rows]), planes(ids[docs]), hashes[docs].tobytes())


def unpack(table: pa.Table):
    """Arrays gram, context, spans (a row for each), id, text hash, place of all anchors; the last three of settled places."""
    kinds = (np.uint32, np.uint64, (np.uint16, len(SPANS)), np.int64, np.int64, np.uint32)
    open_, known = tuple([] for _ in kinds), ([], [], [])
    for *keys, n, p, d, h in zip(*[table.column(x.split()[0]).to_pylist() for x in PACKED.split(", ")[1:]], strict=True):
        counts = from_planes(n, np.uint32)
        last = (np.repeat(from_planes(d, np.int64), counts), np.repeat(np.frombuffer(h, np.int64), counts), from_planes(p, np.uint32))
        first = [np.frombuffer(x, k) for x, k in zip(keys, kinds[:3], strict=True)]
        for to, x in zip(*((open_, (*first, *last)) if keys[0] else (known, last)), strict=True):
            to.append(x)
    join = lambda lists, types: [np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(lists, types, strict=True)]
    return join(open_, kinds), join(known, kinds[3:])


def held_by_others(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Which of the keys another document has too."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.argsort(keys)
    new = np.append(True, np.diff(keys[order]) != 0)
    first = np.flatnonzero(new)
    shared = np.minimum.reduceat(docs[order], first) != np.maximum.reduceat(docs[order], first)
    held = np.zeros(len(keys), bool)
    held[order] = shared[np.cumsum(new) - 1]
    return held


def mark_rows(ids, hashes, places, fetch: bool) -> pa.Table:
    """Rows of MARKS: places listed by document."""
    order = np.lexsort((places, hashes, ids))
    ids, hashes, places = ids[order], hashes[order], places[order].astype(np.int32)
    new = np.ones(len(ids), bool)
    new[1:] = (np.diff(ids) != 0) | (np.diff(hashes) != 0)
    first = np.flatnonzero(new)
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(ids)).astype(np.int32)), pa.array(places))
    return pa.table({"doc_id": ids[first], "text_hash": hashes[first], "places": lists, "fetch": np.full(len(first), fetch)})


def compare_contexts(table: pa.Table) -> pa.Table:
    """For a bucket: repeats of a whole context, and (fetch) first contexts that another one may share a window with.

    If a smaller document shares a window, so does the first document of its context, so first contexts are enough.
    """
    (grams, contexts, spans, ids, hashes, places), known = unpack(table)
    order = np.lexsort((ids, contexts, grams))
    grams, contexts, spans, ids, hashes, places = (x[order] for x in (grams, contexts, spans, ids, hashes, places))
    new_gram = np.ones(len(ids), bool)
    new_gram[1:] = np.diff(grams) != 0
    new = new_gram.copy()
    new[1:] |= np.diff(contexts) != 0
    least = ids[new][np.cumsum(new) - 1] if len(ids) else ids
    repeat = ids > least
    own = np.flatnonzero(~repeat)
    fetch = np.zeros(len(ids), bool)
    for span in spans[own].T:
        fetch[own] |= held_by_others(np.cumsum(new_gram)[own] << 16 | span, ids[own])
    whole = [np.concatenate([x[repeat], y]) for x, y in zip((ids, hashes, places), known, strict=True)]
    return pa.concat_tables([mark_rows(*whole, False), mark_rows(ids[fetch], hashes[fetch], places[fetch], True)])


def pack_contexts(part: pa.RecordBatch, buckets: int):
    """Rows bucket, data, lengths, lefts, ids, text hashes, places: the contexts that were asked for."""
    data, offsets = bytes_of(part.column("text"))
    places = part.column("places")
    owner = np.repeat(np.arange(len(part)), places.value_lengths().to_numpy(zero_copy_only=False))
    at = places.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + offsets[owner]
    ids, hashes = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "text_hash"))
    grams = range_hash(prefix_sums(data), at, at + GRAM)
    start, end = np.maximum(at - REACH, offsets[owner]), np.minimum(at + LENGTH, offsets[owner + 1])
    for b, rows in by_bucket((grams >> np.uint64(32)).astype(np.int64) % buckets):
        length = end[rows] - start[rows]
        chars = np.repeat(start[rows] - np.cumsum(length) + length, length) + np.arange(length.sum())
        yield (b, data[chars].tobytes(), length.astype(np.uint8).tobytes(), ids[owner[rows]].tobytes(), hashes[owner[rows]].tobytes(), (start[rows] - offsets[owner[rows]]).astype(np.uint32).tobytes())


def words_of(data: np.ndarray) -> np.ndarray:
    """The eight bytes at every place as a number that sorts like them; zeros behind the end."""
    padded = np.concatenate([data.astype(np.uint64), np.zeros(DEPTH + 8, np.uint64)])
    words = np.zeros(len(data) + DEPTH, np.uint64)
    for k in range(8):
        words = words << np.uint64(8) | padded[k : k + len(words)]
    return words


def suffix_order(words: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Order of the suffixes at the given places by their first DEPTH bytes, eight at a time from the last to the first."""
    order = np.arange(len(start))
    for k in range(DEPTH - 8, -1, -8):
        order = order[np.argsort(words[start[order] + k], kind="stable")]
    return order


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest place before it with a smaller value, -1 if there is none; by pointer jumping."""
    least = np.append(values, np.iinfo(np.int64).min)  # place -1 ends every search
    jump = np.append(np.arange(len(values)) - 1, -1)
    open_ = np.arange(len(values))
    while len(open_):
        open_ = open_[least[jump[open_]] >= values[open_]]
        jump[open_] = jump[jump[open_]]  # all between a place and its jump is as large or larger
    return jump[:-1]


def common_length(words: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Bytes that the suffixes at two places have in common, up to DEPTH."""
    length, open_ = np.zeros(len(one), np.int64), np.arange(len(one))
    for k in range(0, DEPTH, 8):
        differ = words[one[open_] + k] ^ words[other[open_] + k]
        length[open_] += sum((differ < np.uint64(1 << bits)).astype(np.int64) for bits in range(8, 64, 8)) + (differ == 0)
        open_ = open_[differ == 0]
    return length


def longest_previous_factors(data: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For suffixes (place, end of their context, document): the longest beginning found in a suffix of a smaller document."""
    words = words_of(data)
    order = suffix_order(words, start)
    small = np.unique(doc, return_inverse=True)[1][order].astype(np.int64)
    n, factor = len(order), np.zeros(len(order), np.int64)
    after = n - 1 - previous_smaller(small[::-1])[::-1]  # n if there is none
    for near in (previous_smaller(small), np.where(after < n, after, -1)):
        here = np.flatnonzero(near >= 0)
        own, earlier = order[here], order[near[here]]
        common = np.minimum(common_length(words, start[own], start[earlier]), np.minimum(end[own] - start[own], end[earlier] - start[earlier]))
        factor[own] = np.maximum(factor[own], common)
    return factor


def come_again(data: np.ndarray, start: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which of the LENGTH bytes at the given places have a hash that another document has too."""
    return held_by_others(range_hash(prefix_sums(data), start, start + LENGTH), doc)


def previous_factors(table: pa.Table) -> pa.Table:
    """Rows of FACTORS: starts and lengths of what a smaller document of the bucket also holds."""
    columns = [b"".join(table.column(c).to_pylist()) for c in ("data", "lengths", "ids", "hashes", "starts")]
    data, lengths, ids, hashes, starts = (np.frombuffer(x, k) for x, k in zip(columns, (np.uint8, np.uint8, np.int64, np.int64, np.uint32), strict=True))
    lengths = lengths.astype(np.int64)
    begin = np.cumsum(lengths) - lengths
    windows = lengths - LENGTH + 1
    context = np.repeat(np.arange(len(lengths)), windows)
    offset = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    again = come_again(data, begin[context] + offset, ids[context])
    context, offset = context[again], offset[again]
    factor = longest_previous_factors(data, begin[context] + offset, (begin + lengths)[context], ids[context])
    reach = np.where(factor >= LENGTH, offset + factor, 0)
    covered = np.zeros(len(reach), bool)
    covered[1:] = (context[1:] == context[:-1]) & (offset[1:] == offset[:-1] + 1) & (reach[1:] <= reach[:-1])
    found = np.flatnonzero((reach > 0) & ~covered)
    found = found[np.lexsort((hashes[context[found]], ids[context[found]]))]
    c = context[found]
    new = np.ones(len(c), bool)
    new[1:] = (np.diff(ids[c]) != 0) | (np.diff(hashes[c]) != 0)
    first = np.flatnonzero(new)
    cuts = pa.array(np.append(first, len(c)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int32))) for x in (starts[c].astype(np.int64) + offset[found], factor[found])]
    return pa.table({"doc_id": ids[c[first]], "text_hash": hashes[c[first]], "places": lists[0], "lengths": lists[1]})


def remaining(text: bytes, contexts, factors, lengths) -> tuple[int, int, int, str]:
    """Bytes, removed bytes, removed runs, sha256 of the rest."""
    n = len(text)
    if contexts is None and factors is None:
        return n, 0, 0, hashlib.sha256(text).hexdigest()
    step = np.zeros(n + 1, np.int64)
    at, start, size = (np.asarray([] if x is None else x, np.int64) for x in (contexts, factors, lengths))
    for low, high in ((at - REACH, at + LENGTH), (start, start + size)):
        np.add.at(step, np.maximum(low, 0), 1)
        np.add.at(step, np.minimum(high, n), -1)
    gone = np.cumsum(step[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if n else 0
    return n, int(gone.sum()), runs, hashlib.sha256(np.frombuffer(text, np.uint8)[~gone].tobytes()).hexdigest()


def mapped(df: DataFrame, make, names: list[str], kinds: str, size: int = 3_000_000) -> DataFrame:
    """mapInArrow by slices of text; make gives row tuples."""
    types = {"int": pa.int32(), "binary": pa.binary()}
    arrow = [types[k.split()[1]] for k in kinds.split(", ")]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", size):
                rows = list(make(part))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)], names=names)

    return df.mapInArrow(run, kinds)


def repeats(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, text and the repeats: contexts (anchor places), factors (starts) and their lengths, null if none."""
    spark = docs.sparkSession
    ship_package(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(LAST))).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    partitions = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    with shuffles_deleted(spark):
        n_bytes = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(max(4 * partitions, n_bytes // BUCKET_BYTES), 2**31 - 1)

    names = [x.split()[0] for x in PACKED.split(", ")]
    packed = [mapped(own, lambda part, turn=turn: pack_anchors(part, buckets, turn, PASSES), names, PACKED) for turn in range(PASSES)]
    found = reduce(DataFrame.union, [materialise(p.groupBy("bucket").applyInArrow(compare_contexts, MARKS)) for p in packed])

    wanted = found.where("fetch").groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("places")).alias("places"))
    asked = own.join(wanted.hint("shuffle_hash"), ["doc_id", "text_hash"])
    kinds = "bucket int, data binary, lengths binary, ids binary, hashes binary, starts binary"
    contexts = mapped(asked, lambda part: pack_contexts(part, buckets), [x.split()[0] for x in kinds.split(", ")], kinds)
    factors = materialise(contexts.groupBy("bucket").applyInArrow(previous_factors, FACTORS))

    none = F.lit(None).cast("array<int>")
    whole = found.where("not fetch").select("doc_id", "text_hash", F.col("places").alias("c"), none.alias("f"), none.alias("l"))
    every = whole.union(factors.select("doc_id", "text_hash", none.alias("c"), F.col("places").alias("f"), F.col("lengths").alias("l")))
    pairs = F.flatten(F.collect_list(F.when(F.col("f").isNotNull(), F.arrays_zip("f", "l"))))
    every = every.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("c")).alias("contexts"), pairs.alias("p"))
    every = every.select("doc_id", "text_hash", "contexts", F.col("p.f").alias("factors"), F.col("p.l").alias("lengths"))
    return own.join(every.hint("shuffle_hash"), ["doc_id", "text_hash"], "left")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 of what is left. The rows are written, and what led to them is deleted."""
    spark = docs.sparkSession
    before = len(written(spark))
    joined = repeats(docs, id_col, text_col)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").cast(pa.binary() if pa.types.is_string(part.column("text").type) else pa.large_binary()).to_pylist()
                rows = [remaining(*row) for row in zip(texts, *(part.column(c).to_pylist() for c in ("contexts", "factors", "lengths")), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, zip(*rows, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = materialise(joined.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"))
    drop_written(spark, written(spark)[before:-1])
    return out.withColumn("doc_id", F.when(F.col("doc_id") != int(LAST), F.col("doc_id"))).withColumnRenamed("doc_id", id_col)
