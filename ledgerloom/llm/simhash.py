"""SimHash near-duplicates by Golay-code fuzzy hashing, with DataFrame functions only.

A fingerprint's 64 bits are cut into segments of 22, 21 and 21 bits, each a (shortened) word of the perfect binary Golay
code of length 23. If two fingerprints differ in at most 4 bits, some midpoint is at most 2 flips from both. So each
fingerprint gets as keys the triples of codeword indices that its segments decode to after at most 2 flips in all: the
flips are shared out over the segments as (1,1,0), (1,0,1), (0,1,1), (2,0,0), (0,2,0) or (0,0,2), and because decoding
maps whole balls to one codeword there are some 120 keys of 36 bits, not 2081. Linked fingerprints always share a key;
keys are then joined and every candidate is verified by its exact Hamming distance.

The keys of distinct fingerprints only are shuffled, so copies cost nothing. Within a key of up to MAX_BUCKET
fingerprints the links are reduced to a spanning forest in the row. Fingerprints of larger keys (very dense groups) take
an exact way that is linear in the group: each stars to the least fingerprint of every 64-bit word at most 2 flips away.

Defined cases: texts without words (null, empty, white space) have fingerprint zero and link like others; repeated rows
of one id and text give one row; an empty table gives an empty result; null ids are kept, and a component of null ids
only has a null component_id; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, lower_ascii, materialise, words_of
from .components import connected_components
from .similar_sets import near_duplicates  # noqa: F401  by similarity of shingle sets, not by fingerprints

SHINGLE = 4
RADIUS = 4
MAX_BUCKET = 512
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # shift, width
GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1


def remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


def golay_rows() -> list[tuple]:
    """For each of the 2048 syndromes and both widths: the differences to the codewords reached by 0, up to 1, up to 2 flips."""
    unit = [remainder(1 << i) for i in range(23)]
    leader = {0: 0}
    for k in (1, 2, 3):
        for at in combinations(range(23), k):
            s = pattern = 0
            for i in at:
                s, pattern = s ^ unit[i], pattern | 1 << i
            leader[s] = pattern
    flips = {w: [[(0, 0)], [(1 << i, unit[i]) for i in range(w)], [(1 << i | 1 << j, unit[i] ^ unit[j]) for i, j in combinations(range(w), 2)]] for w in (21, 22)}
    rows = []
    for s in range(2048):
        row, seen = [s], {}
        for w in (21, 22):
            seen = {}
            for k in (0, 1, 2):
                for pattern, syndrome in flips[w][k]:
                    seen.setdefault(pattern ^ leader[s ^ syndrome], k)
                row.append([d for d, at in seen.items() if at <= k])
        rows.append(tuple(row))
    return rows


def golay_table(spark: SparkSession) -> DataFrame:
    kind = ", ".join(f"w{w}_{k} array<bigint>" for w in (21, 22) for k in (0, 1, 2))
    return spark.createDataFrame(golay_rows(), f"syndrome bigint, {kind}")


def syndrome(word: Column) -> Column:
    unit = [remainder(1 << i) for i in range(23)]
    out = F.lit(0).cast("long")
    for r in range(11):
        mask = sum(1 << i for i in range(23) if unit[i] >> r & 1)
        out = out.bitwiseOR(F.shiftleft((F.bit_count(word.bitwiseAND(F.lit(mask).cast("long"))) % 2).cast("long"), r))
    return out


def fuzzy_keys(fingerprints: DataFrame) -> DataFrame:
    """fp -> fp, key: rows of fingerprints that differ in up to 4 bits share a key.

    Segments and syndromes are written before the joins, which would else carry their long expressions through every
    step of the driver's planning; they are dealt out to all cores, as each row becomes some 120.
    """
    spark = fingerprints.sparkSession
    table = F.broadcast(golay_table(spark))  # 2048 rows
    words = {f"x{i}": F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1).cast("long")) for i, (shift, width) in enumerate(SEGMENTS)}
    df = fingerprints.select("fp", *[w.alias(x) for x, w in words.items()], *[syndrome(w).alias(x.replace("x", "s")) for x, w in words.items()])
    df = materialise(df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    for i, (_, width) in enumerate(SEGMENTS):
        own = table.select(F.col("syndrome").alias(f"s{i}"), *[F.col(f"w{width}_{k}").alias(f"d{i}_{k}") for k in (0, 1, 2)])
        df = df.join(own, f"s{i}")

    def index(i: int, k: int) -> Column:  # indices of the codewords that segment i reaches by up to k flips, in place
        return F.transform(f"d{i}_{k}", lambda d: F.shiftleft(F.shiftright(F.col(f"x{i}").bitwiseXOR(d), 11), 24 - 12 * i))

    def all_of(a: int, b: int, c: int) -> Column:
        three = lambda x, y: F.transform(F.col(f"c2_{c}"), lambda z: x.bitwiseOR(y).bitwiseOR(z))
        return F.flatten(F.transform(f"c0_{a}", lambda x: F.flatten(F.transform(f"c1_{b}", lambda y: three(x, y)))))

    df = df.select("fp", *[index(i, k).alias(f"c{i}_{k}") for i in range(3) for k in (0, 1, 2)])
    shares = ((1, 1, 0), (1, 0, 1), (0, 1, 1), (2, 0, 0), (0, 2, 0), (0, 0, 2))
    return df.select("fp", F.explode(F.array_distinct(F.concat(*[all_of(*x) for x in shares]))).alias("key"))


def bucket_links(members: Column) -> Column:
    """Array of distinct fingerprints -> links (a, b) of a spanning forest of those within RADIUS."""

    def add(labels: Column, fp: Column) -> Column:  # labels: of (fp, root) so far
        near = F.transform(F.filter(labels, lambda e: F.bit_count(e["a"].bitwiseXOR(fp)) <= RADIUS), lambda e: e["b"])
        relabel = lambda roots: let(F.least(fp, F.coalesce(F.array_min(roots), fp)), lambda root: F.concat(F.transform(labels, lambda e: F.struct(e["a"].alias("a"), F.when(F.array_contains(roots, e["b"]), root).otherwise(e["b"]).alias("b"))), F.array(F.struct(fp.alias("a"), root.alias("b")))))
        return let(near, relabel)

    empty = F.array().cast("array<struct<a:bigint,b:bigint>>")
    return F.filter(F.aggregate(members, empty, add), lambda e: e["a"] != e["b"])


def flips() -> Column:
    """Array of the 2081 words of 64 bits with at most two bits set."""
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    two = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(62)), lambda i: F.transform(F.sequence(i + 1, F.lit(63)), lambda j: bit(i).bitwiseOR(bit(j)))))
    return F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(63)), bit), two)


def dense_links(fingerprints: DataFrame) -> DataFrame:
    """Exact links of dense groups: a star for each word that is at most 2 flips from several fingerprints (at most 2081)."""
    near = fingerprints.select("fp", F.explode(flips()).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word"))
    least = near.groupBy("word").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return near.join(least, "word").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def fingerprint_links(fingerprints: DataFrame, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Distinct fp (long) -> links a, b that connect exactly what pairs within RADIUS connect."""
    keyed = fuzzy_keys(fingerprints).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1")
    keyed = materialise(keyed)  # what shares a key, a small part of all
    small = keyed.where(F.col("n") <= max_bucket).groupBy("key").agg(F.collect_list("fp").alias("fps"))
    links = small.select(F.explode(bucket_links(F.col("fps"))).alias("l")).select("l.a", "l.b").distinct()
    return links.union(dense_links(keyed.where(F.col("n") > max_bucket).select("fp").distinct()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id, text_hash, fp: 64 majority bits over the XXH64 of all word shingles, summed as 32 longs of two counters each."""

    def shingles(w: Column) -> Column:
        joined = F.transform(w, lambda x, i: F.xxhash64(F.concat_ws(" ", x, *[F.get(w, i + k) for k in range(1, shingle)])))
        return F.when(F.size(w) > 0, F.slice(joined, F.lit(1), F.greatest(F.size(w) - (shingle - 1), F.lit(1))))

    hashes = let(words_of(lower_ascii(F.col(text_col))), shingles)
    h = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), F.explode_outer(hashes).alias("_h"))
    pair = F.lit(1 << 32 | 1).cast("long")
    sums = h.groupBy("_id", "_hash").agg(F.count("_h").alias("_n"), *[F.sum(F.shiftrightunsigned("_h", j).bitwiseAND(pair)).alias(f"_s{j}") for j in range(32)])
    fp = F.lit(0).cast("long")
    for j in range(32):
        for count, bit in ((F.col(f"_s{j}").bitwiseAND(F.lit((1 << 32) - 1).cast("long")), j), (F.shiftrightunsigned(f"_s{j}", 32), j + 32)):
            one = 1 << bit if bit < 63 else -(1 << 63)
            fp = fp.bitwiseOR(F.when(2 * count > F.col("_n"), F.lit(one).cast("long")).otherwise(F.lit(0).cast("long")))
    return sums.select(F.col("_id").alias("doc_id"), F.col("_hash").alias("text_hash"), fp.alias("fp"))


def fingerprint_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, fp, component_id (least doc_id reachable over fingerprints within RADIUS)."""
    prints = materialise(fingerprints(docs, id_col, text_col, shingle))
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    parts = connected_components(fingerprint_links(distinct.select("fp")))
    rooted = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(least, "root").select("fp", "component_id"), "fp")


def fingerprint_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, component_id of groups by fingerprints, each checked by the similarity of shingle sets.

    Documents of a fingerprint group are candidates, verified at 0.8 with their group's least set; what fingerprints don't
    bring together at that similarity (they can't bring all) is added by the sets' prefixes.
    """
    groups = fingerprint_groups(docs, id_col, text_col, shingle)
    several = groups.select("text_hash", F.struct("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("fp")).alias("group"))
    return near_duplicates(docs, id_col, text_col, shingle, candidates=materialise(several.distinct()))


def near_duplicate_digest(docs: DataFrame) -> DataFrame:
    out = fingerprint_groups(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
