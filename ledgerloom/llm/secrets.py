"""Secret scan with multipart credential linking, with DataFrame functions only.

Strong spans (assign, access, hex) are always reported. Weak candidates (identifier, endpoint, weak) are parts of a
credential that mean little alone: they are reported only when a part of another class stands apart from them, with at
most SCOPE code points between the two. Parts are spread over the position bins of SCOPE that they cover and linked by an
interval semi-join on document and bin, so that no pairs are made and no document is gathered whole.

Spans are code point offsets, end exclusive. Matches and the gaps between them come from one split and one extraction by
the same pattern, so that their lengths add up to offsets; they are summed by blocks of the square root of their number,
so a text of 200,000 spans takes seconds.

Defined cases: null text is empty and has no spans; parts that overlap don't link each other; null ids are kept; repeated
rows of one id and text give a row each; rows of one id with other texts are told apart; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialise

SCOPE = 200
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind -> (pattern, class). Order is the order within a start.
STRONG = {"assign": (ASSIGN, "secret"), "access": (r"AKIA[A-Z0-9]+", "id"), "hex": (r"[0-9a-f]{24,}", "secret")}
#: Weak ones but endpoint begin where no ASCII letter or digit stands before.
BOUNDED = ("identifier", "weak")
WEAK = {
    "identifier": (r"""(?i:user(?:_?name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""", "id"),
    "endpoint": (r"""[a-z][a-z0-9+.-]{1,20}://[A-Za-z0-9._~:/?#@!$&'()*+,;=%-]+""", "endpoint"),
    "weak": (r"""(?i:pwd|pass|pin|key|auth|bearer|credential)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}""", "secret"),
}
KINDS = [*STRONG, *WEAK]
CLASS = {k: c for k, (_, c) in (STRONG | WEAK).items()}


def spans_of(text: Column, kind: str) -> Column:
    """Leftmost non-overlapping matches of a kind as structs start, ord, kind, end."""
    pattern, _ = (STRONG | WEAK)[kind]
    if kind in BOUNDED:
        pattern = f"(?<![A-Za-z0-9]){pattern}"
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == "assign" else matches
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    long_enough = {"assign": 6, "access": 20}.get(kind, 1)
    parts = F.arrays_zip(gaps.alias("gap"), F.transform(matches, lambda x: F.length(x)).alias("len"), F.transform(values, lambda x: F.length(x)).alias("value"))
    span = lambda start, end: F.struct(start.cast("long").alias("start"), F.lit(KINDS.index(kind)).alias("ord"), F.lit(kind).alias("kind"), end.cast("long").alias("end"))
    empty = F.array().cast("array<struct<start:bigint,ord:int,kind:string,end:bigint>>")

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + part["gap"]
        end = start + part["len"]
        found = F.when(part["value"] >= long_enough, F.concat(state["found"], F.array(span(start, end)))).otherwise(state["found"])
        return F.struct(F.coalesce(end, state["at"]).cast("long").alias("at"), found.alias("found"))

    def by_blocks(parts: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(parts))).cast("int")
        cut = F.transform(F.sequence(F.lit(0), ((F.size(parts) - 1) / size).cast("int")), lambda b: F.slice(parts, b * size + 1, size))
        return let(cut, summed)

    def summed(blocks: Column) -> Column:
        widths = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0).cast("long"), lambda n, p: n + F.coalesce(p["gap"], F.lit(0)) + F.coalesce(p["len"], F.lit(0))))
        starts = F.aggregate(widths, F.array(F.lit(0).cast("long")), lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n)))
        return F.flatten(F.zip_with(blocks, F.slice(starts, F.lit(1), F.size(blocks)), lambda block, at: F.aggregate(block, F.struct(at.alias("at"), empty.alias("found")), step, lambda state: state["found"])))

    return F.when(text.rlike(pattern), let(parts, by_blocks)).otherwise(empty)


def linked_weak(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak spans that a part of another class stands near, at most scope from end to start: _id, _hash, span."""
    parts = spans.where(F.size("weak_spans") > 0).select("_id", "_hash", F.explode(F.concat("base_spans", "weak_spans")).alias("span")).distinct()
    classes = F.create_map(*[F.lit(x) for kv in CLASS.items() for x in kv])
    parts = parts.withColumn("class", F.element_at(classes, F.col("span.kind")))
    bins = lambda margin: F.explode(F.sequence(F.floor((F.col("span.start") - margin) / scope), F.floor((F.col("span.end") + margin) / scope)))
    left = parts.where(F.col("span.kind").isin(*WEAK)).withColumn("bin", bins(scope)).alias("l")
    right = parts.withColumn("bin", bins(0)).alias("r")
    gap = F.greatest("l.span.start", "r.span.start") - F.least("l.span.end", "r.span.end")
    same = F.col("l._id").eqNullSafe(F.col("r._id")) & (F.col("l._hash") == F.col("r._hash")) & (F.col("l.bin") == F.col("r.bin"))
    return left.join(right, same & gap.between(0, scope) & (F.col("l.class") != F.col("r.class")), "left_semi").select("_id", "_hash", "span").distinct()


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """id, base_spans (strong) and spans (strong and linked weak ones): arrays of start, ord, kind, end in order."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_hash"), text.alias("_text"))
    merged = lambda kinds: F.array_sort(F.concat(*[spans_of(F.col("_text"), k) for k in kinds]))
    spans = materialise(own.select("_id", "_hash", merged(STRONG).alias("base_spans"), merged(WEAK).alias("weak_spans")))
    added = linked_weak(spans, scope).groupBy("_id", "_hash").agg(F.collect_list("span").alias("added"))
    joined = spans.alias("s").join(added.alias("a"), F.col("s._id").eqNullSafe(F.col("a._id")) & (F.col("s._hash") == F.col("a._hash")), "left")
    every = F.when(F.col("added").isNull(), F.col("base_spans")).otherwise(F.array_sort(F.concat("base_spans", "added")))
    return joined.select(F.col("s._id").alias(id_col), "base_spans", every.alias("spans"))


def secret_digest(docs: DataFrame) -> DataFrame:
    out = scan_secrets(docs)
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return out.select("doc_id", *[count(k).alias(f"n_{k}") for k in STRONG], F.sha2(F.encode(joined("base_spans"), "utf-8"), 256).alias("base_sha256"), joined("spans").alias("spans"))
