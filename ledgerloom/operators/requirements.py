"""Requirement ids of proposals with their context, without ids whose shape contradicts that of most.

The list section of a document counts if it has ids, else its whole text. Null and empty texts have no ids; an id counts
once, at its first place; of several rows of one key the least text counts; ids are compared in upper case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let, match_spans
from ..functions.keys import compact_space, id_shape, last_number, prefix_related
from ..functions.titles import nfkc

# Fixed values.
LIST_MARKER = r"(?i)요구\s*사항\s*(?:목록\s*표?|리스트|명세|정의)|기능\s*요구\s*사항"
STRICT_ID = r"(?i)(?<![A-Z0-9])SFR-(?:[A-Z0-9]+-)*\d+(?![A-Z0-9])"
TOLERANT_ID = r"(?i)(?<![A-Z0-9])S\s*F\s*R\s*[-_]\s*(?:[A-Z0-9]+\s*[-_]\s*)*\d+(?![A-Z0-9])"
SECTION_CHARS = 100_000
CONTEXT_CHARS = 80


def requirement_text(value: Column) -> Column:
    """Composed, with all dashes as hyphens."""
    return F.translate(nfkc(F.coalesce(value, F.lit(""))), "－–—―", "----")


def list_section(text: Column) -> Column:
    """From the first list marker on, up to SECTION_CHARS; empty without one."""
    before = F.length(F.get(F.split(text, LIST_MARKER, 2), 0))
    return F.when(text.rlike(LIST_MARKER), F.substring(text, before + 1, F.lit(SECTION_CHARS))).otherwise("")


def found_ids(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, pos, requirement_id, matched_text, context: each id at its first place; strict spellings before tolerant ones."""
    spans = lambda p, rank: F.transform(match_spans(F.col(text), p), lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), s["match"].alias("match")))
    rows = df.select(*keys, text, F.explode(F.concat(spans(STRICT_ID, 0), spans(TOLERANT_ID, 1))).alias("s"))
    body = F.regexp_replace(F.regexp_replace("s.match", r"(?i)\AS\s*F\s*R\s*[-_]\s*", ""), r"\s*[-_]\s*", "-")
    left = F.greatest(F.col("s.start") - CONTEXT_CHARS, F.lit(0))
    context = F.substring(F.col(text), left + 1, F.col("s.end") + CONTEXT_CHARS - left)
    rows = rows.select(*keys, F.struct("s.start", "s.rank").alias("pos"), F.concat(F.lit("SFR-"), F.upper(body)).alias("requirement_id"), compact_space(F.col("s.match")).alias("matched_text"), compact_space(context).alias("context"))
    first = rows.groupBy(*keys, "requirement_id").agg(F.min_by(F.struct("pos", "matched_text", "context"), "pos").alias("f"))
    return first.select(*keys, F.col("f.pos.start").alias("pos"), "requirement_id", "f.matched_text", "f.context")


def shape_conflicts(ids: DataFrame, keys: list[str]) -> DataFrame:
    """ids (keys, pos, requirement_id, ...) with kept, conflict_with and reason (prefix, number, or null).

    Where one shape has two ids or more and more than any other, an id of another shape goes if it is the beginning of an
    id of that shape, or the other way round, or has the same last number; the first such id is named. The distinct ids of one document,
    which are few, are one array; nothing is joined, so the extraction below runs once.
    """
    columns = [c for c in ids.columns if c not in keys]
    number = F.regexp_replace(last_number(F.col("requirement_id")), "^0+(?=.)", "")
    listed = ids.groupBy(*keys).agg(F.collect_list(F.struct(*columns, id_shape(F.col("requirement_id")).alias("_shape"), number.alias("_n"))).alias("_ids"))
    shapes = F.transform("_ids", lambda x: x["_shape"])
    counts = F.transform(F.array_distinct(shapes), lambda s: F.struct(F.size(F.filter(shapes, lambda x: x == s)).alias("n"), s.alias("shape")))
    largest = lambda c: F.filter(c, lambda x: (x["n"] == F.array_max(c)["n"]) & (x["n"] > 1))
    dominant = let(counts, lambda c: F.when(F.size(largest(c)) == 1, F.get(largest(c), 0)["shape"]))
    rows = listed.withColumn("_dominant", dominant).withColumn("_own", F.filter("_ids", lambda x: x["_shape"] == F.col("_dominant")))
    a = F.col("_x.requirement_id")
    rows = rows.select(*keys, "_dominant", "_own", F.explode("_ids").alias("_x"))
    met = F.transform("_own", lambda d: F.struct(d["pos"].alias("pos"), F.when(prefix_related(a, d["requirement_id"]), 0).when(d["_n"] == F.col("_x._n"), 1).alias("rank"), d["requirement_id"].alias("id")))
    hit = F.when(F.col("_x._shape") != F.col("_dominant"), F.array_min(F.filter(met, lambda h: h["rank"].isNotNull())))
    out = rows.select(*keys, "_x", hit.alias("h"))
    reason = F.when(F.col("h.rank") == 0, "prefix").when(F.col("h.rank") == 1, "number")
    return out.select(*[F.col(c) if c in keys else F.col(f"_x.{c}") for c in ids.columns], F.col("h").isNull().alias("kept"), F.col("h.id").alias("conflict_with"), reason.alias("reason"))


def proposal_requirements(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, pos, requirement_id, matched_text, context, kept, conflict_with, reason."""
    own = docs.select(*keys, F.col(text).alias("_text")).groupBy(*keys).agg(F.min("_text").alias("_text")).withColumn("_text", requirement_text(F.col("_text"))).withColumn("_section", list_section(F.col("_text")))
    inside = F.when((F.col("_section") != "") & F.col("_section").rlike(f"{STRICT_ID}|{TOLERANT_ID}"), F.col("_section")).otherwise(F.col("_text"))
    return shape_conflicts(found_ids(own.withColumn("_t", inside), keys, "_t"), keys)
