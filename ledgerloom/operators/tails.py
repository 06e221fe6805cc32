"""What follows a catalog name in a file name: longest names by prefix, kept tails, requirement ids in paths, template variants.

Names are compared without regard to case. Null stems have no tail; of equally long names the least output_key counts;
repeated files are rows each, by their file_key; empty tables give no tails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import file_stem, file_suffix
from ..functions.titles import composed_key, safe_stem
from .checks import distinct_variants

# Fixed values.
BOUNDARY = ("_", "-", "[", " ")
ATTACHMENT = r"[\s_-]*(?:[\[\(（［｛]\s*(?:별첨|첨부)\s*\d*[^)\]\}）］｝]*[\)\]\}）］｝]|(?:별첨|첨부)\s*\d+)"
KEPT = r"(?i)((?:(?:[_-][vV]\d+(?:\.\d+)*)|(?:[_-]SFR-[A-Za-z0-9-]+))+)\z"
REQUIREMENT_IN_TAIL = r"(?i)(?<![A-Z0-9])SFR-(?:[A-Z0-9]+-)*\d+(?![A-Z0-9])"
VERSION_IN_TAIL = r"([_-])[vV]\d+(?:\.\d+)*"
NEW_VERSION = "v0.1"
HANDOVER_RESULT, HANDOVER_CONFIRMATION = "인수인계시험결과서", "별첨1인수인계확인서"


def standard_tails(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """file_key, output_key, tail of files whose stem begins with a catalog name that ends at the stem's end or before one of BOUNDARY.

    files: file_key, stem; catalog: output_key, standard_stem (also tried as a safe file name). The prefixes of a stem that end at a boundary
    meet the names in an equi-join, so the work follows the boundaries in stems, not files times names. The longest name counts.
    """
    lower, n = F.lower("stem"), F.length("stem")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | F.substring("stem", i + 1, F.lit(1)).isin(*BOUNDARY))
    prefixes = files.where("stem <> ''").select("file_key", "stem", F.explode(ends).alias("_n")).withColumn("_prefix", F.left(F.lower("stem"), F.col("_n")))
    names = catalog.select("output_key", F.explode(F.array_distinct(F.array("standard_stem", safe_stem(F.col("standard_stem"))))).alias("_name")).where("_name <> ''")
    found = prefixes.join(names.select("output_key", F.lower("_name").alias("_prefix")).distinct(), "_prefix")
    best = found.groupBy("file_key", "stem").agg(F.min_by(F.struct("output_key", "_n"), F.struct(-F.col("_n"), F.col("output_key"))).alias("b"))
    return best.select("file_key", F.col("b.output_key").alias("output_key"), F.substring("stem", F.col("b._n") + 1, F.length("stem")).alias("tail"))


def is_attachment_tail(tail: Column) -> Column:
    return tail.rlike(rf"(?i)\A{ATTACHMENT}")


def is_handover(stem: Column, standard_stem: Column) -> Column:
    """The confirmation that belongs to a handover test's result."""
    return F.contains(composed_key(standard_stem), F.lit(HANDOVER_RESULT)) & F.contains(composed_key(stem), F.lit(HANDOVER_CONFIRMATION))


def kept_tail(stem: Column, standard_stem: Column, tail: Column) -> Column:
    """The tail that a renamed file keeps, with the version set anew: attachment notes, else versions and requirement ids at the end.

    tail: what stands behind the standard stem, null if the stem doesn't begin with it.
    """
    whole = F.coalesce(is_attachment_tail(tail) | (is_handover(stem, standard_stem) & tail.rlike(REQUIREMENT_IN_TAIL)), F.lit(False))
    note = F.trim(F.regexp_extract(stem, rf"(?i)({ATTACHMENT}.*)", 1), F.lit(" \t\r\n"))
    end = F.regexp_extract(stem, KEPT, 1)
    own = F.when(whole, tail).when(note != "", note).when(end != "", end)
    renewed = F.regexp_replace(own, VERSION_IN_TAIL, f"$1{NEW_VERSION}")
    versioned = F.when(renewed.rlike(VERSION_IN_TAIL), renewed).otherwise(F.concat(renewed, F.lit(f"_{NEW_VERSION}")))
    return F.when(own.isNull(), f"_{NEW_VERSION}").when(F.left(versioned, F.lit(1)).isin("_", "-", "["), versioned).otherwise(F.concat(F.lit("_"), versioned))


def path_with_id(path: Column, requirement_id: Column) -> Column:
    """The path with _id behind the file's stem, unless the stem has the id or there is none."""
    id_ = F.coalesce(requirement_id, F.lit(""))
    part, stem = safe_stem(id_), file_stem(path)
    folder = F.regexp_extract(path, r"(?s)\A(.*/)?", 1)
    return F.when((id_ == "") | F.contains(F.lower(stem), F.lower(part)), path).otherwise(F.concat(folder, stem, F.lit("_"), part, file_suffix(path)))


def variants_by_tail(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """The first path of each variant of each output: files: file_key, path; catalog: output_key, standard_stem. Files of no output are left out."""
    tails = standard_tails(files.select("file_key", file_stem(F.col("path")).alias("stem")), catalog)
    names = catalog.groupBy("output_key").agg(F.min("standard_stem").alias("_standard"))
    rows = files.join(tails, "file_key").join(names, "output_key")
    variant = is_attachment_tail(F.col("tail")) | is_handover(file_stem(F.col("path")), F.col("_standard"))
    return distinct_variants(rows, ["output_key"], "path", file_suffix(F.col("path")), F.col("tail"), variant, REQUIREMENT_IN_TAIL).select("output_key", "file_key", "path", "tail")
