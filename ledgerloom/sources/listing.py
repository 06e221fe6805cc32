"""Folder listings as DataFrames: paths, parts and policies. Contents are read only if asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import starts_with_parts
from ..functions.keys import file_name, file_stem, file_suffix

# Fixed values.
NOISE_NAMES = ("thumbs.db", "desktop.ini")


def is_noise(name: Column) -> Column:
    lower = F.lower(name)
    return lower.isin(*NOISE_NAMES) | F.startswith(name, F.lit("~$")) | F.startswith(lower, F.lit(".metadata_")) | F.contains(lower, F.lit("_metadata_"))


def list_files(spark: SparkSession, root: str, suffixes: list[str] | None = None, contents: bool = False, ignored_folders: tuple[str, ...] = (), only_under: list[list[str]] | None = None) -> DataFrame:
    """path (relative), parts (folders), name, stem, suffix, length and, if asked for, content; ordered by nothing.

    The listing runs in parallel; without contents the column is pruned and no file is opened.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").removeprefix("file:")
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/+", "/"), F.lit(rf"^\Q{base}\E/?"), F.lit(""))
    out = files.withColumn("path", path)
    out = out.withColumns({"parts": F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1), "name": file_name(F.col("path"))})
    out = out.withColumns({"stem": file_stem(F.col("path")), "suffix": F.lower(file_suffix(F.col("path")))}).where(~is_noise(F.col("name")))
    if suffixes:
        out = out.where(F.col("suffix").isin(*suffixes))
    if ignored_folders:
        out = out.where(~F.exists("parts", lambda p: F.lower(p).isin(*ignored_folders)))
    if only_under:
        under = [starts_with_parts(F.col("parts"), F.array(*[F.lit(x) for x in prefix])) for prefix in only_under]
        out = out.where((F.size("parts") == 0) | F.greatest(*under, F.lit(False)))
    return out.select("path", "parts", "name", "stem", "suffix", "length", *(["content"] if contents else []))
