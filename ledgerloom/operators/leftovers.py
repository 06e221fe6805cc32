"""Files that no candidate was chosen for: the full update where an output fits well, else the project title alone.

files: file_key, path, stem, title, preview, error, project_title, has_cover; of rows with one path (without regard to case) the
one with the least file_key counts. Null project titles and covers count as none; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.titles import composed_text
from ..tables import materialise
from .score import file_scores

# Fixed values.
FULL_FROM = 0.94
CONVERTED = {".hwp": ".hwpx"}
FILE_COLUMNS = ["file_key", "path", "stem", "title", "preview", "error", "project_title", "has_cover"]


def path_key(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def chosen_paths(chosen: DataFrame) -> DataFrame:
    """_key of all paths that chosen files have or get: chosen: path, target_name (without folder); converted kinds too."""
    folder = F.regexp_extract("path", r"(?s)\A(.*/)?", 1)
    both = [F.col("path"), F.concat(folder, F.col("target_name"))]
    for old, new in CONVERTED.items():
        both += [F.when(F.lower(p).endswith(old), F.concat(F.left(p, F.length(p) - len(old)), F.lit(new))) for p in both[:2]]
    return chosen.select(F.explode(F.array(*both)).alias("_p")).where("_p is not null").select(path_key(F.col("_p")).alias("_key")).distinct()


def leftover_updates(files: DataFrame, outputs: DataFrame, chosen: DataFrame, excluded: DataFrame, standard_title: str, threshold: float = FULL_FROM) -> DataFrame:
    """file_key, path, action ('full' or 'title_only'), output_key, score of the files left over that change.

    Chosen and excluded paths go by anti-joins, and what is left is written; then the files are scored once, with ids, and
    the best output (the least key of equals) is a sum per file joined back, so the second branch is a column of the same
    rows. excluded: path.
    """
    gone = chosen_paths(chosen).union(excluded.select(path_key(F.col("path")).alias("_key"))).distinct()
    first = files.withColumn("_key", path_key(F.col("path"))).groupBy("_key").agg(F.min_by(F.struct(*FILE_COLUMNS), "file_key").alias("f")).where("f.path is not null")
    left = materialise(first.join(gone, "_key", "left_anti").select("f.*"))
    scored = file_scores(left.select("file_key", "stem", "title", "preview", "error"), outputs, use_output_id=True, threshold=threshold)
    best = scored.groupBy("file_key").agg(F.min_by(F.struct("output_key", "score"), F.struct(-F.col("score"), F.col("output_key"))).alias("b"))
    old = composed_text(F.coalesce("project_title", F.lit("")))
    differs = (old != "") & (old != composed_text(F.lit(standard_title)))
    action = F.when(F.col("b").isNotNull(), "full").when(F.coalesce("has_cover", F.lit(False)) & differs, "title_only")
    return left.join(best, "file_key", "left").withColumn("action", action).where("action is not null").select("file_key", "path", "action", F.col("b.output_key").alias("output_key"), F.col("b.score").alias("score"))
