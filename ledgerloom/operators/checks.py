"""Small checks and choices around outputs, audits, screens and revision tables.

Null counts as empty in every check; repeated rows stay unless a function says that it keeps one; empty tables give empty
results; of equals the one that the named order puts first counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.titles import composed_key

# Fixed values.
VERSION_LABELS = ("문서버전", "Version", "버전")
DATE_LABELS = ("개정일자", "변경일", "변경일자")
AUTHOR_LABELS = ("작성자",)
REASON_LABELS = ("개정사유", "변경사유")
DETAIL_LABELS = ("개정내역", "개정내용", "변경내역", "변경내용")
APPROVAL_LABELS = ("승인", "승인자")
VERSION_VALUE = r"\A[vV]?\d+(?:\.\d+)*\z"


def text_of(value: Column) -> Column:
    return F.trim(F.coalesce(value, F.lit("")))


def path_key(path: Column) -> Column:
    """A relative path for comparing: slashes one way, none at the ends, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+", "/"), F.lit("/")))


def without_excluded(candidates: DataFrame, path: str, excluded: DataFrame, excluded_path: str) -> DataFrame:
    """Candidates whose path is not on the list."""
    listed = excluded.select(path_key(F.col(excluded_path)).alias("_listed")).distinct()
    return candidates.join(listed, path_key(F.coalesce(path, F.lit(""))) == F.col("_listed"), "left_anti")


def below_top_level(path: Column) -> Column:
    """The file stands in a folder."""
    return F.contains(path_key(F.coalesce(path, F.lit(""))), F.lit("/"))


def needs_author(status: Column, revision: Column, error: Column, cover_count: Column, history_count: Column) -> Column:
    """An updated file whose first revision was skipped, failed, or changed nothing."""
    nothing = (text_of(revision) == "updated") & (F.coalesce(cover_count, F.lit(0)) == 0) & (F.coalesce(history_count, F.lit(0)) == 0)
    return (text_of(status) == "updated") & (text_of(revision).isin("skipped", "error") | (text_of(error) != "") | nothing)


def warns_of(warnings: Column, *words: str) -> Column:
    return F.coalesce(F.exists(warnings, lambda w: w.rlike("|".join(words))), F.lit(False))


def needs_header_id(status: Column, project_only: Column, number_missing: Column, warnings: Column) -> Column:
    """An updated file, not of its project title alone, without a document number or with a warning of it."""
    no = F.lit(False)
    return (text_of(status) == "updated") & ~F.coalesce(project_only, no) & (F.coalesce(number_missing, no) | warns_of(warnings, "문서번호"))


def needs_project_title(status: Column, project_only: Column, replaced: Column, warnings: Column) -> Column:
    """An updated file with a warning of its project, or that was to get its project title only and did not."""
    return (text_of(status) == "updated") & (warns_of(warnings, "사업명", "프로젝트명") | (F.coalesce(project_only, F.lit(False)) & (F.coalesce(replaced, F.lit(0)) == 0)))


def is_bad_title(title: Column, screen_id: Column, unit_test_id: Column) -> Column:
    """Empty, an id, or a part of one."""
    t, a, b = text_of(title), text_of(screen_id), text_of(unit_test_id)
    return (t == "") | t.isin(a, b) | F.array_contains(F.concat(F.split(a, "-"), F.split(b, "-")), t)


def scenario_id(screen_id: Column) -> Column:
    return F.regexp_replace(text_of(screen_id), r"\AUI(?=-|\z)", "AT")


def is_stale_file(stem: Column, id_pattern: str, output_keys: Column) -> Column:
    """The stem has an id and holds a key of the output."""
    key = composed_key(stem)
    return F.coalesce(stem.rlike(id_pattern) & F.exists(output_keys, lambda k: (k != "") & F.contains(key, k)), F.lit(False))


def target_keys(names: Column) -> Column:
    """Keys of names, each also without a last 서."""
    keys = F.transform(F.filter(names, lambda n: n.isNotNull()), composed_key)
    return F.array_distinct(F.filter(F.concat(keys, F.transform(keys, lambda k: F.regexp_replace(k, "서$", ""))), lambda k: k != ""))


def target_outputs(outputs: DataFrame, templates: DataFrame, targets: DataFrame) -> DataFrame:
    """Outputs (output_key, output_name, aliases) that share a key with a target (name), each name once, with template_path.

    Of equal names the least output_key counts; of equal templates (pos, output_name, template_path) the last.
    """
    names = F.concat(F.array("output_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    wanted = targets.select(F.explode(target_keys(F.array("name"))).alias("_key")).distinct()
    hit = outputs.withColumn("_key", F.explode(target_keys(names))).join(wanted, "_key").select("output_key").distinct()
    own = outputs.join(hit, "output_key").withColumn("_name", composed_key("output_name"))
    first = own.withColumn("_r", F.row_number().over(Window.partitionBy("_name").orderBy("output_key"))).where("_r = 1").drop("_r")
    last = templates.groupBy(composed_key(F.col("output_name")).alias("_name")).agg(F.max_by("template_path", "pos").alias("template_path"))
    return first.join(last, "_name", "left").drop("_name")


def distinct_variants(files: DataFrame, keys: list[str], path: str, suffix: Column, tail: Column, is_variant: Column, id_pattern: str) -> DataFrame:
    """The first path of each variant: files with a variant's tail differ by it, all others are one base per suffix."""
    plain = composed_key(F.regexp_replace(F.regexp_replace(F.coalesce(tail, F.lit("")), id_pattern, "SFR"), r"(^|[_\-\s])[vV]\d+(?:\.\d+)*", "$1v"))
    variant = (F.coalesce(tail, F.lit("")) != "") & is_variant
    rows = files.withColumns({"_variant": F.when(variant, plain).otherwise(""), "_kind": variant, "_suffix": F.lower(suffix)})
    first = Window.partitionBy(*keys, "_kind", "_suffix", "_variant").orderBy(path)
    return rows.withColumn("_r", F.row_number().over(first)).where("_r = 1").select(*files.columns)


def screen_summary(rows: DataFrame, keys: list[str], screen_id: str) -> DataFrame:
    """keys, screen_ids (sorted, distinct, without empty ones), row_count."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set(F.when(text_of(F.col(screen_id)) != "", text_of(F.col(screen_id))))).alias("screen_ids"), F.count(F.lit(1)).alias("row_count"))


def ranked_candidates(candidates: DataFrame, output: str, score: str, order: list[str]) -> DataFrame:
    """rank within an output: best score first, equal scores in the given order."""
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy(output).orderBy(F.desc(score), *order)))


def in_path_order(files: DataFrame, path: str) -> DataFrame:
    """By path without regard to case, then by path."""
    return files.orderBy(F.lower(path), path)


def revision_columns(labels: Column) -> Column:
    """Struct version, date, author, reason, detail, approval: places (from 0) of a revision table's columns by their labels.

    A later column of a kind takes the place of an earlier one; a version value right behind the version column stands
    for the date column where none was seen yet. Null if version, date or author has no column.
    """
    names = ("version", "date", "author", "reason", "detail", "approval")
    none = F.struct(*[F.lit(None).cast("int").alias(n) for n in names])
    start = F.struct(F.lit(0).alias("at"), none.alias("found"))

    def kind_of(label: Column, behind: Column) -> Column:
        def by(bare: Column) -> Column:
            holds = lambda words: bare.rlike("|".join(words))
            return (
                F.when(holds(VERSION_LABELS), "version")
                .when(holds(DATE_LABELS), "date")
                .when(holds(REASON_LABELS), "reason")
                .when(holds(DETAIL_LABELS), "detail")
                .when(F.coalesce(behind, F.lit(False)), "date")
                .when(holds(AUTHOR_LABELS), "author")
                .when(holds(APPROVAL_LABELS), "approval")
            )

        return let(F.regexp_replace(label, r"\s+", ""), by)

    def step(state: Column, raw: Column) -> Column:
        label, at, found = F.coalesce(raw, F.lit("")), state["at"], state["found"]
        behind = (at == found["version"] + 1) & found["date"].isNull() & label.rlike(VERSION_VALUE)
        places = lambda kind: F.struct(*[F.when(kind == n, at).otherwise(found[n]).alias(n) for n in names])
        return F.struct((at + 1).alias("at"), let(kind_of(label, behind), places).alias("found"))

    whole = lambda f: f["version"].isNotNull() & f["date"].isNotNull() & f["author"].isNotNull()
    return F.aggregate(labels, start, step, lambda s: F.when(whole(s["found"]), s["found"]))
