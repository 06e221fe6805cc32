"""Which files of a folder count, and which catalog paths they lie under.

Folders are arrays of parts. Parts and names are taken as composed (NFKC); `composed_parts` composes them. Null parts and
names count as empty; empty templates match nothing; repeated files stay; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import has_subpath, starts_with_parts
from ..functions.titles import composed_key, nfkc
from .paths import longest_templates

# Fixed values.
IGNORED_FOLDERS = ("bak", "backup", "백업", "임시", "temp", "tmp")
TRANSPARENT_FOLDERS = ("원본",)
ARCHIVE_FOLDERS = ("2024", "0.1", "0.0", "구버전", "old")
REVIEW_FOLDERS = ("양식", "회신용")
REVIEW_WORDS_IN_PATHS = ("검토표시", "자체테스트")
REVIEW_WORDS_IN_NAMES = ("검토표시", "회신용")
ARCHIVE_PREFIXES = ("(2024)", "（2024）")
LOW_VERSION = r"(?i)(?:^|[_-])v0\.9(?=$|[^0-9])"
EXCLUDED_RUN = ("05.시험", "02.시험단계점검", "02.데이터값진단")
MANUAL_RUN = ("06.인도", "01.인수인계", "02.매뉴얼작성")
MANUAL_FOLDER = "운영자매뉴얼"
GENERIC_ALIASES = ("시험결과서", "결과서", "보고서", "계획서", "매뉴얼", "시나리오")


def composed_parts(parts: Column) -> Column:
    return F.split(nfkc(F.array_join(parts, "\n")), "\n")


def keys_of(parts: Column) -> Column:
    return F.transform(F.coalesce(parts, F.array().cast("array<string>")), composed_key)


def literal_keys(words: tuple[str, ...]) -> Column:
    """Keys of fixed words, as a constant array."""
    return F.array(*[composed_key(F.lit(w)) for w in words]) if words else F.array().cast("array<string>")


def is_archive_or_review(parts: Column, name: Column) -> Column:
    """An old or a reviewed copy, by its folders or its name."""
    text = F.trim(F.coalesce(name, F.lit("")))
    folders = F.arrays_overlap(keys_of(parts), literal_keys(ARCHIVE_FOLDERS + REVIEW_FOLDERS))
    path, name_key = composed_key(F.array_join(parts, "\\")), composed_key(text)
    holds = lambda key, words: F.greatest(*[F.contains(key, composed_key(F.lit(w))) for w in words])
    prefixed = F.greatest(*[F.startswith(text, F.lit(p)) for p in ARCHIVE_PREFIXES])
    return F.coalesce(folders, F.lit(False)) | F.coalesce(holds(path, REVIEW_WORDS_IN_PATHS), F.lit(False)) | holds(name_key, REVIEW_WORDS_IN_NAMES) | prefixed | text.rlike(LOW_VERSION)


def is_default_excluded(parts: Column, name: Column, excluded: tuple[str, ...] = EXCLUDED_RUN, manuals: tuple[str, ...] = MANUAL_RUN, manual: str = MANUAL_FOLDER) -> Column:
    """Below the excluded run of folders, an old or reviewed copy, or below the manuals' folders outside the one that counts."""
    keys = keys_of(parts)
    in_manuals = has_subpath(keys, literal_keys(manuals)) & ~F.array_contains(keys, composed_key(F.lit(manual)))
    return has_subpath(keys, literal_keys(excluded)) | is_archive_or_review(parts, name) | in_manuals


def should_scan(parts: Column, name: Column, ignored: tuple[str, ...] = IGNORED_FOLDERS, only_under: tuple[tuple[str, ...], ...] = ()) -> Column:
    """Not excluded, in no ignored folder and, if prefixes are given, below one of them."""
    keys = keys_of(parts)
    kept = ~is_default_excluded(parts, name) & ~F.coalesce(F.arrays_overlap(keys, literal_keys(ignored)), F.lit(False))
    for_prefix = [starts_with_parts(keys, literal_keys(p)) for p in only_under]
    return kept & F.greatest(*for_prefix, F.lit(False)) if for_prefix else kept


def comparable_parts(parts: Column, transparent: tuple[str, ...] = TRANSPARENT_FOLDERS) -> Column:
    """The parts without folders that only pass through."""
    return F.filter(parts, lambda p: ~F.array_contains(literal_keys(transparent), composed_key(p)))


def template_part_key(part: Column) -> Column:
    """Key of a folder's name without its leading number."""
    return composed_key(F.regexp_replace(part, r"^\s*\d+[.)_-]?\s*", ""))


def is_generic_alias(alias_key: Column, name_key: Column) -> Column:
    """Too short or too common a key to stand for an output."""
    short = F.length(alias_key) < F.greatest(F.lit(5), F.length(name_key) - 1)
    return F.coalesce(name_key == "", F.lit(True)) | short | alias_key.isin(*GENERIC_ALIASES)


def templates_of_paths(files: DataFrame, keys: list[str], parts: str, templates: DataFrame, template: str, order: str, transparent: tuple[str, ...] = TRANSPARENT_FOLDERS, all_longest: bool = False) -> DataFrame:
    """files joined to the longest catalog path that stands in a row in theirs; the first of equals, or all of them.

    Folders compare by name without number, transparent ones don't count. An equi-join on runs of parts.
    """
    own = files.withColumn("_parts", F.transform(comparable_parts(F.col(parts), transparent), template_part_key))
    wanted = templates.withColumn("_template", F.transform(template, template_part_key))
    return longest_templates(own, keys, "_parts", wanted, "_template", order, all_longest).drop("_parts", "_template")


def files_to_read(files: DataFrame, keys: list[str], parts: str, templates: DataFrame, template: str, transparent: tuple[str, ...] = TRANSPARENT_FOLDERS) -> DataFrame:
    """files with `read`: it lies under a template, or no file at all does (then all are read).

    One flag of the whole table decides the fallback; it is a single row, joined without a job while planning.
    """
    hits = templates_of_paths(files.select(*keys, parts), keys, parts, templates.select(template).distinct(), template, template, transparent).select(*keys).distinct()
    any_hit = hits.agg((F.count(F.lit(1)) > 0).alias("_any"))
    marked = files.join(hits.withColumn("_hit", F.lit(True)), keys, "left")
    return marked.crossJoin(F.broadcast(any_hit)).withColumn("read", F.coalesce("_hit", ~F.col("_any"))).drop("_hit", "_any")
