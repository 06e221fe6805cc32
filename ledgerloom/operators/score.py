"""The whole score of files against a catalog of outputs: names, titles, previews, ids and their conflicts.

files: file_key, stem, title, preview, error (null or "" if the file could be read). outputs: output_key, output_id,
output_name, aliases (array; empty or null: the name alone). Only pairs that share a core key, one holding the other, are
made: by equi-joins on their first characters, never all pairs.

Defined cases: a null stem matches nothing; a null title, preview or id counts as empty; a file that has an error is
scored by its name only; files without a key have no pairs; repeated rows give repeated pairs; several aliases give the best of their scores; empty tables
give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import best_gestalt_ratio
from ..functions.titles import ID_IN_NAME, composed_key, id_prefix, keys_of, name_in_id, nfkc, title_key, without_attachment_tail, without_leading_ids, without_parentheses
from ..tables import materialise
from .match import ALIAS_HOLDS, NAME_EQUAL, NAME_HOLDS, PREVIEW_HOLDS, TITLE_EQUAL, TITLE_HOLDS, containment_join

# Fixed values.
ID_EQUAL, ID_PREFIX, TITLES_DIFFER, LEAST_WITH_OTHER_ID = 1.00, 0.98, 0.72, 0.94


def readable(column: str) -> Column:
    """The text of a file that has no error; else empty."""
    return F.when(F.coalesce(F.col("error"), F.lit("")) == "", F.coalesce(F.col(column), F.lit(""))).otherwise("")


def with_content(files: DataFrame) -> DataFrame:
    """file_key, stem, title, preview and _content, the SHA-256 of the three texts: all that a file's scores depend on.

    None of them is null, else Spark would compute them once more to filter nulls, before the files are dealt out.
    """
    own = files.where("file_key is not null").select("file_key", F.coalesce("stem", F.lit("")).alias("stem"), readable("title").alias("title"), readable("preview").alias("preview"))
    lengths = [x for c in ("stem", "title") for x in (F.octet_length(c).cast("string"), F.lit(":"))]
    return own.withColumn("_content", F.coalesce(F.sha2(F.concat(*lengths, "stem", "title", "preview"), 256), F.lit("")))


def prepared_files(files: DataFrame) -> DataFrame:
    out = files.where("stem is not null").withColumn("_tail", without_attachment_tail(nfkc(F.col("stem"))))  # a filter on _tail would move below a distinct
    return out.select(
        "file_key",
        F.col("_tail").alias("stem"),
        keys_of(F.col("_tail")).alias("names"),
        keys_of(without_leading_ids(F.col("_tail"))).alias("core"),
        title_key(readable("title")).alias("title"),
        title_key(readable("preview")).alias("preview"),
        F.upper(readable("preview")).alias("preview_upper"),
    )


def prepared_outputs(outputs: DataFrame) -> DataFrame:
    own = F.coalesce(F.col("aliases"), F.array().cast("array<string>"))
    id_ = F.coalesce(F.col("output_id"), F.lit(""))
    names = outputs.withColumns({"_id": id_, "_name": F.coalesce("output_name", F.lit("")), "_aliases": F.when(F.size(own) > 0, own).otherwise(F.array("output_name"))})
    names = names.withColumn("_aliases", F.split(nfkc(F.array_join("_aliases", "\x00")), "\x00"))  # composed in one call
    alias_keys = F.flatten(F.transform("_aliases", lambda a: F.array(composed_key(a), composed_key(without_parentheses(a)))))
    distinct = lambda a: F.array_distinct(F.filter(a, lambda k: k != ""))
    return names.select(
        "output_key",
        F.upper("_id").alias("id_upper"),
        F.upper(id_prefix(F.col("_id"))).alias("prefix_upper"),
        distinct(alias_keys).alias("alias_keys"),
        distinct(F.transform("_aliases", lambda a: composed_key(without_parentheses(a)))).alias("title_keys"),
        distinct(F.concat(keys_of(nfkc(F.col("_name")), name_in_id(F.col("_id"))), alias_keys)).alias("output_core"),
    )


def core_pairs(files: DataFrame, outputs: DataFrame) -> DataFrame:
    """file_key, output_key: a core key of one holds one of the other; the held file key has four characters or more."""
    f = files.select("file_key", F.explode("core").alias("fk"))
    o = outputs.select("output_key", F.explode("output_core").alias("ok"))
    held = containment_join(f, "fk", o, "ok").select("file_key", "output_key")
    holds = containment_join(o, "ok", f.where(F.length("fk") >= 4), "fk").select("file_key", "output_key")
    return held.union(holds).distinct()


def any_of(values: Column, test) -> Column:
    return F.coalesce(F.exists(values, test), F.lit(False))


def pair_scores(pairs: DataFrame, use_output_id: bool = False) -> DataFrame:
    """pairs of prepared files and outputs -> file_key, output_key, score; without pairs that no rule or a conflict rules out."""
    names, aliases, titles = F.col("names"), F.col("alias_keys"), F.col("title_keys")
    held = lambda needle, where: (needle != "") & F.contains(where, needle)
    stem_upper = F.upper("stem")
    in_stem = held(F.col("id_upper"), stem_upper), held(F.col("prefix_upper"), stem_upper)
    in_preview = held(F.col("id_upper"), F.col("preview_upper")), held(F.col("prefix_upper"), F.col("preview_upper"))
    name_has_alias = any_of(aliases, lambda a: any_of(names, lambda n: F.contains(n, a)))
    by_name = (
        F.when(any_of(aliases, lambda a: F.array_contains(names, a)), NAME_EQUAL)
        .when(name_has_alias, NAME_HOLDS)
        .when(any_of(aliases, lambda a: any_of(names, lambda n: (F.length(n) >= 4) & F.contains(a, n))), ALIAS_HOLDS)
        .otherwise(0.0)
    )
    by_title = (
        F.when(F.array_contains(titles, F.col("title")), TITLE_EQUAL)
        .when(any_of(titles, lambda t: F.contains("title", t)), TITLE_HOLDS)
        .when(any_of(titles, lambda t: F.contains("preview", t)), PREVIEW_HOLDS)
        .otherwise(0.0)
    )
    related = any_of(titles, lambda t: F.contains("title", t) | F.contains(t, F.col("title")))
    found = F.regexp_extract_all(F.col("stem"), F.lit(ID_IN_NAME), F.lit(0))
    own = lambda x: F.contains("id_upper", F.upper(x)) | F.contains(F.upper(x), F.col("id_upper")) | ((F.col("prefix_upper") != "") & F.startswith(F.upper(x), F.col("prefix_upper")))
    other_id = (F.size(found) > 0) & ~any_of(found, own)

    named = name_has_alias | (in_stem[0] | in_stem[1] if use_output_id else F.lit(False))
    doubtful = (F.col("title") != "") & ~related & ~named
    joined = pairs.withColumn("_many", F.when(doubtful, titles)).withColumn("_ratio", best_gestalt_ratio(F.col("_many"), F.col("title")))
    joined = joined.where(F.col("_many").isNull() | (F.coalesce("_ratio", F.lit(0.0)) >= TITLES_DIFFER))
    best = F.greatest(by_title, by_name)
    if use_output_id:
        best = F.when(other_id & (F.greatest(F.when(in_preview[0], ID_EQUAL).when(in_preview[1], ID_PREFIX).otherwise(by_title), by_name) < LEAST_WITH_OTHER_ID), 0.0).when(in_preview[0], ID_EQUAL).when(in_preview[1], F.greatest(F.lit(ID_PREFIX), by_name)).otherwise(best)
        best = F.when(in_stem[0], ID_EQUAL).when(in_stem[1], ID_PREFIX).otherwise(best)
    return joined.select("file_key", "output_key", best.alias("score")).where("score > 0")


def file_scores(files: DataFrame, outputs: DataFrame, use_output_id: bool = False, threshold: float = TITLES_DIFFER) -> DataFrame:
    """file_key, output_key, score of all pairs from the threshold on.

    Files of one content are scored once and joined back. The prepared contents and outputs are written, as the joins of keys
    read them many times; they are dealt out before, as Spark moves Arrow functions over a distinct below it, to all its rows.
    """
    own = with_content(files)
    contents = own.drop("file_key").distinct().repartition("_content").withColumnRenamed("_content", "file_key").withColumn("error", F.lit(""))
    f, o = materialise(prepared_files(contents)), materialise(prepared_outputs(outputs.repartition("output_key")))
    pairs = core_pairs(f, o).join(f, "file_key").join(o, "output_key")
    scores = pair_scores(pairs, use_output_id).where(F.col("score") >= threshold).withColumnRenamed("file_key", "_content")
    return own.select("file_key", "_content").join(scores, "_content").select("file_key", "output_key", "score")
