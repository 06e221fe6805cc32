"""Matching by questions: candidates from titles, names, paths and covers; one question per output; answers kept, checked and repaired.

files: file_key, path, stem, title, cover. outputs: output_key, output_name, wanted (false: known, but not asked for). path_hits:
file_key, output_key pairs of folder templates. Keys of names and titles are composed_key's. Files without cover text are
left out; a null wanted counts as true; repeated rows count once; empty tables give no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.completion import selected_numbers
from ..functions.titles import composed_key
from .match import containment_join

# The question's text.
QUESTION = """You are matching project output files.
Output target:
- output_name: {name}
- expected_project_title: {project}

Select every matching file index. Do not stop after a few files.
Exclude only files whose cover_text says another document type.
Return only compact JSON with numeric indexes. Never return file names.
Good: {{"selected":[1,2,3,4]}}
Bad: {{"selected":["file.xlsx"]}}

Candidate files:
{files}"""
COVER_CHARS = 260


def candidate_pairs(files: DataFrame, outputs: DataFrame, path_hits: DataFrame) -> DataFrame:
    """file_key, output_key, direct, in_cover: files whose title names one wanted output are direct matches; others are candidates.

    A title that names several wanted outputs leaves these; one that names only others leaves none; without a title's help all
    outputs count that the file's name or cover holds or that its path stands for. All by equi-joins on keys, anchors or paths.
    """
    own = files.select("file_key", composed_key("title").alias("_title"), composed_key("stem").alias("_stem"), composed_key("cover").alias("_cover")).where("coalesce(_cover, '') <> ''")
    names = outputs.select("output_key", composed_key("output_name").alias("_name"), F.coalesce("wanted", F.lit(True)).alias("wanted")).where("_name <> ''")
    wanted = names.where("wanted").select("output_key", "_name").distinct()
    titled = own.join(names.withColumnRenamed("_name", "_title"), "_title").groupBy("file_key").agg(F.collect_set(F.when(F.col("wanted"), F.col("output_key"))).alias("_hits"))
    of_title = titled.select("file_key", F.explode("_hits").alias("output_key"), (F.size("_hits") == 1).alias("direct"))
    free = own.join(titled, "file_key", "left_anti").select("file_key", "_stem", "_cover")
    by_name = containment_join(free.select("file_key", "_stem"), "_stem", wanted, "_name").select("file_key", "output_key", F.lit(False).alias("in_cover"))
    by_cover = containment_join(free.select("file_key", "_cover"), "_cover", wanted, "_name").select("file_key", "output_key", F.lit(True).alias("in_cover"))
    by_path = path_hits.join(free.select("file_key"), "file_key", "left_semi").join(wanted.select("output_key"), "output_key", "left_semi").select("file_key", "output_key", F.lit(False).alias("in_cover"))
    hinted = by_name.union(by_cover).union(by_path).groupBy("file_key", "output_key").agg(F.max("in_cover").alias("in_cover")).withColumn("direct", F.lit(False))
    return of_title.distinct().withColumn("in_cover", F.lit(True)).unionByName(hinted).select("file_key", "output_key", "direct", "in_cover")


def questions(pairs: DataFrame, files: DataFrame, outputs: DataFrame, project: str, most: int = 200) -> DataFrame:
    """output_key, part, question, candidates (array of file_key, in_cover, in the question's order): one for each output that has candidates.

    A question takes `most` files; an output with more has several (part 0, 1, ...), cut in the order of paths, so no list grows
    with the table and no candidate is left out. The order is dealt by a window on (output, hash of the file's folder), so
    a hot output's files meet in groups of one folder.
    """
    asked = pairs.where("not direct").join(files.select("file_key", "path", "cover").dropDuplicates(["file_key"]), "file_key")
    folder = F.regexp_extract("path", r"(?s)\A(.*/)?", 1)
    near = Window.partitionBy("output_key", "_folder").orderBy("path", "file_key")
    counted = asked.withColumn("_folder", folder).withColumn("_n", F.row_number().over(near) - 1)
    sizes = counted.groupBy("output_key", "_folder").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.partitionBy("output_key").orderBy("_folder").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = counted.join(before.drop("_size"), ["output_key", "_folder"]).withColumn("_place", F.col("_n") + F.col("_before"))
    line = lambda s, i: F.concat((i + 1).cast("string"), F.lit(". file_name="), F.substring_index(s["path"], "/", -1), F.lit("\n   path="), s["path"], F.lit("\n   cover_text="), F.left(F.regexp_replace(F.trim(s["cover"]), r"(?U)\s+", " "), F.lit(COVER_CHARS)))
    lists = placed.groupBy("output_key", F.floor(F.col("_place") / most).cast("int").alias("part")).agg(F.sort_array(F.collect_list(F.struct("_place", "file_key", "path", "cover", "in_cover"))).alias("_f"))
    named = lists.join(outputs.select("output_key", "output_name").dropDuplicates(["output_key"]), "output_key")
    text = F.lit(QUESTION.format(name="\x01", project=project, files="\x02"))
    filled = F.replace(F.replace(text, F.lit("\x01"), F.col("output_name")), F.lit("\x02"), F.array_join(F.transform("_f", line), "\n"))
    return named.select("output_key", "part", filled.alias("question"), F.transform("_f", lambda s: F.struct(s["file_key"].alias("file_key"), s["in_cover"].alias("in_cover"))).alias("candidates"))


class Answers:
    """Answers as one small file each, by the question's hash, in a folder that all executors share (any pyarrow file system)."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.store, self.root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)

    def path(self, key: str) -> str:
        return f"{self.root}/{key[:2]}/{key}"

    def get(self, key: str) -> str | None:
        try:
            with self.store.open_input_stream(self.path(key)) as f:
                return f.read().decode()
        except FileNotFoundError:
            return None

    def put(self, key: str, text: str) -> None:
        import uuid

        self.store.create_dir(f"{self.root}/{key[:2]}", recursive=True)
        part = f"{self.path(key)}.{uuid.uuid4().hex}"
        with self.store.open_output_stream(part) as f:
            f.write(text.encode())
        self.store.move(part, self.path(key))  # appears as a whole or not at all


def answered(questions: DataFrame, question: str, ask: Callable[[str], str], folder: str | None = None, tasks: int = 4, at_once: int = 4, seconds: float = 60, attempts: int = 2) -> DataFrame:
    """question_hash, answer, error for each distinct question.

    No more than tasks x at_once calls run at a time. With a folder every answer is kept as soon as it is there, and a kept one is
    never asked for again, by a task that runs once more or by a later job. A call that fails is tried `attempts`
    times, one that takes more than `seconds` not again; both end as an error, which is not kept.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    distinct = questions.select(F.sha2(F.col(question), 256).alias("question_hash"), F.col(question).alias("question")).where("question is not null").dropDuplicates(["question_hash"])

    def run(frames: Iterator) -> Iterator:
        import threading
        from concurrent.futures import ThreadPoolExecutor, wait

        import pandas as pd

        kept = Answers(folder) if folder else None

        def call(text: str, out: list) -> None:
            try:
                out.append((ask(text), None))
            except Exception as e:  # noqa: BLE001 - an error is data
                out.append((None, f"{type(e).__name__}: {e}"))

        def one(key: str, text: str) -> tuple:
            if kept and (old := kept.get(key)) is not None:
                return key, old, None
            for _ in range(attempts):
                out: list = []
                thread = threading.Thread(target=call, args=(text, out), daemon=True)
                thread.start()
                thread.join(seconds)
                if not out:
                    return key, None, f"TimeoutError: no answer in {seconds} seconds"
                if out[0][1] is None:
                    if kept:
                        kept.put(key, out[0][0])
                    break
            return key, *out[0]

        with ThreadPoolExecutor(at_once) as pool:
            for frame in frames:
                jobs = [pool.submit(one, k, t) for k, t in zip(frame["question_hash"], frame["question"], strict=True)]
                wait(jobs)
                yield pd.DataFrame([j.result() for j in jobs], columns=["question_hash", "answer", "error"], dtype=object)

    return distinct.repartition(tasks, "question_hash").mapInPandas(run, "question_hash string, answer string, error string")


def repaired(answer: Column, candidates: Column) -> Column:
    """Candidates that an answer selects, numbers out of range left out, and those whose cover names the output whatever it says."""
    chosen = selected_numbers(answer)
    return F.filter(candidates, lambda c: c["in_cover"] | F.array_contains(chosen, F.array_position(candidates, c)))


def matches_by_questions(files: DataFrame, outputs: DataFrame, path_hits: DataFrame, ask: Callable[[str], str], project: str = "", folder: str | None = None, **options) -> DataFrame:
    """output_key, file_key, source ('title' or 'answer'), error: direct matches and what answers select.

    A question without an answer still gives the files whose cover names the output, with the question's error.
    """
    pairs = candidate_pairs(files, outputs, path_hits)
    asked = questions(pairs, files, outputs, project)
    told = asked.withColumn("question_hash", F.sha2("question", 256)).join(answered(asked, "question", ask, folder, **options), "question_hash")
    chosen = told.select("output_key", F.explode(repaired(F.col("answer"), F.col("candidates"))).alias("c"), "error").select("output_key", "c.file_key", F.lit("answer").alias("source"), "error")
    return pairs.where("direct").select("output_key", "file_key", F.lit("title").alias("source"), F.lit(None).cast("string").alias("error")).union(chosen)


def accepted_pairs(rule_pairs: DataFrame, proposed: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """left, right, source: pairs by rule, and of the proposed ones (pos, left, right) those whose names exist and are in no pair yet.

    The first proposal of a name counts; one that loses its left name to an earlier one gives way on the right too.
    """
    free = proposed
    for names, side in ((left, "left"), (right, "right")):
        free = free.join(names.select(side).distinct(), side, "left_semi").join(rule_pairs.select(side), side, "left_anti")
    for side in ("left", "right"):
        free = free.groupBy(side).agg(F.min_by(F.struct(*[c for c in ("pos", "left", "right") if c != side]), "pos").alias("f")).select(side, "f.*")
    return rule_pairs.select("left", "right", F.lit("rule").alias("source")).unionByName(free.select("left", "right", F.lit("proposed").alias("source")))
