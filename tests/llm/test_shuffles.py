"""Shuffles of what is written are gone when the write ends, so disk doesn't wait for the driver's garbage collection."""


def shuffle_blocks(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(i).getName() for i in range(files.size())]
    return {n for n in names if n.startswith("shuffle_")}


def test_suffix_dedup_leaves_no_shuffles_and_one_folder(spark, sf_dir):
    from ledgerloom.llm.common import written
    from ledgerloom.llm.suffix_dedup import remove_repeats

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.count()
    before, folders = shuffle_blocks(spark), len(written(spark))
    out = remove_repeats(docs)
    left = shuffle_blocks(spark) - before
    assert len(left) <= 2 * docs.rdd.getNumPartitions()  # of the sum over all texts, one row a task
    assert len(written(spark)) == folders + 1
    assert out.count() == docs.count()


def test_syndromes_are_written_before_the_joins(spark):
    """Before, the joins' keys were expressions that the driver carried through its planning, and few tasks made all keys."""
    from pyspark.sql import functions as F

    from ledgerloom.llm.simhash import fuzzy_keys

    keys = fuzzy_keys(spark.range(3).select(F.xxhash64("id").alias("fp")))
    assert "bit_count" not in keys._jdf.queryExecution().optimizedPlan().toString()
    assert keys.select("fp").distinct().count() == 3
