"""Intermediate tables, written once and read back."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset one of this machine, which only a local master can use."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return f"{sc._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


@contextmanager
def shuffles_deleted(spark: SparkSession):
    """Within it a query's shuffles are deleted as the query ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def materialise(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: cuts lineage and survives lost executors.

    Nothing reads the write's shuffles again, so Spark deletes them as it ends.
    """
    path = shared_folder(df.sparkSession)
    with shuffles_deleted(df.sparkSession):
        df.write.option("compression", compression).parquet(path)
    written(df.sparkSession).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(spark: SparkSession) -> list[str]:
    """The folders that materialise has written in this application and drop_written has not deleted, in order."""
    sc = spark.sparkContext
    if not hasattr(sc, "_ledgerloom_written"):
        sc._ledgerloom_written = []
    return sc._ledgerloom_written


def drop_written(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders that nothing reads any more."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        written(spark).remove(p)
