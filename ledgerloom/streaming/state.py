"""Job status as incremental state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_status_stream(updates: DataFrame, keys: list[str], status: str, ts: str) -> DataFrame:
    """Last status per key. One small row of state per key; works on batches and on streams (update or complete mode)."""
    return updates.groupBy(*keys).agg(F.max_by(status, ts).alias(status), F.max(ts).alias(ts), F.count(F.lit(1)).alias("updates"))


def windowed_counts(updates: DataFrame, status: str, ts: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts per status and window; state older than the watermark is dropped."""
    return updates.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), status).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), status, "n")


def upsert_status(current_path: str, keys: list[str], ts: str, keep: int = 2):
    """A foreachBatch function that keeps a table of latest rows per key at current_path, in one version per batch.

    A batch starts from the newest version before it, so a batch that is run again gives the same version and a gap in
    the batch numbers loses nothing. The last `keep` versions stay, older ones go. The newest row of a key counts; of
    equal times any; a batch without rows writes the same rows again. current_path is a folder of the file system that
    Spark's default names.
    """

    def versions(spark) -> list[int]:
        path = spark._jvm.org.apache.hadoop.fs.Path(current_path)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
        done = [p for p in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName()[1:]) for p in done if p.getName()[1:].isdigit())

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = [v for v in versions(spark) if v < batch_id]
        newest = spark.read.parquet(f"{current_path}/v{before[-1]}").unionByName(batch) if before else batch
        columns = [c for c in batch.columns if c not in keys]
        newest.groupBy(*keys).agg(F.max_by(F.struct(*columns), ts).alias("r")).select(*keys, "r.*").write.mode("overwrite").parquet(f"{current_path}/v{batch_id}")
        for old in [v for v in versions(spark) if v <= batch_id][:-keep]:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{current_path}/v{old}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return write
