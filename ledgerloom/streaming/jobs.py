"""States of jobs out of their updates: the same rules over a whole table and as keyed state of a stream.

updates: job_id, at (timestamp), seq (orders updates of one time), kind ('create', 'update' or 'item'), status, error,
requirement_id, item_status, tc_count, ts_count, placed (array of paths). The order of updates is (at, seq), not that of
arrival, so late, repeated and out-of-order updates give the state that the whole table gives.

* A job exists from its newest create on; updates before that count no more, updates of a job that was never created don't count.
* status and error are the last that an update or item sets ('queued' and '' until then).
* An item replaces what the job holds for its requirement (null: the empty one); counters are those of the items held.

A job that is not final and has no update within `silent` before the watermark is silent.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

FINAL = ("updated", "error", "cancelled", "interrupted")
SILENT_MS = 600_000
STATE = "job_id string, status string, error string, requirement_count int, processed_count int, failed_count int, tc_count bigint, ts_count bigint, placed_count int, ok boolean, updated_us bigint, silent boolean"
COLUMNS = ("job_id", "status", "error", "requirement_count", "processed_count", "failed_count", "tc_count", "ts_count", "placed_count", "ok", "updated_at", "silent")


def prepared(updates: DataFrame) -> DataFrame:
    """The columns that both ways read; counts of placed paths instead of paths."""
    count = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias(c)
    placed = F.when(F.col("placed").isNull(), 0).otherwise(F.size("placed")).alias("placed")
    requirement = F.coalesce("requirement_id", F.lit("")).alias("requirement_id")
    return updates.where("job_id is not null and at is not null").select("job_id", "at", F.unix_micros(F.col("at").cast("timestamp")).alias("us"), F.coalesce("seq", F.lit(0)).cast("bigint").alias("seq"), "kind", "status", "error", requirement, "item_status", count("tc_count"), count("ts_count"), placed)


def job_states(updates: DataFrame, watermark: Column | None = None, silent_ms: int = SILENT_MS, final: tuple[str, ...] = FINAL) -> DataFrame:
    """A row for each created job. watermark: a timestamp up to which updates are known; null, as by default: no job is silent.

    Sums per job and requirement come first, so that a hot job is a few rows per task; its join to the creation has a row
    per job on one side, which adaptive execution splits.
    """
    rows = prepared(updates).withColumn("stamp", F.struct("us", "seq"))
    created = rows.where("kind = 'create'").groupBy("job_id").agg(F.max("stamp").alias("created"))
    live = rows.join(created, "job_id").where("stamp >= created")
    told = F.col("kind").isin("update", "item") & (F.col("stamp") > F.col("created"))
    each = live.groupBy("job_id", F.when((F.col("kind") == "item") & told, F.col("requirement_id")).alias("requirement_id")).agg(
        F.max_by(F.struct("item_status", "tc_count", "ts_count", "placed"), "stamp").alias("item"),
        F.max(F.when(told & F.col("status").isNotNull(), F.struct("stamp", "status"))).alias("s"),
        F.max(F.when(told & F.col("error").isNotNull(), F.struct("stamp", "error"))).alias("e"),
        F.max("us").alias("us"),
    )
    held, done = F.col("requirement_id").isNotNull(), F.col("item.item_status") == "updated"
    total = lambda value, when: F.coalesce(F.sum(F.when(when, value)), F.lit(0))
    jobs = each.groupBy("job_id").agg(
        F.coalesce(F.max("s")["status"], F.lit("queued")).alias("status"),
        F.coalesce(F.max("e")["error"], F.lit("")).alias("error"),
        total(1, held).cast("int").alias("requirement_count"),
        total(1, held & done).cast("int").alias("processed_count"),
        total(1, held & (F.col("item.item_status") == "error")).cast("int").alias("failed_count"),
        total(F.col("item.tc_count"), held & done).alias("tc_count"),
        total(F.col("item.ts_count"), held & done).alias("ts_count"),
        total(F.col("item.placed"), held).cast("int").alias("placed_count"),
        F.max("us").alias("us"),
    )
    late = (F.lit(None) if watermark is None else F.unix_micros(watermark.cast("timestamp"))) >= F.col("us") + F.lit(silent_ms * 1000)
    out = jobs.withColumns({"ok": F.col("placed_count") > 0, "updated_at": F.timestamp_micros("us"), "silent": ~F.col("status").isin(*final) & F.coalesce(late, F.lit(False))})
    return out.select(*COLUMNS)


class JobProcessor(StatefulProcessor):
    """Value state: what is known of the job and its counters. Map state: the newest item of each requirement. One timer while the job is not final."""

    FIELDS = ("created", "status", "status_at", "error", "error_at", "us", "items", "processed", "failed", "tc", "ts", "placed", "timer")
    NOTHING = (-1, -1)

    def __init__(self, silent_ms: int, final: tuple[str, ...]):
        self.silent_ms, self.final = silent_ms, final

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        stamp = "struct<us bigint, seq bigint>"
        self.job = handle.getValueState("job", f"created {stamp}, status string, status_at {stamp}, error string, error_at {stamp}, us bigint, items int, processed int, failed int, tc bigint, ts bigint, placed int, timer bigint")
        self.items = handle.getMapState("items", "requirement_id string", f"stamp {stamp}, item_status string, tc bigint, ts bigint, placed int")

    def known(self) -> dict:
        values = self.job.get() if self.job.exists() else (self.NOTHING, "", self.NOTHING, "", self.NOTHING, -1, 0, 0, 0, 0, 0, 0, 0)
        job = dict(zip(self.FIELDS, values, strict=True))
        return job | {k: tuple(job[k]) for k in ("created", "status_at", "error_at")}

    @staticmethod
    def count(job: dict, item: tuple, sign: int) -> None:
        _, status, tc, ts, placed = item
        done = sign * (status == "updated")
        for name, more in (("items", sign), ("processed", done), ("failed", sign * (status == "error")), ("tc", done * tc), ("ts", done * ts), ("placed", sign * placed)):
            job[name] += more

    def hold(self, job: dict, requirement: str, item: tuple) -> None:
        """The newer of two items of a requirement stays; counters change by the difference."""
        old = self.items.getValue((requirement,)) if self.items.exists() and self.items.containsKey((requirement,)) else None
        if old is None or tuple(old[0]) < item[0]:
            if old is not None:
                self.count(job, old, -1)
            self.items.updateValue((requirement,), item)
            self.count(job, item, 1)

    def forget(self, job: dict) -> None:
        """Items from before a new creation go."""
        for (requirement,), item in list(self.items.iterator()) if self.items.exists() else []:
            if tuple(item[0]) <= job["created"]:
                self.count(job, item, -1)
                self.items.removeKey((requirement,))

    def state(self, key: tuple, job: dict, silent: bool) -> Row:
        status = job["status"] if job["status_at"] > job["created"] else "queued"
        error = job["error"] if job["error_at"] > job["created"] else ""
        return Row(job_id=key[0], status=status, error=error, requirement_count=job["items"], processed_count=job["processed"], failed_count=job["failed"], tc_count=job["tc"], ts_count=job["ts"], placed_count=job["placed"], ok=job["placed"] > 0, updated_us=job["us"], silent=silent)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        job = self.known()
        for r in rows:
            stamp = (r.us, r.seq)
            if r.kind == "create":
                if stamp > job["created"]:
                    job["created"] = stamp
                    self.forget(job)
            elif r.kind in ("update", "item"):
                for name in ("status", "error"):
                    if r[name] is not None and (stamp, r[name]) > (job[f"{name}_at"], job[name]):
                        job[name], job[f"{name}_at"] = r[name], stamp
                if r.kind == "item" and stamp > job["created"]:
                    self.hold(job, r.requirement_id, (stamp, r.item_status, r.tc_count, r.ts_count, r.placed))
            job["us"] = max(job["us"], r.us)
        if job["timer"]:
            self.handle.deleteTimer(job["timer"])
        created = job["created"] != self.NOTHING
        out = self.state(key, job, False)
        job["timer"] = -(-job["us"] // 1000) + self.silent_ms if created and out.status not in self.final else 0
        if job["timer"]:
            self.handle.registerTimer(job["timer"])
        self.job.update(tuple(job[f] for f in self.FIELDS))
        if created:
            yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        job = self.known()
        job["timer"] = 0
        self.job.update(tuple(job[f] for f in self.FIELDS))
        yield self.state(key, job, True)

    def close(self) -> None:
        pass


def job_state_stream(updates: DataFrame, late: str = "1 hour", silent_ms: int = SILENT_MS, final: tuple[str, ...] = FINAL) -> DataFrame:
    """A row for each job that a batch changes, and one when a job turns silent (update mode). Updates older than the watermark are dropped.

    The session must use the RocksDB state store. State is a row per job and per requirement, and the work of a batch
    follows the batch, not the state; a new creation reads its job's items once.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the processor travels with the plan
    rows = prepared(updates.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late))
    out = rows.groupBy("job_id").transformWithState(JobProcessor(silent_ms, final), STATE, "update", "eventTime")
    return out.withColumn("updated_at", F.timestamp_micros("updated_us")).select(*COLUMNS)


def upsert_buckets(folder: str, keys: list[str], order: list[str], buckets: int = 64):
    """A foreachBatch function that keeps the newest row per key below folder, in buckets of the key's hash.

    A batch reads and writes only the buckets that it touches, into a folder of its own (batch=N); a bucket's rows are those
    of the newest finished batch that has it, so a batch that is run again gives the same, and current_rows needs no lock.
    Of two rows of a key the greater in `order` stays.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()
        try:
            touched = [r._bucket for r in new.select("_bucket").distinct().collect()]  # at most `buckets`
            old = current_rows(spark, folder, touched, batch_id)
            both = new if old is None else old.select(*new.columns).unionByName(new)
            rest = [c for c in batch.columns if c not in keys]
            newest = both.groupBy("_bucket", *keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select("_bucket", *keys, "r.*").select("_bucket", *batch.columns)
            newest.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{folder}/batch={batch_id}")
        finally:
            new.unpersist()

    return write


def current_rows(spark, folder: str, buckets: list[int] | None = None, before: int | None = None) -> DataFrame | None:
    """The newest rows of all or some buckets, as batches before `before` (default: all) left them; null if there are none."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    newest: dict[int, int] = {}
    for status in fs.listStatus(root) if fs.exists(root) else []:
        n = int(status.getPath().getName().removeprefix("batch="))
        if (before is None or n < before) and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            for part in fs.listStatus(status.getPath()):
                if part.isDirectory():
                    bucket = int(part.getPath().getName().removeprefix("_bucket="))
                    if buckets is None or bucket in buckets:
                        newest[bucket] = max(n, newest.get(bucket, -1))
    if not newest:
        return None
    return spark.read.option("basePath", folder).parquet(*[f"{folder}/batch={n}/_bucket={b}" for b, n in sorted(newest.items())]).drop("batch")
