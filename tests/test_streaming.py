"""Job states over batches and streams."""

from datetime import datetime, timedelta

from ledgerloom.streaming.state import latest_status_stream, upsert_status, windowed_counts

START = datetime(2024, 1, 1)
ROWS = [("a", "queued", 0), ("b", "queued", 1), ("a", "running", 2), ("a", "done", 70), ("c", "failed", 71), ("b", "running", 72)]


def updates(spark, rows):
    return spark.createDataFrame([(k, s, START + timedelta(minutes=m)) for k, s, m in rows], "job string, status string, ts timestamp")


def test_upserts_by_batch(spark, tmp_path):
    write = upsert_status(str(tmp_path / "jobs"), ["job"], "ts")
    state = lambda v: {r.job: r.status for r in spark.read.parquet(str(tmp_path / "jobs" / f"v{v}")).collect()}
    write(updates(spark, ROWS[:2]), 0)
    write(updates(spark, ROWS[2:3]), 1)
    assert state(1) == {"a": "running", "b": "queued"}
    write(updates(spark, ROWS[2:3]), 1)  # the same batch again
    write(updates(spark, ROWS[3:5]), 5)  # after a gap
    assert state(5) == {"a": "done", "b": "queued", "c": "failed"}
    write(updates(spark, []), 6)
    write(updates(spark, ROWS[:1]), 7)  # an old row changes nothing
    assert state(7) == state(6) == {"a": "done", "b": "queued", "c": "failed"}
    assert sorted(p.name for p in (tmp_path / "jobs").iterdir()) == ["v6", "v7"]


def test_latest_status_and_windows(spark, tmp_path):
    batch = updates(spark, ROWS)
    assert {(r.job, r.status, r.updates) for r in latest_status_stream(batch, ["job"], "status", "ts").collect()} == {("a", "done", 3), ("b", "running", 2), ("c", "failed", 1)}
    counts = {(r.window_start.hour, r.status): r.n for r in windowed_counts(batch, "status", "ts").collect()}
    assert counts == {(0, "queued"): 2, (0, "running"): 1, (1, "done"): 1, (1, "failed"): 1, (1, "running"): 1}
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = latest_status_stream(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")), ["job"], "status", "ts")
    run = stream.writeStream.outputMode("complete").format("memory").queryName("latest_jobs").option("checkpointLocation", str(tmp_path / "ck")).start()
    run.processAllAvailable()
    run.stop()
    assert {(r.job, r.status) for r in spark.table("latest_jobs").collect()} == {("a", "done"), ("b", "running"), ("c", "failed")}
