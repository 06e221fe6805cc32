"""Job states: the stream against the whole table, and against plain Python."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.streaming.jobs import COLUMNS, FINAL, current_rows, job_state_stream, job_states, upsert_buckets

SCHEMA = "job_id string, at timestamp, seq long, kind string, status string, error string, requirement_id string, item_status string, tc_count int, ts_count int, placed array<string>"
START = datetime(2024, 1, 1)


def made(n=900):
    rng = random.Random(4)
    rows = []
    for seq in range(n):
        kind = rng.choices(["create", "update", "item"], [1, 3, 9])[0]
        at = START + timedelta(minutes=rng.randint(0, 600))
        item = (rng.choice(["R1", "R2", "R3", None]), rng.choice(["updated", "error", None]), rng.choice([None, 2, 5]), rng.randint(0, 3), rng.choice([None, [], ["a"], ["a", "b"]])) if kind == "item" else (None,) * 5
        rows.append((f"j{rng.randint(0, 24)}", at, seq, kind, rng.choice([None, "running", "updated", "error"]) if kind != "create" else None, rng.choice([None, None, "", "broken"]) if kind != "create" else None, *item))
    return rows + [("never", START, 9000, "item", "running", None, "R", "updated", 1, 1, ["x"]), (None, START, 9001, "create", *(None,) * 7)] + rows[:40]


def plain(rows, watermark):
    jobs = {}
    for r in sorted({(*r[:10], tuple(r[10]) if r[10] is not None else None) for r in rows if r[0]}, key=lambda r: (r[1], r[2])):
        job, at, _, kind, status, error, requirement, item_status, tc, ts, placed = r
        if kind == "create":
            jobs[job] = {"status": "queued", "error": "", "items": {}}
        elif job not in jobs:
            continue
        else:
            jobs[job] |= {k: v for k, v in (("status", status), ("error", error)) if v is not None}
            if kind == "item":
                jobs[job]["items"][requirement or ""] = (item_status, tc or 0, ts or 0, len(placed or ()))
        jobs[job]["at"] = at
    out = []
    for name, j in jobs.items():
        items = list(j["items"].values())
        done = [i for i in items if i[0] == "updated"]
        placed = sum(i[3] for i in items)
        silent = j["status"] not in FINAL and watermark is not None and j["at"] + timedelta(minutes=10) <= watermark
        out.append((name, j["status"], j["error"], len(items), len(done), sum(i[0] == "error" for i in items), sum(i[1] for i in done), sum(i[2] for i in done), placed, placed > 0, j["at"], silent))
    return sorted(out)


def listed(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


@pytest.fixture(scope="module")
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(key, before)


def streamed(spark, tmp_path, batches, late, silent_ms=600_000):
    """The last row of each job that the stream gives for files read one after another, and the sink table's rows."""
    source, told = tmp_path / "in", []
    sink = upsert_buckets(str(tmp_path / "sink"), ["job_id"], ["updated_at", "silent", "requirement_count"], 5)

    def take(batch, n):
        told.extend((n, r) for r in batch.select(*COLUMNS).collect())
        sink(batch, n)

    spark.createDataFrame([], SCHEMA).write.parquet(str(source))
    stream = spark.readStream.schema(SCHEMA).parquet(str(source))
    run = job_state_stream(stream, late, silent_ms).writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        for rows in batches:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
            run.processAllAvailable()
    finally:
        run.stop()
    last = {}
    for n, r in sorted(told, key=lambda x: (x[0], x[1].silent)):
        last[r.job_id] = tuple(r)
    return sorted(last.values()), told


def test_whole_table(spark):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA)
    assert listed(job_states(df)) == plain(rows, None)
    watermark = START + timedelta(minutes=500)
    assert listed(job_states(df, F.lit(watermark).cast("timestamp"))) == plain(rows, watermark)
    assert job_states(df.limit(0)).count() == 0


def test_stream_of_late_repeated_and_shuffled_updates(rocks, tmp_path):
    rows = made()
    random.Random(8).shuffle(rows)
    found, _ = streamed(rocks, tmp_path, [rows[:300], rows[300:310], rows[310:], rows[:50]], "30 days")
    assert found == plain(rows, None)


def test_silent_jobs_and_too_late_updates(rocks, tmp_path):
    at = lambda m: START + timedelta(minutes=m)
    row = lambda job, m, seq, kind, status=None: (job, at(m), seq, kind, status, *(None,) * 6)
    first = [row("a", 0, 1, "create"), row("b", 0, 2, "create"), row("b", 1, 3, "update", "updated"), row("c", 0, 4, "create"), row("c", 58, 5, "update", "running")]
    later = [row("d", 60, 6, "create"), row("a", 2, 7, "update", "running")]  # a's is older than the watermark
    found, told = streamed(rocks, tmp_path, [first, later], "5 minutes")
    state = {r[0]: (r[1], r[-1]) for r in found}
    assert state == {"a": ("queued", True), "b": ("updated", False), "c": ("running", False), "d": ("queued", False)}
    assert [r.silent for _, r in told if r.job_id == "a"] == [False, True]
    table = current_rows(rocks, str(tmp_path / "sink"))
    assert {r.job_id: (r.status, r.silent) for r in table.collect()} == state


def test_buckets_are_rewritten_only_where_touched(spark, tmp_path):
    folder = str(tmp_path / "t")
    write = upsert_buckets(folder, ["k"], ["n"], 8)
    frame = lambda rows: spark.createDataFrame(rows, "k string, n long, v string")
    write(frame([(f"k{i}", 1, "old") for i in range(40)]), 0)
    write(frame([("k3", 2, "new"), ("k4", 0, "older")]), 1)
    write(frame([("k3", 2, "new"), ("k4", 0, "older")]), 1)
    write(frame([]), 2)
    rows = {r.k: r.v for r in current_rows(spark, folder).collect()}
    assert len(rows) == 40 and rows["k3"] == "new" and rows["k4"] == "old"
    assert len([p for p in (tmp_path / "t" / "batch=1").iterdir() if p.is_dir()]) <= 2
    assert current_rows(spark, str(tmp_path / "none")) is None
