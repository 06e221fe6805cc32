"""Role completeness, gaps, statuses and counters over events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.audit import counters, long_counters
from ..operators.dedup import collapse_runs, first_by, merge_upsert, top_k
from ..operators.fill import forward_fill
from ..operators.gaps import complete_keys, missing_roles, with_fallback
from .common import Book, table

book = Book()
ROLES = ["click", "error", "purchase", "signup", "view"]



def events(spark, d):
    return table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))


@book.query("SELECT user_id, strftime(ts, '%Y-%m-%d') AS day FROM events GROUP BY ALL HAVING count(DISTINCT event_type) = 5")
def role_complete(spark, d):
    """Keys that have all roles."""
    return complete_keys(events(spark, d), ["user_id", "day"], "event_type", ROLES)


@book.query("""WITH k AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, list_sort(list(DISTINCT event_type)) AS have FROM events GROUP BY ALL)
SELECT user_id, day, array_to_string(list_filter(['click','error','purchase','signup','view'], lambda x: NOT list_contains(have, x)), ',') AS missing FROM k WHERE len(have) < 5""")
def role_gaps(spark, d):
    """Keys that lack roles, with what they lack."""
    return missing_roles(events(spark, d), ["user_id", "day"], "event_type", ROLES).withColumn("missing", F.array_join("missing", ","))


@book.query("SELECT event_type, count(DISTINCT (user_id, strftime(ts, '%Y-%m-%d'))) AS n_keys FROM events GROUP BY event_type")
def role_counts(spark, d):
    """Distinct keys per role."""
    return events(spark, d).select("event_type", "user_id", "day").distinct().groupBy("event_type").agg(F.count(F.lit(1)).alias("n_keys"))


@book.query("""WITH t AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, max(event_id) AS id FROM events WHERE event_type='view' GROUP BY ALL),
s AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, max(event_id) AS id FROM events WHERE event_type='purchase' GROUP BY ALL)
SELECT t.user_id, t.day, coalesce(s.id, t.id) AS id FROM t LEFT JOIN s USING (user_id, day)""")
def placement_left_join(spark, d):
    """Targets keep their place; an input for the same key replaces the file."""
    best = lambda kind: events(spark, d).where(F.col("event_type") == kind).groupBy("user_id", "day").agg(F.max("event_id").alias("id"))
    return with_fallback(best("view"), best("purchase"), ["user_id", "day"], "id")


@book.query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) r FROM events) WHERE r = 1""")
def role_best_file(spark, d):
    """Best scored file per key and role."""
    return first_by(table(spark, d, "events"), ["user_id", "event_type"], [F.desc("value"), F.col("event_id")]).select("user_id", "event_type", "event_id", "value")


@book.query("""SELECT user_id, event_type, string_agg(event_id, ',' ORDER BY r) AS top5 FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) r FROM events) WHERE r <= 5 GROUP BY ALL""")
def role_top5(spark, d):
    """Five best candidates per key and role as a list."""
    top = top_k(table(spark, d, "events"), ["user_id", "event_type"], [F.desc("value"), F.col("event_id")], 5)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "event_id"))), lambda s: s["event_id"].cast("string"))
    return top.groupBy("user_id", "event_type").agg(F.array_join(ordered, ",").alias("top5"))


@book.query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS last_ts FROM events GROUP BY user_id")
def latest_status(spark, d):
    """Current status per job: the last event."""
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("last_ts"))


@book.query("SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1")
def status_histogram(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@book.query("SELECT event_id, coalesce(last_value(CASE WHEN event_type='signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), -1) AS parent_id FROM events")
def forward_fill_parent(spark, d):
    """Rows take the last parent id above them."""
    return forward_fill(table(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], {"parent_id": F.when(F.col("event_type") == "signup", F.col("event_id"))}).select("event_id", F.coalesce("parent_id", F.lit(-1)).alias("parent_id"))


@book.query("""SELECT event_id, coalesce(last_value(CASE WHEN event_type='signup' THEN event_id END IGNORE NULLS) OVER w, -1) AS level1, coalesce(last_value(CASE WHEN event_type='purchase' THEN event_id END IGNORE NULLS) OVER w, -1) AS level2, coalesce(last_value(CASE WHEN event_type='error' THEN event_id END IGNORE NULLS) OVER w, -1) AS level3
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def hierarchical_fill(spark, d):
    """Three indent levels; a deeper level stays when a higher one changes."""
    level = lambda kind: F.when(F.col("event_type") == kind, F.col("event_id"))
    return forward_fill(table(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], {"level1": level("signup"), "level2": level("purchase"), "level3": level("error")}).select("event_id", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("level1", "level2", "level3")])


@book.query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) p FROM events) WHERE p IS NULL OR p <> event_type")
def consecutive_dedup(spark, d):
    """Runs of one value collapse to their first row."""
    return collapse_runs(table(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], "event_type").select("event_id", "user_id", "event_type")


@book.query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus='F') AS done, count(*) FILTER (o_orderstatus='O') AS open, count(*) FILTER (o_orderstatus='P') AS partial, count(*) FILTER (o_totalprice > 250000) AS large FROM orders GROUP BY 1")
def status_counters(spark, d):
    """Conditional counters in one pass."""
    s = F.col("o_orderstatus")
    return counters(table(spark, d, "orders"), {"done": s == "F", "open": s == "O", "partial": s == "P", "large": F.col("o_totalprice") > 250000}, ("o_orderpriority",))


@book.query("SELECT unnest(['done','open','partial','large']) AS metric, unnest([count(*) FILTER (o_orderstatus='F'), count(*) FILTER (o_orderstatus='O'), count(*) FILTER (o_orderstatus='P'), count(*) FILTER (o_totalprice > 250000)]) AS value FROM orders")
def audit_unpivot(spark, d):
    """The same counters as rows metric, value."""
    s = F.col("o_orderstatus")
    return long_counters(table(spark, d, "orders"), {"done": s == "F", "open": s == "O", "partial": s == "P", "large": F.col("o_totalprice") > 250000})


@book.query("""WITH retry AS (SELECT event_id, user_id, 'retried' AS event_type FROM events WHERE event_type='error')
SELECT event_type AS status, count(*) AS n FROM (SELECT event_id, user_id, event_type FROM events WHERE event_type <> 'error' UNION ALL SELECT * FROM retry) GROUP BY 1""")
def merge_retry(spark, d):
    """Retried items replace their failed rows; counters follow."""
    old = table(spark, d, "events").select("event_id", "user_id", "event_type")
    new = old.where("event_type = 'error'").withColumn("event_type", F.lit("retried"))
    return merge_upsert(old, new, ["event_id"]).groupBy(F.col("event_type").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@book.query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN json_extract(props, '$.k') IS NULL THEN 'missing' WHEN CAST(json_extract(props, '$.k') AS BIGINT) >= 50 THEN 'high' ELSE 'low' END AS verdict FROM events""")
def json_validate(spark, d):
    """Parsed payloads with a verdict; what can't be parsed is missing, not an error."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, d, "events").select("event_id", k.alias("k"), F.when(k.isNull(), "missing").when(k >= 50, "high").otherwise("low").alias("verdict"))


@book.query("SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds, count(*) AS n FROM events GROUP BY user_id")
def distinct_sorted_ids(spark, d):
    """Sorted distinct ids and row count per file."""
    return table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"), F.count(F.lit(1)).alias("n"))


@book.query("SELECT user_id FROM events WHERE event_type='signup' INTERSECT SELECT user_id FROM events WHERE event_type='purchase' INTERSECT SELECT user_id FROM events WHERE event_type='error'")
def role_intersection(spark, d):
    e = table(spark, d, "events")
    of = lambda kind: e.where(F.col("event_type") == kind).select("user_id")
    return of("signup").intersect(of("purchase")).intersect(of("error"))


QUERIES, ORACLE_SQL = book.queries, book.sql
