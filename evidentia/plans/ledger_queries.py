"""Queries over runs and events. Users of `events` are runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ledger as g
from .registry import query


@query("RL1 D17 ST1", "SELECT user_id AS run, max_by(event_type, event_id) AS state, max(event_id) AS last_event, count(*) AS n_events FROM events GROUP BY user_id")
def run_state(x):
    return g.current_state(x.events.withColumnRenamed("user_id", "run"), "run", "event_id", F.col("event_type"))


@query("RL1 W9", "SELECT user_id AS run, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events")
def event_sequence(x):
    return x.events.select(F.col("user_id").alias("run"), "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("seq"))


@query("RL2 A12", "SELECT user_id, event_type, CAST(floor(value) AS BIGINT) AS target, min(event_id) AS event_id FROM events GROUP BY ALL")
def work_dedup(x):
    e = x.events.select("user_id", "event_type", F.floor("value").alias("target"), "event_id")
    return g.unique_work(e, ["user_id", "event_type", "target"], ["event_id"])


@query("RL3 W16", """
WITH i AS (SELECT user_id, event_id, CASE event_id % 3 WHEN 0 THEN 'queued' WHEN 1 THEN 'claimed' ELSE 'done' END AS status, CAST(value AS DOUBLE) AS lease_until FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM i WHERE status = 'queued' OR (status = 'claimed' AND lease_until < 50))
SELECT user_id, event_id, status FROM k WHERE n = 1""")
def work_claim_next(x):
    status = F.when(F.col("event_id") % 3 == 0, "queued").when(F.col("event_id") % 3 == 1, "claimed").otherwise("done")
    items = x.events.select("user_id", "event_id", status.alias("status"), F.col("value").alias("lease_until"))
    return g.claim_next(items, "user_id", F.lit(50.0), ["event_id"]).select("user_id", "event_id", "status")


@query("SK6", """
WITH f AS (SELECT o_custkey, o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') AS age, CAST(floor(o_totalprice) AS BIGINT) AS size FROM orders),
r AS (SELECT *, sum(size) OVER (PARTITION BY o_custkey ORDER BY age, o_orderkey DESC ROWS UNBOUNDED PRECEDING) AS running FROM f WHERE age <= 1500)
SELECT o_custkey, o_orderkey, CAST(age AS BIGINT) AS age FROM r WHERE running <= 1000000""")
def retention_sweep(x):
    age = F.datediff(F.lit("1999-01-01").cast("date"), F.col("o_orderdate").cast("date")).cast("long")
    f = x.orders.select("o_custkey", "o_orderkey", age.alias("age"), F.floor("o_totalprice").alias("size"))
    return g.retained(f, "o_custkey", "age", "size", ["age", F.desc("o_orderkey")], 1500, 1_000_000).select("o_custkey", "o_orderkey", "age")


_SESSIONS = """
e AS (SELECT user_id, ts, CASE WHEN date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts), ts) >= 1800000000 OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM e)"""


@query("ST3 AC10", f"WITH {_SESSIONS} SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS began, count(*) AS n FROM s GROUP BY user_id, no")
def session_windows(x):
    """Sessions with a gap of 30 minutes."""
    e = x.events.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    w = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("s")).agg(F.count("*").alias("n"))
    return w.select("user_id", F.date_format("s.start", "yyyy-MM-dd HH:mm:ss").alias("began"), "n")


@query("RL5 ST4", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, count(DISTINCT user_id) AS sessions, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def job_counts(x):
    h = F.date_format(F.date_trunc("hour", F.col("ts").cast("timestamp")), "yyyy-MM-dd HH")
    return x.events.groupBy(h.alias("hour"), "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("sessions"), F.round(F.sum("value"), 4).alias("total"))


@query("K8 PF21 C35", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) <= 50 THEN 'lte' ELSE 'gt' END AS check_ FROM events")
def json_checks(x):
    k = F.get_json_object("props", "$.k").cast("long")
    return x.events.select("event_id", k.alias("k"), F.when(k <= 50, "lte").otherwise("gt").alias("check_"))


@query("C3", "SELECT user_id, sum(CAST(value AS DOUBLE)) > 0 AS used, round(count(*) / nullif(sum(value), 0), 6) AS rate, round(sum(value) / 1e9, 12) AS seconds FROM events GROUP BY user_id")
def call_metrics(x):
    g_ = x.events.groupBy("user_id").agg(F.sum("value").alias("v"), F.count("*").alias("n"))
    return g_.select("user_id", (F.col("v") > 0).alias("used"), F.round(F.try_divide(F.col("n").cast("double"), F.col("v")), 6).alias("rate"), F.round(F.col("v") / 1e9, 12).alias("seconds"))


@query("W23", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 6")
def newest_kept(x):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id")))
    return x.events.withColumn("n", n).filter("n <= 6").select("user_id", "event_id")
