"""Queries that run as streams to the end of their input; the SQL beside them is the batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import latest
from tesserae.plans.registry import Registry
from tesserae.streaming import jobs

query = Registry()
QUERIES, SQL = query.queries, query.sql


def _events(spark, root):
    e = jobs.stream_table(spark, root, "events")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


@query("select user_id, arg_max(event_id, (ts, event_id)) event_id, arg_max(event_type, (ts, event_id)) event_type from events group by 1")
def stream_latest_per_user(spark, root):
    s = _events(spark, root).select("user_id", F.unix_micros("ts").alias("at"), "event_id", "event_type")
    out = jobs.run_to_table(jobs.latest_per_key(s, "user_id", ["at", "event_id"], ["event_type"]), "update")
    return latest.latest_per_key(out, ["user_id"], ["_batch"], ["event_id", "event_type"])


@query("select strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as hour, event_type, count(*) n from events group by 1, 2")
def stream_hourly_counts(spark, root):
    out = jobs.run_to_table(jobs.windowed_counts(_events(spark, root), "ts", "event_type", "1 hour", "40 days"), "update")
    return latest.latest_per_key(out, ["begin", "event_type"], ["_batch"], ["n"]).select(F.date_format("begin", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


@query("""with o as (select user_id, event_id, ts, lag(ts) over (partition by user_id order by ts) p from events), g as (select *, sum(case when p is null or epoch_us(ts) - epoch_us(p) > 43200000000 then 1 else 0 end) over (partition by user_id order by ts, event_id) i from o)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as "begin", count(*) n from g group by user_id, i""")
def stream_sessions(spark, root):
    out = jobs.run_to_table(jobs.sessions(_events(spark, root), "ts", "user_id", "12 hours", "40 days"), "complete")
    return out.select("user_id", F.date_format("begin", "yyyy-MM-dd HH:mm:ss").alias("begin"), "n")


@query("select distinct user_id, event_type from events")
def stream_first_seen(spark, root):
    s = jobs.first_seen(_events(spark, root).select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "40 days")
    return jobs.run_to_table(s, "append").select("user_id", "event_type")
