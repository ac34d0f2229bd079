"""Queries on sequences, trends and intervals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.operators import history, rollups
from tesserae.plans.metrics import _FC, changes_once
from tesserae.plans.registry import Registry
from tesserae.sources.tables import table

query = Registry()
QUERIES, SQL = query.queries, query.sql


def _daily(spark, root):
    e = table(spark, root, "events")
    return e.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 6).alias("v"))


_DAILY = "d as (select event_type, cast(ts as date) as day, round(sum(value), 6) v from events group by 1, 2)"


@query("""with l as (select event_type a, lead(event_type) over w b, epoch_us(lead(ts) over w) - epoch_us(ts) g from events window w as (partition by user_id order by ts, event_id))
select a as "first", b as "second", count(*) n, round(avg(g) / 1e6, 3) mean_seconds, round(least(0.9, count(*) / (select count(*) from events) + 0.3), 6) confidence from l where b is not null group by 1, 2 order by n desc, 1, 2 limit 10""")
def type_sequences(spark, root):
    return history.adjacent_pairs(table(spark, root, "events"), "user_id", "event_type", "ts", "event_id").orderBy(F.desc("n"), "first", "second").limit(10)


@query(f"""with {_FC}, l as (select id, path, lower(change_type.kind) k, lag(lower(change_type.kind)) over (partition by path order by modified_at, id) p from fc where path is not null and modified_at is not null)
select id, case when p is null or p = 'deleted' then 'created' when k = 'deleted' then 'deleted' else 'modified' end as derived_kind from l""")
def derived_change_kind(spark, root):
    c = changes_once(spark, root).where("path is not null and modified_at is not null").select("id", "path", "modified_at", rollups.kind().alias("k"))
    p = history.previous_rows(c, "path", ["modified_at", "id"], ["k"])
    return p.select("id", F.when(F.col("prev_k").isNull() | (F.col("prev_k") == "deleted"), "created").when(F.col("k") == "deleted", "deleted").otherwise("modified").alias("derived_kind"))


@query(f"""with {_FC}, l as (select id, size_bytes s, lag(size_bytes) over (partition by path order by modified_at, id) p from fc where path is not null and modified_at is not null)
select id, s - p size_step, case when p is null then 'introduced' when s > p then 'grown' when s < p then 'shrunk' else 'same' end as evolution from l""")
def size_evolution(spark, root):
    c = changes_once(spark, root).where("path is not null and modified_at is not null").select("id", "path", "modified_at", F.col("size_bytes").alias("s"))
    p = history.previous_rows(c, "path", ["modified_at", "id"], ["s"])
    step = F.col("s") - F.col("prev_s")
    return p.select("id", step.alias("size_step"), F.when(F.col("prev_s").isNull(), "introduced").when(step > 0, "grown").when(step < 0, "shrunk").otherwise("same").alias("evolution"))


@query(f"""with {_DAILY}, r as (select *, row_number() over (partition by event_type order by day desc) rn from d), n as (select * from r where rn <= 10), s as (select *, v - lag(v) over (partition by event_type order by day) x from n),
a as (select event_type, count(*) n, sum(case when x > 0 then 1 else 0 end) u, sum(case when x < 0 then 1 else 0 end) dn, arg_min(v, day) f, arg_max(v, day) l from s group by 1)
select event_type, n, case when u = 0 and dn = 0 then 'stable' when u / (n - 1) > 0.7 then 'increasing' when u / (n - 1) < 0.3 then 'decreasing' else 'volatile' end as direction, round(case when f = 0 then 0 else (l - f) / f end, 6) rate from a where n >= 10""")
def trends(spark, root):
    return history.trend(_daily(spark, root), "event_type", "day", "v", 10)


@query(f"with {_DAILY}, x as (select event_type, date_diff('day', date '2024-01-01', day)::double x, v from d) select event_type, round(regr_slope(v, x), 6) slope, round(regr_intercept(v, x) + regr_slope(v, x) * (max(x) + 7), 6) forecast from x group by 1")
def forecasts(spark, root):
    x = _daily(spark, root).withColumn("x", F.datediff("day", F.lit("2024-01-01")).cast("double"))
    return history.forecast(x, "event_type", "x", "v", 7)


@query("""with o as (select user_id, event_id, epoch_us(ts) / 1000000.0 b from events), f as (select *, case when b > max(b) over (partition by user_id order by b, event_id rows between unbounded preceding and 1 preceding) + 43200 then 1 when row_number() over (partition by user_id order by b, event_id) = 1 then 1 else 0 end x from o),
g as (select *, sum(x) over (partition by user_id order by b, event_id) i from f) select user_id, round(min(b), 3) as "begin", round(max(b), 3) as "end", count(*) n from g group by user_id, i""")
def activity_islands(spark, root):
    e = table(spark, root, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("b"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("e"))
    i = history.islands(e, "user_id", "b", "e", 43200.0, "event_id")
    return i.select("user_id", F.round("begin", 3).alias("begin"), F.round("end", 3).alias("end"), "n")


@query()
def clamped_scores(spark, root):
    e = table(spark, root, "events")
    return history.clamped_score(e, "user_id", ["ts", "event_id"], F.when(F.col("event_type") == "error", -0.05).otherwise(0.1))


@query("select user_id, event_id, round(avg(value) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row), 6) running_mean from events")
def running_mean(spark, root):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, root, "events").select("user_id", "event_id", F.round(F.avg("value").over(w), 6).alias("running_mean"))


@query("""with w as (select user_id, event_id, event_type, list(event_type) over (partition by user_id order by ts, event_id rows between 5 preceding and 1 preceding) h from events)
select user_id, event_id, case when h is null then 0.0 else round(len(list_filter(h, lambda x: x = event_type)) / len(h), 6) end as similarity from w""")
def similarity_to_last_five(spark, root):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-5, -1)
    e = table(spark, root, "events").withColumn("h", F.collect_list("event_type").over(w))
    same = F.size(F.filter("h", lambda x: x == F.col("event_type")))
    return e.select("user_id", "event_id", F.round(F.coalesce(F.try_divide(same, F.size("h")), F.lit(0.0)), 6).alias("similarity"))


@query("select user_id, event_id, ts from (select *, lag(ts) over (partition by user_id order by ts, event_id) p from events) where epoch_us(ts) - epoch_us(p) < 600000000")
def concurrent_edits(spark, root):
    """Events of a user within ten minutes of the one before."""
    p = history.previous_rows(table(spark, root, "events").select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"], ["ts"])
    return p.where(F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("prev_ts").cast("timestamp")) < 600_000_000).select("user_id", "event_id", "ts")


@query("with t as (select user_id, event_id, ts, row_number() over (partition by user_id order by ts, event_id) r from events) select user_id, event_id, r as position from t where r > 3 and r <= 6")
def changes_between_versions(spark, root):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, root, "events").withColumn("position", F.row_number().over(w).cast("long")).where("position > 3 and position <= 6").select("user_id", "event_id", "position")


@query("select event_type, count(*) n_days from (select distinct event_type, cast(ts as date) as day from events) group by 1 having count(*) >= 10")
def patterns_with_enough_points(spark, root):
    d = table(spark, root, "events").select("event_type", F.to_date("ts").alias("day")).distinct()
    return d.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_days")).where("n_days >= 10")
