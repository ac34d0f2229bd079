"""Queries on metrics and audit rollups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import rollups
from tesserae.operators.integrity import normal_key
from tesserae.operators.latest import keep_newest, latest_per_key, surviving
from tesserae.plans.registry import Registry
from tesserae.sources.tables import table

query = Registry()
QUERIES, SQL = query.queries, query.sql
AS_OF = "2024-01-20 12:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def checkpoints_once(spark: SparkSession, root: str) -> DataFrame:
    """Each checkpoint once, as last delivered."""
    return latest_per_key(table(spark, root, "checkpoints"), ["id"], ["ingested_at", F.coalesce("session_id", F.lit("")), F.coalesce("description", F.lit("")), F.coalesce("size_bytes", F.lit(-1))], ["session_id", "description", "created_at", "files_affected", "size_bytes", "parent_checkpoint_id", "is_full_snapshot", "delta_depth", "branch_id"])


_CP = """cp as (select * from (select *, row_number() over (partition by id order by ingested_at desc nulls last, coalesce(session_id, '') desc, coalesce(description, '') desc, coalesce(size_bytes, -1) desc) rn from checkpoints) where rn = 1)"""


def changes_once(spark: SparkSession, root: str) -> DataFrame:
    """Each file change once, without its texts."""
    c = table(spark, root, "file_changes")
    return latest_per_key(c, ["id"], ["ingested_at", F.coalesce("checkpoint_id", F.lit(""))], ["checkpoint_id", "path", "change_type", "size_bytes", "content_hash", "modified_at"])


def contents_once(spark: SparkSession, root: str, prepare: Callable[[DataFrame], DataFrame] | None = None, **derived: Column) -> DataFrame:
    """``id`` and columns derived from a change's texts, each change once, as last delivered.

    The columns are computed where the texts are read, over the rows as ``prepare`` leaves them; only they are
    shuffled to find the last delivery.
    """
    rows = table(spark, root, "file_changes")
    c = (prepare(rows) if prepare else rows).select("id", F.col("ingested_at").alias("_at"), F.coalesce("checkpoint_id", F.lit("")).alias("_cp"), *[e.alias(n) for n, e in derived.items()])
    return latest_per_key(c, ["id"], ["_at", "_cp"], list(derived))


_FC = """fc as (select * from (select *, row_number() over (partition by id order by ingested_at desc nulls last, coalesce(checkpoint_id, '') desc) rn from file_changes) where rn = 1)"""


@query("select id, last_accessed, workspace_path, checkpoint_count from (select *, row_number() over (partition by id order by last_accessed desc nulls last, ingested_at desc nulls last) rn from sessions) where rn = 1")
def latest_sessions(spark, root):
    return latest_per_key(table(spark, root, "sessions"), ["id"], ["last_accessed", "ingested_at"], ["last_accessed", "workspace_path", "checkpoint_count"])


@query(f"with {_CP} select lower(trim(session_id)) session_id, count(*) n_checkpoints, sum(coalesce(size_bytes, 0))::bigint total_size from cp where trim(coalesce(session_id, '')) <> '' group by 1")
def session_counters(spark, root):
    c = checkpoints_once(spark, root).withColumn("session_id", normal_key(F.col("session_id"))).where("session_id is not null")
    return c.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_checkpoints"), F.sum(F.coalesce("size_bytes", F.lit(0))).alias("total_size"))


@query(f"with {_CP} select count(*) n, coalesce(sum(size_bytes), 0)::bigint total_size, cast(coalesce(sum(size_bytes), 0) // greatest(count(*), 1) as bigint) mean_size, max(created_at) newest from cp")
def global_stats(spark, root):
    total = F.coalesce(F.sum("size_bytes"), F.lit(0))
    return checkpoints_once(spark, root).agg(F.count(F.lit(1)).alias("n"), total.alias("total_size"), F.expr("coalesce(sum(size_bytes), 0) div greatest(count(1), 1)").alias("mean_size"), F.max("created_at").alias("newest"))


@query(f"select event_type, count(*) n, round(avg(value), 6) mean_duration, round(sum(case when ts >= timestamp '{AS_OF}' - interval 1 hour then 1 else 0 end) / 3600.0, 9) per_second from events where ts >= timestamp '{AS_OF}' - interval 24 hour and ts <= timestamp '{AS_OF}' group by 1")
def operation_metrics(spark, root):
    return rollups.operation_metrics(table(spark, root, "events"), "event_type", "ts", "value", as_of())


@query("select event_type, count(*) n, sum(cast(json_extract(props, '$.k') as bigint))::bigint total_k from events where json_extract(props, '$.k') is not null group by 1")
def metadata_sum(spark, root):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, root, "events").withColumn("k", k).where("k is not null").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total_k"))


@query("select strftime(ts, '%Y-%m-%d') as day, count(*) n from events group by 1")
def daily_histogram(spark, root):
    return rollups.daily_histogram(table(spark, root, "events"), "ts")


@query(f"""with {_CP}, k as (select lower(trim(session_id)) s, * from cp where trim(coalesce(session_id, '')) <> ''),
f as (select s, max(created_at) t from k where is_full_snapshot group by 1)
select k.s session_id, sum(case when not is_full_snapshot and k.created_at > coalesce(f.t, timestamp '1970-01-01') then 1 else 0 end)::bigint n_deltas, max(f.t) last_full from k left join f using (s) group by 1""")
def deltas_since_full(spark, root):
    k = checkpoints_once(spark, root).withColumn("session_id", normal_key(F.col("session_id"))).where("session_id is not null")
    full = k.where("is_full_snapshot").groupBy("session_id").agg(F.max("created_at").alias("last_full"))
    newer = ~F.col("is_full_snapshot") & (F.col("created_at") > F.coalesce("last_full", F.lit("1970-01-01").cast("timestamp_ntz")))
    return k.join(full, "session_id", "left").groupBy("session_id").agg(F.sum(F.when(newer, 1).otherwise(0)).alias("n_deltas"), F.max("last_full").alias("last_full"))


@query("select round(coalesce(avg(case when event_type <> 'error' then 1.0 else 0.0 end), 1.0), 6) success_rate from (select * from events order by ts desc, event_id desc limit 1000)")
def success_rate(spark, root):
    r = rollups.success_rate(table(spark, root, "events"), F.col("event_type") != "error", [F.desc("ts"), F.desc("event_id")], 1000, 1.0)
    return r.select(F.round("success_rate", 6).alias("success_rate"))


@query(f"""with {_CP} select (select count(*) from cp) n_checkpoints, (select count(distinct id) from sessions) n_sessions, (select count(distinct user_id) from events) n_users,
(select round(avg(value), 6) from events where event_type = 'purchase') mean_value, (select count(*) from events where event_type = 'error') n_errors, (select sum(coalesce(size_bytes, 0))::bigint from cp) total_size""")
def dashboard(spark, root):
    cp = checkpoints_once(spark, root).agg(F.count(F.lit(1)).alias("n_checkpoints"), F.sum(F.coalesce("size_bytes", F.lit(0))).alias("total_size"))
    s = table(spark, root, "sessions").agg(F.countDistinct("id").alias("n_sessions"))
    e = table(spark, root, "events").agg(F.countDistinct("user_id").alias("n_users"), F.round(F.avg(F.when(F.col("event_type") == "purchase", F.col("value"))), 6).alias("mean_value"), F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("n_errors"))
    return cp.join(F.broadcast(s)).join(F.broadcast(e))  # each side is one row


@query(f"with {_FC} select count(*) n_rows, count(distinct sha256(new_content)) n_contents, coalesce(sum(strlen(new_content)), 0)::bigint total_bytes, (select coalesce(sum(s), 0)::bigint from (select max(strlen(new_content)) s from fc where new_content is not null group by sha256(new_content))) unique_bytes, (coalesce(sum(strlen(new_content)), 0) - (select coalesce(sum(s), 0) from (select max(strlen(new_content)) s from fc where new_content is not null group by sha256(new_content))))::bigint saved_bytes, round((select sum(s) from (select max(strlen(new_content)) s from fc where new_content is not null group by sha256(new_content))) / sum(strlen(new_content)), 6) ratio from fc where new_content is not null")
def content_sharing(spark, root):
    once = contents_once(spark, root, h=F.sha2("new_content", 256), size=F.octet_length("new_content").cast("long")).where("h is not null")
    return rollups.content_sharing(once, "h", "size")


@query(f"with {_FC} select checkpoint_id, n_created, n_modified, n_deleted, size_delta, '+' || n_created || ' =' || n_modified || ' -' || n_deleted summary from (select checkpoint_id, sum(case when lower(change_type.kind) = 'created' then 1 else 0 end)::bigint n_created, sum(case when lower(change_type.kind) in ('modified', 'renamed', 'moved') then 1 else 0 end)::bigint n_modified, sum(case when lower(change_type.kind) = 'deleted' then 1 else 0 end)::bigint n_deleted, coalesce(sum(case lower(change_type.kind) when 'created' then size_bytes when 'deleted' then -size_bytes else 0 end), 0)::bigint size_delta from fc group by 1)")
def change_counts(spark, root):
    return rollups.change_counts(changes_once(spark, root), "checkpoint_id")


@query(f"with {_FC}, p as (select checkpoint_id, path, regexp_replace(path, '/?[^/]*$', '') d, case when contains(path, '/') then split_part(path, '/', 1) else '' end t from fc where path is not null), n as (select checkpoint_id, count(distinct path) n_files, count(distinct d) n_folders, count(distinct t) n_tops from p group by 1) select *, case when n_files = 1 then 'file' when n_folders = 1 then 'folder' when n_tops = 1 then 'component' else 'project' end as scope from n")
def change_scope(spark, root):
    return rollups.change_scope(changes_once(spark, root), "checkpoint_id", "path")


@query(f"with {_FC}, x as (select checkpoint_id, lower(regexp_extract(path, '\\.([^./]+)$', 1)) e from fc) select checkpoint_id, array_to_string(list_sort(list(distinct e)), ',') extensions from x where e <> '' group by 1")
def distinct_extensions(spark, root):
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return changes_once(spark, root).select("checkpoint_id", ext.alias("e")).where("e <> ''").groupBy("checkpoint_id").agg(F.array_join(F.array_sort(F.collect_set("e")), ",").alias("extensions"))


@query("select l_partkey, sum(l_quantity) strength, round(sum(l_quantity) / (select max(s) from (select sum(l_quantity) s from lineitem group by l_partkey)), 6) normalised from lineitem group by 1")
def coupling_normalised(spark, root):
    return rollups.normalised_strength(table(spark, root, "lineitem"), "l_partkey", F.col("l_quantity"))


@query("select 'hour' as unit, hour(ts)::bigint bucket, count(*) n from events group by 2 union all select 'weekday', dayofweek(ts)::bigint, count(*) from events group by 2")
def hour_weekday_histogram(spark, root):
    e = table(spark, root, "events")
    unit = F.explode(F.array(F.struct(F.lit("hour").alias("unit"), F.hour("ts").cast("long").alias("bucket")), F.struct(F.lit("weekday").alias("unit"), (F.dayofweek("ts") - 1).cast("long").alias("bucket"))))
    return e.select(unit.alias("u")).groupBy("u.unit", "u.bucket").agg(F.count(F.lit(1)).alias("n"))


@query("select coalesce(round(least(0.9, max(n) / avg(n) / 10), 6), 0.0) peakiness from (select count(*) n from events group by hour(ts))")
def hour_peakiness(spark, root):
    return rollups.peakiness(table(spark, root, "events").select(F.hour("ts").alias("h")), "h")


@query("select user_id, count(*) n from events group by 1 having count(*) >= 60 order by n desc, user_id")
def hot_spots(spark, root):
    return table(spark, root, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 60").orderBy(F.desc("n"), "user_id")


@query("select user_id, event_type as main_type, n from (select user_id, event_type, count(*) n, row_number() over (partition by user_id order by count(*) desc, event_type) r from events group by 1, 2) where r = 1")
def main_type_per_user(spark, root):
    n = table(spark, root, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), "event_type"))
    return n.groupBy("user_id").agg(best.alias("b")).select("user_id", F.col("b.event_type").alias("main_type"), (-F.col("b.m")).alias("n"))


@query("""with t(topic, word) as (values ('storage', 'checkpoint'), ('storage', 'snapshot'), ('review', 'review'), ('speed', 'slower'), ('speed', ' ms'), ('session', 'session'), ('failure', 'failed'), ('failure', 'error'))
select topic, count(*) n from (select distinct doc_id, topic from documents join t on contains(lower(text), word)) group by 1 order by n desc, topic limit 5""")
def topic_counts(spark, root):
    words = {"storage": ["checkpoint", "snapshot"], "review": ["review"], "speed": ["slower", " ms"], "session": ["session"], "failure": ["failed", "error"]}
    hits = [F.when(F.lower("text").rlike("|".join(w)), F.lit(t)) for t, w in words.items()]
    n = table(spark, root, "documents").select("doc_id", F.explode(F.array_compact(F.array(*hits))).alias("topic")).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), "topic").limit(5)


@query("select lower(coalesce(lang, 'unknown')) lang, count(*) n, round(avg(length(text)), 6) mean_chars, round(count(*) / (select count(*) from documents), 6) share from documents group by 1")
def language_stats(spark, root):
    d = table(spark, root, "documents").select(F.lower(F.coalesce("lang", F.lit("unknown"))).alias("lang"), F.length("text").alias("c"))
    total = d.agg(F.count(F.lit(1)).alias("total"))
    per = d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c"), 6).alias("mean_chars"))
    return per.join(F.broadcast(total)).select("lang", "n", "mean_chars", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("with m as (select distinct * from ai_session_metrics) select session_id, count(*) n_runs, sum(files_changed)::bigint files_changed, sum(lines_added - lines_deleted)::bigint net_lines, sum(case when ended_at is null then 1 else 0 end)::bigint n_open, round(coalesce(avg(case when duration_seconds >= 0 then duration_seconds end), 0), 6) mean_seconds, round(coalesce(sum(rollbacks) / nullif(sum(checkpoints_created), 0), 0), 6) rollback_rate from m group by 1")
def session_activity(spark, root):
    m = table(spark, root, "ai_session_metrics").dropDuplicates()
    seconds = F.coalesce(F.avg(F.when(F.col("duration_seconds") >= 0, F.col("duration_seconds"))), F.lit(0.0))
    return m.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_runs"), F.sum("files_changed").alias("files_changed"), F.sum(F.col("lines_added") - F.col("lines_deleted")).alias("net_lines"), F.sum(F.when(F.col("ended_at").isNull(), 1).otherwise(0)).alias("n_open"), F.round(seconds, 6).alias("mean_seconds"), F.round(F.coalesce(F.try_divide(F.sum("rollbacks"), F.sum("checkpoints_created")), F.lit(0.0)), 6).alias("rollback_rate"))


@query("select user_id, count(*) n, count(distinct event_type) n_types, round(sum(value), 4) total, round(avg(value), 6) mean, round(least(avg(value) / 10, 1), 6) as capped from events group by 1")
def user_rollup(spark, root):
    return table(spark, root, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_type").alias("n_types"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.least(F.avg("value") / 10, F.lit(1.0)), 6).alias("capped"))


@query(f"with {_CP} select id, created_at from cp order by created_at desc nulls last, id limit 100")
def newest_checkpoints(spark, root):
    return keep_newest(checkpoints_once(spark, root).select("id", "created_at"), [F.desc_nulls_last("created_at"), F.asc("id")], 100)


@query("select session_id, id, created_at from (select *, row_number() over (partition by session_id order by created_at desc, id) r from (select distinct session_id, id, created_at from branches)) where r <= 3")
def newest_branches_per_session(spark, root):
    from pyspark.sql import Window

    b = table(spark, root, "branches").select("session_id", "id", "created_at").distinct()
    # Spark keeps the best rows of each group before the shuffle when a rank is compared with a constant.
    return b.withColumn("r", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("created_at"), "id"))).where("r <= 3").drop("r")


@query(f"with {_CP}, dead as (select distinct id from checkpoints where coalesce(metadata['deleted_at'], '') <> '') select count(*) n_live, sum(coalesce(size_bytes, 0))::bigint live_bytes from cp where id not in (select id from dead)")
def cascade_delete(spark, root):
    dead = table(spark, root, "checkpoints").where(F.coalesce(F.element_at("metadata", "deleted_at"), F.lit("")) != "")
    return surviving(checkpoints_once(spark, root), "id", dead, "id").agg(F.count(F.lit(1)).alias("n_live"), F.coalesce(F.sum(F.coalesce("size_bytes", F.lit(0))), F.lit(0)).alias("live_bytes"))


@query(f"with {_CP}, k as (select lower(trim(session_id)) session_id, created_at, size_bytes from cp where trim(coalesce(session_id, '')) <> '' and created_at >= timestamp '2025-03-01') select session_id, count(*) n, sum(coalesce(size_bytes, 0))::bigint total_size from k group by 1")
def retention_recount(spark, root):
    k = checkpoints_once(spark, root).where(F.col("created_at") >= F.lit("2025-03-01").cast("timestamp_ntz")).withColumn("session_id", normal_key(F.col("session_id"))).where("session_id is not null")
    return k.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("size_bytes", F.lit(0))).alias("total_size"))
