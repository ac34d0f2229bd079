"""Queries on versioned state."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import rollups, snapshots
from tesserae.operators.latest import latest_per_key
from tesserae.plans.metrics import _CP, _FC, changes_once, checkpoints_once, contents_once
from tesserae.plans.registry import Registry
from tesserae.sources.tables import table

query = Registry()
QUERIES, SQL = query.queries, query.sql
T0, T1, T2 = "2025-03-01", "2025-05-01", "2025-07-01"


def _state(spark, root, until: str):
    """Last change of each path before a time; deleted paths have none."""
    c = changes_once(spark, root).where("path is not null").where(F.col("modified_at") < F.lit(until).cast("timestamp_ntz"))
    last = latest_per_key(c.withColumn("k", rollups.kind()).withColumn("h", F.lower("content_hash")), ["path"], ["modified_at", "id"], ["h", "k"])
    return last.where("k <> 'deleted'").select("path", "h")


def _state_sql(name: str, until: str) -> str:
    return f"{name} as (select path, h from (select path, lower(content_hash) h, lower(change_type.kind) k, row_number() over (partition by path order by modified_at desc, id desc) r from fc where path is not null and modified_at < timestamp '{until}') where r = 1 and k <> 'deleted')"


@query(f"with {_FC.replace('fc as', 'fc as', 1)}, {_state_sql('b', T1)}, {_state_sql('a', T2)} select coalesce(b.path, a.path) path, case when b.path is null then 'created' when a.path is null then 'deleted' else 'modified' end as change from b full outer join a on a.path = b.path where b.path is null or a.path is null or a.h is distinct from b.h")
def snapshot_diff(spark, root):
    return snapshots.snapshot_diff(_state(spark, root, T1), _state(spark, root, T2), "path", "h")


@query(f"""with {_FC}, {_CP.replace('cp as', 'cp as', 1)}, x as (select f.id, f.path, lower(f.content_hash) h, lower(f.change_type.kind) k, c.parent_checkpoint_id pid from fc f join cp c on c.id = f.checkpoint_id),
p as (select distinct checkpoint_id pid, path, lower(content_hash) h from fc) select distinct x.id, x.path, x.k as kind from x left join p on p.pid = x.pid and p.path = x.path where not (x.k = 'modified' and x.h is not distinct from p.h)""")
def delta_vs_parent(spark, root):
    f = changes_once(spark, root).select("id", "path", F.lower("content_hash").alias("h"), rollups.kind().alias("kind"), "checkpoint_id")
    current = f.join(checkpoints_once(spark, root).select(F.col("id").alias("checkpoint_id"), F.col("parent_checkpoint_id").alias("pid")), "checkpoint_id")
    parent = f.select(F.col("checkpoint_id").alias("pid"), "path", "h")
    return snapshots.delta(current, parent, ["pid", "path"], "h", F.col("kind")).select("id", "path", "kind").distinct()


@query(f"""with {_FC}, {_state_sql('b', T0)}, {_state_sql('s', T1)}, {_state_sql('t', T2)}, k as (select path from b union select path from s union select path from t)
select k.path, case when s.path is not null and t.path is not null and s.h is not distinct from t.h then 'same' when s.path is not null and t.path is not null and b.path is null then 'conflict_both_created' when s.path is not null and t.path is not null then 'conflict_both_modified' when s.path is not null then 'source' when t.path is not null then 'target' else 'base_only' end as outcome,
case when s.path is not null and t.path is not null and s.h is distinct from t.h then b.h else coalesce(s.h, t.h, b.h) end as digest from k left join b on b.path = k.path left join s on s.path = k.path left join t on t.path = k.path""")
def three_way_merge(spark, root):
    return snapshots.three_way_merge(_state(spark, root, T0), _state(spark, root, T1), _state(spark, root, T2), ["path"], "h")


_CHAIN = """ch as (with recursive r(node, ancestor, depth, up, fin) as (select id, id, 0, parent_checkpoint_id, coalesce(is_full_snapshot, false) from cp where id is not null
union all select r.node, c.id, r.depth + 1, c.parent_checkpoint_id, coalesce(c.is_full_snapshot, false) from r join cp c on c.id = r.up where not r.fin) select node, ancestor, depth from r)"""


def _chains(spark, root):
    return snapshots.chains(checkpoints_once(spark, root), "id", "parent_checkpoint_id", "is_full_snapshot")


@query(f"with {_CP}, {_CHAIN} select node, ancestor, depth from ch")
def delta_chains(spark, root):
    return _chains(spark, root)


@query(f"with {_CP}, {_CHAIN} select node as id, max(depth) as chain_length, max(depth) >= 10 as needs_full from ch group by 1")
def full_snapshot_policy(spark, root):
    return _chains(spark, root).groupBy(F.col("node").alias("id")).agg(F.max("depth").alias("chain_length"), (F.max("depth") >= 10).alias("needs_full"))


@query(f"""with {_CP}, {_FC}, {_CHAIN}, j as (select ch.node, f.path, lower(f.content_hash) h, lower(f.change_type.kind) k, row_number() over (partition by ch.node, f.path order by ch.depth, f.modified_at desc nulls last, f.id desc) r from ch join fc f on f.checkpoint_id = ch.ancestor)
select node, path, h from j where r = 1 and k <> 'deleted'""")
def chain_replay(spark, root):
    f = changes_once(spark, root).withColumn("h", F.lower("content_hash"))
    return snapshots.replay(_chains(spark, root), f, "checkpoint_id", "path", ["modified_at", "id"], ["h"], rollups.kind() == "deleted")


@query(f"""with recursive {_CP}, p as (select distinct base_checkpoint_id a, head_checkpoint_id b from branches where base_checkpoint_id is not null and head_checkpoint_id is not null),
r(node, ancestor, depth, up) as (select id, id, 0, parent_checkpoint_id from cp where id in (select a from p union select b from p) union all select r.node, c.id, r.depth + 1, c.parent_checkpoint_id from r join cp c on c.id = r.up),
j as (select p.a, p.b, x.ancestor, x.depth + y.depth d, row_number() over (partition by p.a, p.b order by x.depth + y.depth, x.ancestor) r from p join r x on x.node = p.a join r y on y.node = p.b and y.ancestor = x.ancestor) select a, b, ancestor, d as distance from j where r = 1""")
def common_ancestors(spark, root):
    p = table(spark, root, "branches").select(F.col("base_checkpoint_id").alias("a"), F.col("head_checkpoint_id").alias("b")).where("a is not null and b is not null")
    return snapshots.common_ancestors(checkpoints_once(spark, root), "id", "parent_checkpoint_id", p, "a", "b")


@query(f"with {_CP}, k as (select *, lower(trim(session_id)) s from cp) select s as session_id, branch_id, id, created_at from (select *, row_number() over (partition by s, branch_id order by created_at desc nulls last, id desc) r from k where s <> '') where r = 1")
def latest_per_branch(spark, root):
    k = checkpoints_once(spark, root).withColumn("session_id", F.lower(F.trim("session_id"))).where("session_id <> ''")
    return latest_per_key(k, ["session_id", "branch_id"], ["created_at", "id"], ["id", "created_at"])


@query(f"with {_FC.replace('select * from file_changes', 'select * from file_changes')}, x as (select id, coalesce(new_content, original_content) t, lower(content_hash) h from fc) select id from x where t is not null and sha256(t) is distinct from h")
def hash_mismatches(spark, root):
    text = F.coalesce("new_content", "original_content")
    once = contents_once(spark, root, differs=text.isNotNull() & ~F.sha2(text, 256).eqNullSafe(F.lower("content_hash")))
    return once.where("differs").select("id")


@query(f"with {_FC}, {_state_sql('a', T2)} select a.path from a where a.path not in (select path from fc where path is not null and modified_at < timestamp '{T1}')")
def inventory_anti_join(spark, root):
    old = changes_once(spark, root).where(F.col("modified_at") < F.lit(T1).cast("timestamp_ntz")).select("path").distinct()
    return _state(spark, root, T2).join(old, "path", "left_anti").select("path")


@query(f"with {_FC}, {_state_sql('a', T2)} select f.id, case when a.path is null then 'missing' when a.h is distinct from lower(f.content_hash) then 'changed' else 'clean' end as conflict from fc f left join a on a.path = f.path where f.path is not null and f.modified_at < timestamp '{T1}'")
def restore_conflicts(spark, root):
    now = _state(spark, root, T2).withColumn("present", F.lit(True))
    f = changes_once(spark, root).where("path is not null").where(F.col("modified_at") < F.lit(T1).cast("timestamp_ntz")).select("id", "path", F.lower("content_hash").alias("wanted"))
    j = f.join(now, "path", "left")
    return j.select("id", F.when(F.col("present").isNull(), "missing").when(~F.col("h").eqNullSafe(F.col("wanted")), "changed").otherwise("clean").alias("conflict"))


@query(f"with {_CP}, {_FC} select count(*) n_blobs, coalesce(sum(s), 0)::bigint bytes from (select lower(content_hash) h, max(size_bytes) s from fc group by 1 having lower(content_hash) is not null and max(case when checkpoint_id in (select id from cp) then 1 else 0 end) = 0)")
def orphan_blobs(spark, root):
    """Contents that no known checkpoint refers to."""
    f = changes_once(spark, root).select(F.lower("content_hash").alias("h"), "size_bytes", "checkpoint_id").where("h is not null")
    live = f.join(checkpoints_once(spark, root).select(F.col("id").alias("checkpoint_id")), "checkpoint_id", "left_semi").select("h").distinct()
    return f.groupBy("h").agg(F.max("size_bytes").alias("s")).join(live, "h", "left_anti").agg(F.count(F.lit(1)).alias("n_blobs"), F.coalesce(F.sum("s"), F.lit(0)).alias("bytes"))


@query(f"with {_FC} select lower(content_hash) h, count(*) n_refs from fc where content_hash is not null group by 1")
def reference_counts(spark, root):
    return changes_once(spark, root).where("content_hash is not null").groupBy(F.lower("content_hash").alias("h")).agg(F.count(F.lit(1)).alias("n_refs"))


@query(f"with {_CP}, {_FC} select c.id, c.description, array_to_string(list_sort(list(lpad(f.id::varchar, 20, '0'))), ',') changes, count(*) n from cp c join fc f on f.checkpoint_id = c.id group by 1, 2")
def checkpoint_with_changes(spark, root):
    f = changes_once(spark, root).groupBy("checkpoint_id").agg(F.array_join(F.array_sort(F.collect_list(F.lpad(F.col("id").cast("string"), 20, "0"))), ",").alias("changes"), F.count(F.lit(1)).alias("n"))
    return checkpoints_once(spark, root).select("id", "description").join(f, F.col("id") == F.col("checkpoint_id")).select("id", "description", "changes", "n")
