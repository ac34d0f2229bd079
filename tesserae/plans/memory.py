"""Queries on a store of memories (the documents) and the log of what was done (the events)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.functions import text
from tesserae.operators import history
from tesserae.operators.latest import keep_newest, latest_per_key, surviving
from tesserae.plans.metrics import _CP, checkpoints_once
from tesserae.plans.registry import Registry
from tesserae.sources.tables import table

query = Registry()
QUERIES, SQL = query.queries, query.sql
NOW, BEFORE = "2025-12-31", "2025-09-01"


def _time(t: str):
    return F.lit(t).cast("timestamp_ntz")


def _memories(spark, root):
    """Each document as a memory: importance by length and marked words, age in days, tier by both."""
    d = table(spark, root, "documents").where("text is not null")
    importance = F.least(F.lit(1.0), F.length("text") / 4000 + F.when(F.lower("text").rlike("important|critical|must"), 0.3).otherwise(0.0))
    age = (F.unix_micros(_time(NOW).cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 86.4e9
    m = d.select("doc_id", F.coalesce("source", F.lit("")).alias("category"), "session_id", "created_at", F.round(importance, 6).alias("importance"), F.floor(age).alias("age_days"), F.length("text").alias("size"))
    tier = F.when(F.col("age_days") < 30, "working").when((F.col("age_days") < 120) & (F.col("importance") >= 0.5), "short_term").when(F.col("importance") >= 0.8, "long_term").when(F.col("age_days") < 365, "episodic").otherwise("archive")
    return m.withColumn("tier", tier)


_ME = f"""me as (select *, case when age_days < 30 then 'working' when age_days < 120 and importance >= 0.5 then 'short_term' when importance >= 0.8 then 'long_term' when age_days < 365 then 'episodic' else 'archive' end tier from
(select doc_id, coalesce(source, '') category, session_id, created_at, round(least(1.0, length(text) / 4000 + case when regexp_matches(lower(text), 'important|critical|must') then 0.3 else 0 end), 6)::double importance, floor((epoch_us(timestamp '{NOW}') - epoch_us(created_at)) / 86400000000.0)::bigint age_days, length(text) size from documents where text is not null))"""


@query(f"with {_ME} select category, count(*) n, count(distinct session_id) n_sessions, sum(size)::bigint n_chars, sum(importance::decimal(18, 6))::double total_importance from me group by 1")
def memory_stats(spark, root):
    return _memories(spark, root).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("session_id").alias("n_sessions"), F.sum("size").alias("n_chars"), F.sum(F.col("importance").cast("decimal(18,6)")).cast("double").alias("total_importance"))


@query(f"with {_ME} select tier, count(*) n, sum(importance::decimal(18, 6))::double total_importance, min(age_days) youngest, max(age_days) oldest from me group by 1")
def tier_distribution(spark, root):
    """Memories per tier after the tier rules have run."""
    return _memories(spark, root).groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("importance").cast("decimal(18,6)")).cast("double").alias("total_importance"), F.min("age_days").alias("youngest"), F.max("age_days").alias("oldest"))


@query(f"with {_ME} select session_id, count(*) n_turns, min(created_at) first_at, max(created_at) last_at, sum(size)::bigint n_chars, count(distinct category) n_categories from me where session_id is not null group by 1")
def session_summaries(spark, root):
    return _memories(spark, root).where("session_id is not null").groupBy("session_id").agg(F.count(F.lit(1)).alias("n_turns"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), F.sum("size").alias("n_chars"), F.countDistinct("category").alias("n_categories"))


@query("""with d as (select doc_id, session_id, created_at, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: length(w) > 3)) w from documents where text is not null and session_id is not null), l as (select *, lag(w) over (partition by session_id order by created_at, doc_id) p from d)
select doc_id, session_id, round(coalesce(len(list_intersect(w, p)) / nullif(len(list_distinct(list_concat(w, p))), 0), 0), 6)::double overlap from l where p is not null and coalesce(len(list_intersect(w, p)) / nullif(len(list_distinct(list_concat(w, p))), 0), 0) < 0.05""")
def topic_shifts(spark, root):
    """Memories that share hardly a word with the one before them in their session."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) > 3))
    d = table(spark, root, "documents").where("text is not null and session_id is not null").select("doc_id", "session_id", "created_at", words.alias("w"))
    p = history.previous_rows(d, "session_id", ["created_at", "doc_id"], ["w"])
    overlap = text.jaccard("w", "prev_w")
    return p.where("prev_w is not null").where(overlap < 0.05).select("doc_id", "session_id", F.round(overlap, 6).alias("overlap"))


@query(f"with {_ME}, r as (select *, row_number() over (partition by category order by importance desc, doc_id) r from me) select category, doc_id, importance, spent from (select *, sum(size // 4) over (partition by category order by r) spent from r) where spent <= case category when 'assistant_chat' then 3200 when 'readme1' then 2000 when 'wiki_page1' then 1200 else 800 end")
def context_by_shares(spark, root):
    """The most important memories of each category within its share of 8000 tokens: 40, 25, 15 and 10 percent."""
    rank = Window.partitionBy("category").orderBy(F.desc("importance"), "doc_id")
    best = _memories(spark, root).withColumn("r", F.row_number().over(rank))
    spent = F.sum(F.expr("size div 4")).over(Window.partitionBy("category").orderBy("r"))
    share = F.when(F.col("category") == "assistant_chat", 3200).when(F.col("category") == "readme1", 2000).when(F.col("category") == "wiki_page1", 1200).otherwise(800)
    return best.withColumn("spent", spent).where(F.col("spent") <= share).select("category", "doc_id", "importance", "spent")


@query("select doc_id, session_id, source from documents where contains(lower(text), 'checkpoint') and created_at >= timestamp '2025-03-01' and created_at < timestamp '2025-09-01' and lower(lang) = 'en' order by created_at desc, doc_id limit 100")
def backlog_search(spark, root):
    """The newest memories of a time, a language and a word, over all sessions."""
    d = table(spark, root, "documents").where(F.lower("text").contains("checkpoint") & (F.col("created_at") >= _time("2025-03-01")) & (F.col("created_at") < _time(BEFORE)) & (F.lower("lang") == "en"))
    return keep_newest(d.select("doc_id", "session_id", "source", "created_at"), [F.desc("created_at"), F.asc("doc_id")], 100).drop("created_at")


@query(f"with {_ME} select doc_id, age_days, importance from me where age_days >= round(3 + 60 * importance) order by importance desc, age_days desc, doc_id limit 50")
def reviews_due(spark, root):
    """Memories older than the interval that their importance gives, the most important first."""
    m = _memories(spark, root).where(F.col("age_days") >= F.round(3 + 60 * F.col("importance")))
    return keep_newest(m.select("doc_id", "age_days", "importance"), [F.desc("importance"), F.desc("age_days"), F.asc("doc_id")], 50)


@query(f"with {_ME} select doc_id, round(least(1.0, importance + 0.1), 6)::double importance, case when tier = 'archive' then 'long_term' else tier end as tier from me where doc_id % 3 = 0 and doc_id % 5 <> 0 union all select doc_id, importance, tier from me where doc_id % 3 <> 0 and doc_id % 5 <> 0")
def batch_changes(spark, root):
    """The store after one batch that deletes, one that boosts and one that moves memories, each a table of ids."""
    m = _memories(spark, root)
    ids = m.select("doc_id")
    boosts = ids.where("doc_id % 3 = 0").withColumn("delta", F.lit(0.1))
    kept = surviving(m, "doc_id", ids.where("doc_id % 5 = 0"), "doc_id").join(boosts, "doc_id", "left")
    moved = F.col("delta").isNotNull() & (F.col("tier") == "archive")
    return kept.select("doc_id", F.round(F.least(F.lit(1.0), F.col("importance") + F.coalesce("delta", F.lit(0.0))), 6).alias("importance"), F.when(moved, "long_term").otherwise(F.col("tier")).alias("tier"))


@query(f"with {_ME}, a as (select doc_id, size from me where created_at < timestamp '2025-05-01'), b as (select doc_id, size from me where created_at < timestamp '{BEFORE}' and doc_id % 11 <> 0) select case when a.doc_id is null then 'added' when b.doc_id is null then 'removed' else 'kept' end as change, count(*) n from a full join b using (doc_id) group by 1")
def snapshot_changes(spark, root):
    """What a snapshot of the store holds against an earlier one, to which a rollback would return."""
    m = _memories(spark, root)
    a = m.where(F.col("created_at") < _time("2025-05-01")).select("doc_id", F.lit(1).alias("a"))
    b = m.where((F.col("created_at") < _time(BEFORE)) & F.expr("doc_id % 11 <> 0")).select("doc_id", F.lit(1).alias("b"))
    return a.join(b, "doc_id", "full_outer").groupBy(F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("kept").alias("change")).agg(F.count(F.lit(1)).alias("n"))


@query("select user_id, sum(case when event_type = 'error' then -value else value end)::double state, count(*) n from (select user_id, event_type, round(value, 4)::decimal(18, 4) value from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-20') group by 1")
def replayed_state(spark, root):
    """State of each target after the log's entries of a time, errors counting against it."""
    e = table(spark, root, "events").where((F.col("ts") >= _time("2024-01-05")) & (F.col("ts") < _time("2024-01-20"))).withColumn("v", F.round("value", 4).cast("decimal(18,4)"))
    return e.groupBy("user_id").agg(F.sum(F.when(F.col("event_type") == "error", -F.col("v")).otherwise(F.col("v"))).cast("double").alias("state"), F.count(F.lit(1)).alias("n"))


@query("select user_id, arg_max(event_id, (ts, event_id)) event_id, arg_max(event_type, (ts, event_id)) undone_type from events where event_type in ('signup', 'purchase', 'click') group by 1")
def undoable_operations(spark, root):
    """The last operation of each target that can be taken back."""
    e = table(spark, root, "events").where(F.col("event_type").isin("signup", "purchase", "click"))
    return latest_per_key(e, ["user_id"], ["ts", "event_id"], ["event_id", "event_type"]).withColumnRenamed("event_type", "undone_type")


@query("with u as (select user_id, max((ts, event_id)) m from events where event_type in ('signup', 'purchase', 'click') group by 1) select e.user_id, count(*) n, round(sum(value), 4) total from events e left join u on u.user_id = e.user_id where u.m is null or (e.ts, e.event_id) <> u.m group by 1")
def state_after_undo(spark, root):
    """Totals of each target without its last operation that can be taken back."""
    last = undoable_operations(spark, root).select(F.col("event_id"))
    return surviving(table(spark, root, "events"), "event_id", last, "event_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("select event_id, ts, user_id from events where event_type = 'error' order by ts desc, event_id desc limit 100")
def audit_log(spark, root):
    e = table(spark, root, "events").where("event_type = 'error'").select("event_id", "ts", "user_id")
    return keep_newest(e, [F.desc("ts"), F.desc("event_id")], 100)


@query("select event_type as strategy, count(*) n, round(avg(case when value > 50 then 1.0 else 0.0 end), 6) effectiveness, round(avg(value), 6) mean_value from events group by 1")
def approach_outcomes(spark, root):
    """How often each approach met its goal, for suggestions and for what heals."""
    return table(spark, root, "events").groupBy(F.col("event_type").alias("strategy")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("value") > 50, 1.0).otherwise(0.0)), 6).alias("effectiveness"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("select event_type as setting, arg_max(props, (ts, event_id)) as setting_value from events where ts < timestamp '2024-01-20' group by 1")
def settings_as_of(spark, root):
    """Value of each setting at a time: the last that was written before."""
    e = table(spark, root, "events").where(F.col("ts") < _time("2024-01-20"))
    return latest_per_key(e, ["event_type"], ["ts", "event_id"], ["props"]).select(F.col("event_type").alias("setting"), F.col("props").alias("setting_value"))


@query("with t as (select distinct id, lower(u.tag) tag from checkpoints, unnest(tags) u(tag)), g as (select id, tag from t where not (tag in (select tag from t group by 1 having count(*) < 3))) select tag as collection, count(*) n_members, min(id) first_member from g group by 1")
def tag_collections(spark, root):
    """Collections by tag after the rare tags were taken off."""
    t = table(spark, root, "checkpoints").select("id", F.explode("tags").alias("tag")).select("id", F.lower("tag").alias("tag")).distinct()
    rare = t.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).where("n < 3")
    return surviving(t, "tag", rare, "tag").groupBy(F.col("tag").alias("collection")).agg(F.count(F.lit(1)).alias("n_members"), F.min("id").alias("first_member"))


@query("with s as (select distinct lower(trim(id)) id from sessions) select count(*) n_orphans, count(distinct lower(trim(session_id))) n_keys from documents where session_id is not null and lower(trim(session_id)) not in (select id from s where id is not null)")
def orphaned_memories(spark, root):
    """Memories of sessions that do not exist."""
    s = table(spark, root, "sessions").select(F.lower(F.trim("id")).alias("k"))
    d = table(spark, root, "documents").where("session_id is not null").select("doc_id", F.lower(F.trim("session_id")).alias("k"))
    return surviving(d, "k", s, "k").agg(F.count(F.lit(1)).alias("n_orphans"), F.countDistinct("k").alias("n_keys"))


@query(f"with {_ME} select round(0.4 * avg(case when age_days < 365 then 1.0 else 0.0 end) + 0.3 * avg(importance) + 0.3 * count(distinct session_id) / greatest(1, count(*)), 6)::double health, sum(case when importance < 0.05 then 1 else 0 end)::bigint n_weak, case when avg(importance) < 0.3 then 'raise importance' else 'keep' end as advice from me")
def store_health(spark, root):
    """One weighted score of freshness, importance and spread, and what follows from it."""
    mean = F.avg("importance")
    score = 0.4 * F.avg(F.when(F.col("age_days") < 365, 1.0).otherwise(0.0)) + 0.3 * mean + 0.3 * F.countDistinct("session_id") / F.greatest(F.lit(1), F.count(F.lit(1)))
    return _memories(spark, root).agg(F.round(score, 6).alias("health"), F.sum(F.when(F.col("importance") < 0.05, 1).otherwise(0)).alias("n_weak"), F.when(mean < 0.3, "raise importance").otherwise("keep").alias("advice"))


@query("select strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as hour, event_type, count(*) n, round(avg(value), 6) mean_value from events where ts >= (select max(ts) from events) - interval 48 hour group by 1, 2")
def metrics_trend(spark, root):
    """Hourly metrics of the last two days of the log."""
    e = table(spark, root, "events")
    newest = e.agg(F.max("ts").alias("m"))  # one row
    recent = e.join(F.broadcast(newest)).where(F.col("ts") >= F.col("m") - F.expr("INTERVAL 48 HOURS"))
    return recent.groupBy(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("select count(*) n, count(distinct doc_id) n_ids, sum(length(text))::bigint n_chars from documents where text is not null")
def exported_and_imported(spark, root):
    """What comes back from a store written as JSON and read again."""
    d = table(spark, root, "documents").where("text is not null").select("doc_id", "text")
    back = d.select(F.to_json(F.struct("doc_id", "text")).alias("j")).select(F.from_json("j", "doc_id long, text string").alias("r")).select("r.*")
    return back.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_ids"), F.sum(F.length("text")).alias("n_chars"))


@query("select r_name as start, s_suppkey as node, round(0.5 * 1.0 * 0.5 / 1, 6)::double activation from region join nation on n_regionkey = r_regionkey join supplier on s_nationkey = n_nationkey union all select r_name, n_nationkey, 0.5 from region join nation on n_regionkey = r_regionkey")
def spread_activation(spark, root):
    """Activation that reaches the nodes two steps from each region, halved at every step."""
    r, n, s = table(spark, root, "region"), table(spark, root, "nation"), table(spark, root, "supplier")
    one = r.join(n, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("start"), "n_nationkey", F.lit(0.5).alias("activation"))
    two = one.join(s, F.col("s_nationkey") == F.col("n_nationkey")).select("start", F.col("s_suppkey").alias("node"), (F.col("activation") * 0.5).alias("activation"))
    return two.unionByName(one.select("start", F.col("n_nationkey").alias("node"), "activation"))


@query(f"with {_CP}, p as (select c.id source_id, c.parent_checkpoint_id target_id, c.created_at - q.created_at gap from cp c join cp q on q.id = c.parent_checkpoint_id) select source_id, target_id, round(1 / (1 + abs(epoch(gap)) / 86400.0), 6)::double strength from p where gap is not null")
def associations(spark, root):
    """Links between checkpoints and their parents, the stronger the closer in time."""
    c = checkpoints_once(spark, root).select("id", "parent_checkpoint_id", "created_at")
    q = c.select(F.col("id").alias("target_id"), F.col("created_at").alias("then"))
    days = F.abs(F.unix_micros(F.col("created_at").cast("timestamp")) - F.unix_micros(F.col("then").cast("timestamp"))) / 86.4e9
    return c.join(q, F.col("parent_checkpoint_id") == F.col("target_id")).where("created_at is not null and then is not null").select(F.col("id").alias("source_id"), "target_id", F.round(1 / (1 + days), 6).alias("strength"))
