"""Queries on score arithmetic and cache content."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import scores
from tesserae.operators import caches
from tesserae.plans.metrics import AS_OF, _CP, as_of, checkpoints_once
from tesserae.plans.registry import Registry
from tesserae.sources.tables import table

query = Registry()
QUERIES, SQL = query.queries, query.sql


@query("select doc_id, round(least(1.0, 0.5 + case when contains(lower(text), 'checkpoint') then 0.3 else 0 end + case when contains(text, '`') then 0.1 else 0 end + case when length(text) > 1000 then 0.2 else 0 end), 6)::double score from documents where text is not null")
def boosted_scores(spark, root):
    t = F.col("text")
    s = scores.boosted(0.5, [(F.lower(t).contains("checkpoint"), 0.3), (t.contains("`"), 0.1), (F.length(t) > 1000, 0.2)])
    return table(spark, root, "documents").where("text is not null").select("doc_id", F.round(s, 6).alias("score"))


@query("select doc_id, round((least(1.0, length(text) / 2000.0) + least(1.0, len(regexp_extract_all(text, '\\d+')) / 20.0) + least(1.0, coalesce(n_chars, 0) / 4000.0)) / 3, 6) complexity from documents where text is not null and coalesce(n_chars, 0) >= 0")
def text_complexity(spark, root):
    d = table(spark, root, "documents").where("text is not null and coalesce(n_chars, 0) >= 0")
    return d.select("doc_id", F.round(scores.clipped_mean([F.length("text") / 2000, F.regexp_count("text", F.lit(r"\d+")) / 20, F.col("n_chars") / 4000]), 6).alias("complexity"))


@query("select user_id, round(case when avg(value) = 0 then 0 else greatest(0, 1 - stddev_pop(value) / avg(value)) end, 6) steadiness from events where event_type = 'view' and value is not null group by 1")
def steadiness(spark, root):
    e = table(spark, root, "events").where("event_type = 'view' and value is not null").groupBy("user_id").agg(F.collect_list("value").alias("v"))
    return e.select("user_id", F.round(scores.steadiness(F.col("v")), 6).alias("steadiness"))


@query(f"with {_CP} select id, round(greatest(0.0, 1 - date_diff('day', created_at::date, date '2025-12-31') / 365.0), 6) freshness from cp where created_at is not null")
def linear_freshness(spark, root):
    return checkpoints_once(spark, root).where("created_at is not null").select("id", F.round(scores.linear_freshness(F.datediff(F.lit("2025-12-31"), F.to_date("created_at")), 365.0), 6).alias("freshness"))


@query("with x as (select user_id, event_type, count(*)::double n, avg(value) m from events group by 1, 2) select user_id, event_type, round(case event_type when 'error' then 0.7 * n + 0.3 * m when 'purchase' then 0.2 * n + 0.8 * m else 0.5 * n + 0.5 * m end, 6) score from x")
def profile_scores(spark, root):
    x = table(spark, root, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("value").alias("m"))
    return x.select("user_id", "event_type", F.round(scores.by_profile(x, "event_type", ["n", "m"], {"error": [0.7, 0.3], "purchase": [0.2, 0.8]}, [0.5, 0.5]), 6).alias("score"))


@query()
def query_variants(spark, root):
    """Documents per variant of a few words."""
    words = spark.createDataFrame([("restore",), ("entry",), ("batch",)], "word string").select("word", F.explode(scores.word_variants(F.col("word"))).alias("term"))
    used = table(spark, root, "documents").where("text is not null").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z]+)"), 1))).alias("term"))
    return used.join(words, "term").groupBy("word", "term").agg(F.count(F.lit(1)).alias("n_docs"))


@query("select user_id, max(ts) ts from events group by 1 order by arg_max(ts, (ts, event_id)) desc, arg_max(event_id, (ts, event_id)) desc limit 40")
def cache_content(spark, root):
    return caches.least_recently_used(table(spark, root, "events"), "user_id", "ts", "event_id", 40)


@query(f"select event_type, count(*) n from events where ts > timestamp '{AS_OF}' - interval 48 hour and ts <= timestamp '{AS_OF}' group by 1")
def alive_entries(spark, root):
    e = table(spark, root, "events").where(F.col("ts") <= as_of())
    return caches.alive(e, "ts", as_of(), 48).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("with d as (select distinct source from documents where source is not null), a as (select source, min(doc_id) v from documents where lang = 'de' and source is not null group by 1), b as (select source, min(doc_id) v from documents where lang = 'fr' and source is not null group by 1) select d.source, coalesce(a.v, b.v) v, case when a.v is not null then 1.0 when b.v is not null then 0.7 end::double as confidence from d left join a using (source) left join b using (source)")
def resolution_order(spark, root):
    d = table(spark, root, "documents").where("source is not null")
    of = lambda lang: d.where(F.col("lang") == lang).groupBy("source").agg(F.min("doc_id").alias("v"))
    return caches.resolve_in_order(d, "source", [(of("de"), "exact", 1.0), (of("fr"), "fallback", 0.7)], "v")


@query("select doc_id from documents where text is not null and source is not null and (contains(lower(text), lower(source)) or contains(lower(source), lower(text)))")
def related_names(spark, root):
    return table(spark, root, "documents").where(scores.related(F.col("text"), F.col("source"))).select("doc_id")
