"""Queries on relevance, selection under a budget, search, sets and clones."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import clones, ranking
from tesserae.operators.latest import latest_per_key
from tesserae.plans.metrics import _CP, _FC, changes_once, checkpoints_once, contents_once
from tesserae.plans.registry import Registry
from tesserae.sources.tables import table

query = Registry()
QUERIES, SQL = query.queries, query.sql
WORDS = ["checkpoint", "session", "restored", "queue"]


def _docs(spark, root):
    return table(spark, root, "documents").where("text is not null")


def _scored(spark, root):
    t = F.lower("text")
    hits = sum([F.when(t.contains(w), 1).otherwise(0) for w in WORDS], F.lit(0)) / len(WORDS)
    return _docs(spark, root).select("doc_id", F.coalesce("source", F.lit("none")).alias("source"), F.round(0.6 * hits + 0.4 * F.least(F.lit(1.0), F.length("text") / 4000), 6).alias("score"), F.ceil(F.length("text") / 4).alias("cost"))


_S = "sc as (select doc_id, coalesce(source, 'none') source, round(0.6 * (" + " + ".join(f"case when contains(lower(text), '{w}') then 1 else 0 end" for w in WORDS) + f") / {len(WORDS)} + 0.4 * least(1.0, length(text) / 4000), 6) score, cast(ceil(length(text) / 4) as bigint) as cost from documents where text is not null)"


@query(f"with {_S} select doc_id, source, score, cost from sc order by score desc, doc_id limit 20")
def top_documents(spark, root):
    return _scored(spark, root).orderBy(F.desc("score"), "doc_id").limit(20)


@query(f"with {_S} select doc_id, source, round(score / cost, 9) density from sc where cost > 0")
def value_density(spark, root):
    return _scored(spark, root).where("cost > 0").select("doc_id", "source", F.round(F.col("score") / F.col("cost"), 9).alias("density"))


@query(f"""with recursive {_S}, o as (select *, row_number() over (partition by source order by score desc, doc_id) r from sc), f(source, r, doc_id, used, taken, bef) as (
select source, r, doc_id, case when cost <= 3000 then cost else 0 end, cost <= 3000, 0::bigint from o where r = 1
union all select o.source, o.r, o.doc_id, case when f.used + o.cost <= 3000 then f.used + o.cost else f.used end, f.used + o.cost <= 3000, f.used from f join o on o.source = f.source and o.r = f.r + 1)
select source, doc_id, bef as taken_before from f where taken""")
def budget_selection(spark, root):
    return ranking.fill_budget(_scored(spark, root), "source", "score", "cost", "doc_id", 3000).select("source", "doc_id", "taken_before")


@query(f"with {_S} select source, doc_id, spent from (select *, (sum(cost) over (partition by source order by score desc, doc_id rows between unbounded preceding and current row))::bigint spent from sc where score > 0.1) where spent <= 3000")
def expansion_within_budget(spark, root):
    return ranking.expand_within(_scored(spark, root), "source", "score", "cost", "doc_id", 0.1, 3000).select("source", "doc_id", "spent")


@query()
def diverse_selection(spark, root):
    d = _docs(spark, root).select("doc_id", F.coalesce("source", F.lit("none")).alias("source"), F.length("text").alias("score"), F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z]{4,})"), 1)).alias("items"))
    return ranking.diverse(d, "source", "score", "doc_id", "items", 5, 0.7).select("source", "doc_id")


@query("select source, round((" + " + ".join(f"max(case when contains(text, '{w}') then 1.0 else 0.0 end)" for w in WORDS) + f") / {len(WORDS)}, 6) coverage from documents where text is not null group by 1")
def word_coverage(spark, root):
    return ranking.coverage(_docs(spark, root), "source", "text", WORDS)


@query("select source, round((count(distinct lang) / least(count(*), 4) + count(distinct session_id) / count(*)) / 2, 6) diversity from documents group by 1")
def source_diversity(spark, root):
    return ranking.diversity(table(spark, root, "documents"), "source", {"lang": 4, "session_id": 0})


@query("select doc_id, lower(trim(text)) as norm from (select *, row_number() over (partition by lower(trim(text)) order by doc_id) r from documents where text is not null) where r = 1")
def first_of_equal_texts(spark, root):
    d = _docs(spark, root).select("doc_id", "text")
    return ranking.first_wins(d, [F.lower(F.trim("text"))], "doc_id").select("doc_id", F.lower(F.trim("text")).alias("norm"))


@query("with k as (select distinct substr(p_name, 1, 4) pre from part) select p_name, arg_max(pre, length(pre)) prefix from (select distinct p_name from part where length(p_name) > 0) join k on starts_with(p_name, pre) group by 1")
def longest_prefix_match(spark, root):
    p = table(spark, root, "part")
    keys = p.select(F.substring("p_name", 1, 4).alias("prefix")).distinct().withColumn("v", F.lit(1))
    return ranking.longest_prefix(p, "p_name", keys, "prefix", "v", 4).select("p_name", "prefix")


_TERMS = "w as (select doc_id, regexp_extract_all(lower(text), '([a-z0-9_]+)', 1) w from documents where text is not null), t as (select doc_id, len(w) dl, unnest(w) term from w), ix as (select doc_id, term, count(*) tf, max(dl) dl from t group by 1, 2)"


@query(f"with {_TERMS}, c as (select count(*) n, avg(len(w)) m from w where len(w) > 0), h as (select * from ix where term in ('snapshot', 'journal', 'slower')), q as (select term, count(*) df from h group by 1) select doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / m))), 6) score from h join q using (term), c group by 1")
def bm25_search(spark, root):
    index = ranking.terms(_docs(spark, root), "doc_id", "text")
    n = F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z0-9_]+)"), 1))
    corpus = _docs(spark, root).select(n.alias("n")).where("n > 0").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n").alias("mean_len"))
    return ranking.bm25(index, "doc_id", ["snapshot", "journal", "slower"], corpus)


@query(f"with {_TERMS} select term, count(*) n_docs, sum(tf)::bigint n_uses from ix group by 1 order by n_docs desc, term limit 50")
def top_terms(spark, root):
    ix = ranking.terms(_docs(spark, root), "doc_id", "text")
    return ix.groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("tf").alias("n_uses")).orderBy(F.desc("n_docs"), "term").limit(50)


_TRI = "list_distinct(list_transform(range(1, length({t}) + 2), lambda i: substr('  ' || lower({t}) || ' ', i, 3)))"


@query(f"with x as (select id, {_TRI.format(t='description')} a, {_TRI.format(t=chr(39) + 'Checkpoint before' + chr(39))} b from (select id, max(description) description from checkpoints group by id) where description is not null), s as (select id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) similarity from x) select * from s where similarity >= 0.1")
def trigram_search(spark, root):
    c = table(spark, root, "checkpoints").groupBy("id").agg(F.max("description").alias("description"))
    return ranking.trigram_search(c, "id", "description", "Checkpoint before", 0.1)


@query(f"with {_CP} select id, list_has_any(list_transform(tags, lambda x: lower(x)), ['release', 'auto', 'manual', 'wip']) as hit, len(list_distinct(list_transform(tags, lambda x: lower(x)))) n_tags from (select id, max(tags) tags from checkpoints where tags is not null group by id)")
def tag_overlap(spark, root):
    c = table(spark, root, "checkpoints").where("tags is not null").groupBy("id").agg(F.max("tags").alias("tags"))
    low = F.transform("tags", lambda x: F.lower(x))
    return c.select("id", F.arrays_overlap(low, F.array(*[F.lit(x) for x in ("release", "auto", "manual", "wip")])).alias("hit"), F.size(F.array_distinct(low)).alias("n_tags"))


def _windows(spark, root):
    return clones.line_windows(contents_once(spark, root, hashes=clones.window_hashes("new_content", 6)), "id", "hashes")


_W = f"{_FC}, l as (select id, list_filter(list_transform(regexp_split_to_array(new_content, '\\r?\\n'), lambda x: trim(x, ' ')), lambda x: x <> '' and not starts_with(x, '//') and not starts_with(x, '#')) l from fc where new_content is not null), win as (select id, unnest(list_transform(range(1, len(l) - 4), lambda i: sha256(array_to_string(l[i:i + 5], chr(10))))) h from l where len(l) >= 6)"


@query(f"with {_W} select h, count(*) n_places, count(distinct id) n_files from win group by 1 having count(*) > 1 order by n_places desc, h limit 20")
def top_line_clones(spark, root):
    return clones.exact_clones(_windows(spark, root), "id").orderBy(F.desc("n_places"), "h").limit(20)


@query(f"with {_W}, c as (select h from win group by 1 having count(*) > 1) select id, count(*) n_windows, count(c.h) n_cloned, round(count(c.h) / count(*), 6) as share from win left join c using (h) group by 1")
def duplication(spark, root):
    w = _windows(spark, root)
    return clones.duplication(w, "id", clones.exact_clones(w, "id"))


@query()
def related_checkpoints(spark, root):
    return clones.directory_overlap(changes_once(spark, root), "checkpoint_id", "path", 0.5)


@query(f"with {_FC}, {_CP} select b.id branch_id, count(distinct f.path) n_paths, count(distinct lower(f.content_hash)) n_contents from (select distinct id, head_checkpoint_id from branches) b join fc f on f.checkpoint_id = b.head_checkpoint_id group by 1")
def branch_heads(spark, root):
    b = table(spark, root, "branches").select(F.col("id").alias("branch_id"), F.col("head_checkpoint_id").alias("checkpoint_id")).distinct()
    f = changes_once(spark, root)
    return b.join(f, "checkpoint_id").groupBy("branch_id").agg(F.countDistinct("path").alias("n_paths"), F.countDistinct(F.lower("content_hash")).alias("n_contents"))


@query(f"with {_FC}, o as (select distinct path from fc where modified_at < timestamp '2025-04-01'), n as (select distinct path from fc where modified_at >= timestamp '2025-04-01') select path, 'added' as side from (select path from n except select path from o) union all select path, 'removed' from (select path from o except select path from n)")
def path_set_difference(spark, root):
    c = changes_once(spark, root)
    cut = F.lit("2025-04-01").cast("timestamp_ntz")
    o, n = c.where(F.col("modified_at") < cut).select("path").distinct(), c.where(F.col("modified_at") >= cut).select("path").distinct()
    return n.exceptAll(o).withColumn("side", F.lit("added")).unionByName(o.exceptAll(n).withColumn("side", F.lit("removed")))
