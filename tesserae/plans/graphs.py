"""Queries on graphs: checkpoints and their parents, branches, and flows of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import graph
from tesserae.operators.components import connected_components
from tesserae.plans.metrics import _CP, checkpoints_once
from tesserae.plans.registry import Registry
from tesserae.sources.tables import table

query = Registry()
QUERIES, SQL = query.queries, query.sql


def _parents(spark, root):
    return checkpoints_once(spark, root).select(F.col("id").alias("s"), F.col("parent_checkpoint_id").alias("d")).where("s is not null and d is not null")


_E = f"{_CP}, e as (select id s, parent_checkpoint_id d from cp where id is not null and parent_checkpoint_id is not null)"


def _bipartite(spark, root):
    """Supplier to nation to region, as one graph of names."""
    s = table(spark, root, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("s"), F.concat(F.lit("n"), "s_nationkey").alias("d"))
    n = table(spark, root, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("s"), F.concat(F.lit("r"), "n_regionkey").alias("d"))
    return s.unionByName(n)


_B = "b as (select 's' || s_suppkey s, 'n' || s_nationkey d from supplier union all select 'n' || n_nationkey, 'r' || n_regionkey from nation)"


def _part_links(spark, root):
    """Directed links between users whose events follow each other within the day, for cycles."""
    e = table(spark, root, "events").select("user_id", F.to_date("ts").alias("day"), "event_type").where("event_type = 'purchase'").distinct()
    return e.select(F.col("user_id").alias("s"), ((F.col("user_id") * 7 + F.dayofmonth("day")) % 150).alias("d")).distinct()


_P = "p as (select distinct user_id s, (user_id * 7 + day(cast(ts as date))) % 150 d from events where event_type = 'purchase')"


@query(f"with {_E}, x as (select s n, d o, 1 a, 0 b from e union all select d, s, 0, 1 from e) select n as node, sum(a)::bigint n_out, sum(b)::bigint n_in, count(distinct o) n_neighbours, round(least(1.0, count(*) / 100.0), 6) centrality from x group by 1")
def degree_centrality(spark, root):
    return graph.degrees(_parents(spark, root), "s", "d")


@query(f"with {_E} select (select count(distinct n) from (select s n from e union all select d from e)) n_nodes, (select count(*) from e) n_edges, round((select count(*) from e) / (select count(distinct n) from (select s n from e union all select d from e)), 6) mean_degree")
def graph_statistics(spark, root):
    return graph.statistics(_parents(spark, root), "s", "d")


@query(f"with {_E} select s, d from e where d in (select id from cp)")
def edges_with_both_ends(spark, root):
    return graph.valid_edges(_parents(spark, root), checkpoints_once(spark, root), "id", "s", "d").select("s", "d")


@query(f"with recursive {_E}, r(start, node, depth) as (select distinct s, s, 0 from e union select r.start, e.d, r.depth + 1 from r join e on e.s = r.node where r.depth < 3) select start, node, min(depth) as depth from r group by 1, 2")
def within_three_edges(spark, root):
    p = _parents(spark, root)
    return graph.reachable(p, p.select("s"), "s", "d", 3)


@query(f"with recursive {_B}, r(start, node, depth) as (select distinct s, s, 0 from b union select r.start, b.d, r.depth + 1 from r join b on b.s = r.node) select start, node, min(depth) as depth from r group by 1, 2")
def dependency_closure(spark, root):
    b = _bipartite(spark, root)
    return graph.reachable(b, b.select("s"), "s", "d")


@query(f"with {_B} select x.s as a, y.s as b, y.d as c from b x join b y on y.s = x.d where x.s <> y.s and y.d <> x.s and x.s <> x.d and y.s <> y.d")
def paths_of_two_edges(spark, root):
    p = graph.simple_paths(_bipartite(spark, root), "s", "d", 2)
    return p.distinct().select(F.col("path")[0].alias("a"), F.col("path")[1].alias("b"), F.col("path")[2].alias("c"))


@query(f"""with recursive {_P}, r(a, b) as (select s, d from p where s <> d union select r.a, p.d from r join p on p.s = r.b where p.s <> p.d),
m as (select x.a as node, least(x.a, min(x.b)) as component from r x join r y on y.a = x.b and y.b = x.a group by x.a having max(case when x.b <> x.a then 1 else 0 end) = 1) select node, component from m""")
def strong_components(spark, root):
    return graph.strong_components(_part_links(spark, root), "s", "d")


@query(f"with recursive {_E}, u as (select s a, d b from e union select d, s from e), r(n, m) as (select a, a from u union select r.n, u.b from r join u on u.a = r.m) select n as node, min(m) as component from r group by 1")
def weak_components(spark, root):
    return connected_components(_parents(spark, root), "s", "d")


@query(f"with recursive {_E}, r(n, t, k) as (select s, d, 1 from e union select r.n, e.d, r.k + 1 from r join e on e.s = r.t) select n as node, max(k) as depth from r group by 1")
def inheritance_depth(spark, root):
    return graph.inheritance_depth(_parents(spark, root), "s", "d")


@query(f"with {_P}, x as (select distinct least(s, d) a, greatest(s, d) b from p p1 where s <> d and exists (select 1 from p p2 where p2.s = p1.d and p2.d = p1.s)) select a, b from x")
def mutual_links(spark, root):
    p = _part_links(spark, root).where("s <> d")
    back = p.select(F.col("d").alias("s"), F.col("s").alias("d"))
    return p.join(back, ["s", "d"], "left_semi").where("s < d").select(F.col("s").alias("a"), F.col("d").alias("b"))


@query("""with st as (select user_id, event_id, event_type = 'signup' or event_type = 'purchase' w from events) select user_id, 'state' as variable, event_id as used_at, last_value(case when w then event_id end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row) defined_at from st qualify not w""")
def def_use_chains(spark, root):
    e = table(spark, root, "events").select("user_id", "event_id", F.lit("state").alias("variable"), F.col("event_type").isin("signup", "purchase").alias("w"))
    return graph.def_use(e, "user_id", "event_id", "variable", "w")


@query("with st as (select user_id, event_id, sum(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by event_id) block from events) select user_id, block::bigint block, min(event_id) as first, max(event_id) as last, count(*) n from st group by 1, 2")
def basic_blocks(spark, root):
    e = table(spark, root, "events").withColumn("lead", F.col("event_type") == "error")
    return graph.basic_blocks(e, "user_id", "event_id", "lead")
