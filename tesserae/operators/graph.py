"""Graphs as edge lists: degrees, neighbours, reachability, paths, strong components, flows.

Traversals are loops of joins over all start nodes at once. A round joins the frontier with the edges and
drops what was seen; every few rounds the frontier is checkpointed, so lineage stays short and a lost
executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.runtime import materialize


def valid_edges(edges: DataFrame, nodes: DataFrame, node: str, src: str, dst: str) -> DataFrame:
    """Edges whose ends both are nodes; parallel edges stay."""
    n = nodes.select(F.col(node).alias("_n")).distinct()
    return edges.join(n, F.col(src) == F.col("_n"), "left_semi").join(n, F.col(dst) == F.col("_n"), "left_semi")


def degrees(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """``node, n_out, n_in, n_neighbours, centrality``: parallel edges count in degrees, once among neighbours."""
    ends = edges.select(F.explode(F.array(F.struct(F.col(src).alias("node"), F.col(dst).alias("other"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col(dst).alias("node"), F.col(src).alias("other"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    pairs = ends.groupBy("node", "other").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))  # first per pair: a hub's edges combine before they meet
    d = pairs.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"), F.count(F.lit(1)).alias("n_neighbours"))
    return d.withColumn("centrality", F.round(F.least(F.lit(1.0), (F.col("n_out") + F.col("n_in")) / 100), 6))


def statistics(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """One row: nodes, edges and edges per node."""
    n = edges.select(F.explode(F.array(src, dst)).alias("n")).distinct().agg(F.count(F.lit(1)).alias("n_nodes"))
    m = edges.agg(F.count(F.lit(1)).alias("n_edges"))
    return n.join(F.broadcast(m)).select("n_nodes", "n_edges", F.round(F.coalesce(F.try_divide("n_edges", "n_nodes"), F.lit(0.0)), 6).alias("mean_degree"))


def reachable(edges: DataFrame, starts: DataFrame, src: str, dst: str, max_depth: int | None = None) -> DataFrame:
    """``start, node, depth``: all nodes within ``max_depth`` edges of each start, itself included, by least depth; without a limit all there are."""
    e = edges.select(F.col(src).alias("_s"), F.col(dst).alias("_d")).distinct()
    frontier = starts.toDF("start").where("start is not null").distinct().select("start", F.col("start").alias("node"), F.lit(0).alias("depth"))
    seen = materialize(frontier)
    frontier, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.join(e, frontier.node == e._s).select("start", F.col("_d").alias("node")).distinct()
        frontier = materialize(step.join(seen, ["start", "node"], "left_anti").select("start", "node", F.lit(depth).alias("depth")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if depth % 8 == 0:
            seen = materialize(seen)
    return seen


def _forced_steps(e: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """``_at, _up`` for 1, 2, 4, ... steps along nodes with one way on, as far as there are any; the nodes whose forced way never ends."""
    step = materialize(e.groupBy("_s").agg(F.count(F.lit(1)).alias("_m"), F.min("_d").alias("_up")).where("_m = 1").select(F.col("_s").alias("_at"), "_up"))
    most, out = step.count(), []
    while 2 ** len(out) <= most and not step.isEmpty():
        out.append(step)
        step = materialize(step.withColumnRenamed("_up", "_m").join(step.withColumnRenamed("_at", "_m"), "_m").select("_at", "_up"))
    return out, step.select("_at")


def _forced_paths(e: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``a, b, path`` where the nodes from ``a`` up to ``b`` have one way on each; ``a, b`` of the pairs that may have another path.

    Steps of powers of two give each node's depth below the end of its forced way, from that the one number of steps
    after which ``b`` can be met, and last the nodes between: rounds grow with the logarithm of the longest way.
    """
    steps, endless = _forced_steps(e)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("_end")).distinct().select("_end", F.col("_end").alias("_at"), F.lit(0).alias("_depth"))
    for k in reversed(range(len(steps))):
        ends = ends.join(steps[k], "_at", "left").select("_end", F.coalesce("_up", "_at").alias("_at"), (F.col("_depth") + F.when(F.col("_up").isNull(), 0).otherwise(2**k)).alias("_depth"))
    ends = materialize(ends)
    side = lambda x: ends.select(F.col("_end").alias(x), F.col("_at").alias(f"_root_{x}"), F.col("_depth").alias(f"_depth_{x}"))
    met = materialize(pairs.join(side("a"), "a").join(side("b"), "b"))
    walk = met.where("_root_a = _root_b and _depth_a > _depth_b").join(endless.withColumnRenamed("_at", "a"), "a", "left_anti")
    walk = walk.select("a", "b", (F.col("_depth_a") - F.col("_depth_b")).alias("_n"), F.col("a").alias("_at"), F.lit(0).alias("_pos"), F.expr("filter(array(struct(0 as k, 0 as pos, a as node)), x -> false)").alias("_runs"))
    for k in reversed(range(len(steps))):
        run, on = F.array(F.struct(F.lit(k).alias("k"), F.col("_pos").alias("pos"), F.col("_at").alias("node"))), F.col("_n").bitwiseAND(2**k) > 0
        walk = walk.join(steps[k], "_at", "left").select("a", "b", "_n", F.when(on, F.col("_up")).otherwise(F.col("_at")).alias("_at"), F.when(on, F.col("_pos") + 2**k).otherwise(F.col("_pos")).alias("_pos"), F.when(on, F.concat("_runs", run)).otherwise(F.col("_runs")).alias("_runs"))
    walk = materialize(walk.where("_at = b").select("a", "b", "_runs"))
    runs, nodes = walk.select("a", "b", F.explode("_runs").alias("r")).select("a", "b", "r.*"), None
    for k in reversed(range(len(steps))):
        own = runs.where(F.col("k") == k).select("a", "b", "pos", "node")
        if nodes is not None:
            halves = F.explode(F.array(F.struct("pos", "node"), F.struct((F.col("pos") + 2**k).alias("pos"), F.col("_up").alias("node")))).alias("r")
            own = own.unionByName(nodes.join(steps[k], F.col("node") == F.col("_at")).select("a", "b", halves).select("a", "b", "r.*"))
        nodes = own
    paths = pairs.select("a", "b", F.array("a").alias("path")).limit(0)
    if nodes is not None:
        paths = nodes.groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("pos", "node"))).alias("_p")).select("a", "b", F.concat(F.transform("_p", lambda x: x["node"]), F.array("b")).alias("path"))
    # Where a forced way ends for good, there is no other path; it goes on where ways part, and in a circle.
    rest = met.join(e.select(F.col("_s").alias("_root_a")).distinct(), "_root_a", "left_semi").join(walk.select("a", "b"), ["a", "b"], "left_anti")
    return materialize(paths), rest.select("a", "b")


def shortest_paths(edges: DataFrame, src: str, dst: str, pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``a, b, path``: for each pair of nodes a shortest way along the edges as an array; of equally short ones the least.

    Paths over nodes with one way on are put together from steps of powers of two. The other pairs advance a step a
    round; a pair stops when it has arrived, or when every node it reaches was seen. A node is its own way. Pairs
    without a way have no row.
    """
    e = materialize(edges.select(F.col(src).alias("_s"), F.col(dst).alias("_d")).where("_s is not null and _d is not null").distinct())
    pairs = materialize(pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null").distinct())
    forced, rest = _forced_paths(e, pairs.where("a <> b"))
    found = pairs.where("a = b").select("a", "b", F.array("a").alias("path")).unionByName(forced)
    front = materialize(rest.select("a", "b", F.col("a").alias("node"), F.array("a").alias("path")))
    seen, rounds = front.select("a", "b", "node"), 0
    while not front.isEmpty():
        rounds += 1
        step = front.join(e, front.node == e._s).select("a", "b", F.col("_d").alias("node"), F.concat("path", F.array("_d")).alias("path"))
        step = materialize(step.groupBy("a", "b", "node").agg(F.min("path").alias("path")).join(seen, ["a", "b", "node"], "left_anti"))
        arrived = step.where("node = b").select("a", "b", "path")
        found = found.unionByName(arrived)
        front = step.join(arrived.select("a", "b"), ["a", "b"], "left_anti")
        seen = seen.unionByName(step.select("a", "b", "node"))
        if rounds % 8 == 0:
            found, seen = materialize(found), materialize(seen)
    return found.select(F.col("a").alias(a), F.col("b").alias(b), "path")


def simple_paths(edges: DataFrame, src: str, dst: str, length: int) -> DataFrame:
    """``path``: arrays of nodes of all simple paths with exactly ``length`` edges; shorter dead ends vanish."""
    e = edges.select(F.col(src).alias("_s"), F.col(dst).alias("_d")).where("_s is not null and _d is not null").distinct()
    paths = e.where("_s <> _d").select(F.array("_s", "_d").alias("path"))
    for _ in range(length - 1):
        last = F.element_at("path", -1)
        paths = paths.withColumn("_l", last).join(e, F.col("_l") == F.col("_s")).where(~F.array_contains("path", F.col("_d"))).select(F.concat("path", F.array("_d")).alias("path"))
    return paths


def strong_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 60) -> DataFrame:
    """``node, component``: nodes of strong components of more than one node, by the least node of each.

    Each round colours nodes by the least node that reaches them and then walks back inside each colour: what
    the colour's own node reaches backwards is one component and leaves the graph. Loops are ignored.
    """
    e = materialize(edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).where("s <> d").distinct())
    found = None
    for _ in range(max_rounds):
        # Only nodes with edges both ways can lie on a cycle.
        while True:
            both = e.select(F.col("s").alias("n")).distinct().join(e.select(F.col("d").alias("n")).distinct(), "n")
            kept = materialize(e.join(both, F.col("s") == F.col("n"), "left_semi").join(both, F.col("d") == F.col("n"), "left_semi"))
            if kept.count() == e.count():
                break
            e = kept
        if e.isEmpty():
            break
        colour = materialize(e.select(F.col("s").alias("n")).distinct().select("n", F.col("n").alias("c")))
        while True:
            pushed = colour.join(e, colour.n == e.s).select(F.col("d").alias("n"), "c").unionByName(colour).groupBy("n").agg(F.min("c").alias("c"))
            pushed = materialize(pushed)
            if pushed.join(colour.withColumnRenamed("c", "_c"), "n").where("c <> _c").isEmpty():
                break
            colour = pushed
        a, b = colour.select(F.col("n").alias("s"), F.col("c").alias("cs")), colour.select(F.col("n").alias("d"), F.col("c").alias("cd"))
        inner = materialize(e.join(a, "s").join(b, "d").where("cs = cd").select("s", "d", F.col("cs").alias("c")))
        reach = materialize(colour.where("n = c"))
        front = reach
        while True:
            front = materialize(front.join(inner.select("s", F.col("d").alias("n"), "c"), ["n", "c"]).select(F.col("s").alias("n"), "c").distinct().join(reach, ["n", "c"], "left_anti"))
            if front.isEmpty():
                break
            reach = materialize(reach.unionByName(front))
        found = reach if found is None else found.unionByName(reach)
        gone = reach.select("n")
        e = materialize(e.join(gone, F.col("s") == F.col("n"), "left_anti").join(gone, F.col("d") == F.col("n"), "left_anti"))
    else:
        raise RuntimeError(f"strong components did not settle in {max_rounds} rounds")
    if found is None:
        found = edges.select(F.col(src).alias("n"), F.col(src).alias("c")).limit(0)
    size = found.groupBy("c").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    return found.join(size, "c").select(F.col("n").alias("node"), F.col("c").alias("component"))


def ascents(edges: DataFrame, child: str, parent: str) -> list[DataFrame]:
    """``node, up`` for 1, 2, 4, ... steps up: all pairs that so many steps join, as far as there are any.

    Each joins the one before with itself, so their number grows with the logarithm of the longest way. A way
    of as many steps as there are nodes meets one of them twice: a cycle, which is an error.
    """
    e = materialize(edges.select(F.col(child).alias("node"), F.col(parent).alias("up")).where("node is not null and up is not null").distinct())
    n_nodes = e.select(F.explode(F.array("node", "up"))).distinct().count()
    out = []
    while not e.isEmpty():
        if 2 ** len(out) >= n_nodes:
            raise RuntimeError("the way up runs into a cycle")
        out.append(e)
        e = materialize(e.withColumnRenamed("up", "_m").join(e.withColumnRenamed("node", "_m"), "_m").select("node", "up").distinct())
    return out


def inheritance_depth(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """``node, depth``: longest way up from each child, however long; parents that are no children have none.

    Where a way of some length goes up, all shorter ones do, so the depth is put together from the longest
    ascent to the shortest. A cycle is an error.
    """
    steps = ascents(edges, child, parent)
    if not steps:
        return edges.select(F.col(child).alias("node"), F.lit(0).alias("depth")).limit(0)
    at = steps[0].select("node", F.col("node").alias("_at")).distinct().withColumn("depth", F.lit(0))
    for k in reversed(range(len(steps))):
        on = at.join(steps[k].select(F.col("node").alias("_at"), F.col("up").alias("_up")), "_at", "left")
        on = on.select("node", F.coalesce("_up", "_at").alias("_at"), (F.col("depth") + F.when(F.col("_up").isNull(), 0).otherwise(2**k)).alias("depth")).distinct()
        far = on.groupBy("node").agg(F.max("depth").alias("depth"))
        at = materialize(on.join(far, ["node", "depth"], "left_semi").select("node", "_at", "depth"))
    return at.select("node", "depth").distinct()


def def_use(statements: DataFrame, scope: str, position: str, variable: str, is_write: str) -> DataFrame:
    """``scope, variable, used_at, defined_at``: each read with the last write at or before it, null if none.

    Within a statement writes come before reads, so ``x = x + 1`` reads its own definition.
    """
    w = Window.partitionBy(scope, variable).orderBy(position, F.when(F.col(is_write), 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col(is_write), F.col(position)), ignorenulls=True).over(w)
    return statements.withColumn("defined_at", last).where(~F.col(is_write)).select(scope, variable, F.col(position).alias("used_at"), "defined_at")


def basic_blocks(statements: DataFrame, scope: str, position: str, is_leader: str) -> DataFrame:
    """``scope, block, first, last, n``: runs of statements, each begun by a leader."""
    w = Window.partitionBy(scope).orderBy(position)
    b = statements.withColumn("block", F.sum(F.when(F.col(is_leader), 1).otherwise(0)).over(w))
    return b.groupBy(scope, "block").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count(F.lit(1)).alias("n"))
