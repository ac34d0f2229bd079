"""Versioned state: diffs of snapshots, deltas, merges, chains of deltas and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.graph import ascents, inheritance_depth
from tesserae.runtime import materialize


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """``key, change``: created, deleted or modified between two snapshots; equal digests give no row.

    Keys are expected once per snapshot; a null digest differs from every other but another null.
    """
    b = before.select(key, F.col(digest).alias("_b"), F.lit(1).alias("_in_b"))
    a = after.select(key, F.col(digest).alias("_a"), F.lit(1).alias("_in_a"))
    j = b.join(a, key, "full_outer")
    change = F.when(F.col("_in_b").isNull(), "created").when(F.col("_in_a").isNull(), "deleted").when(~F.col("_a").eqNullSafe(F.col("_b")), "modified")
    return j.select(key, change.alias("change")).where("change is not null")


def delta(current: DataFrame, parent: DataFrame, keys: list[str], digest: str, kind: Column) -> DataFrame:
    """Rows of ``current`` but for modifications that leave the parent's digest as it was."""
    p = parent.select(*keys, F.col(digest).alias("_parent")).distinct()
    j = current.join(p, keys, "left")
    return j.where(~((kind == "modified") & F.col(digest).eqNullSafe(F.col("_parent")))).drop("_parent")


def three_way_merge(base: DataFrame, source: DataFrame, target: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """``keys, outcome, digest`` over the union of keys.

    Present on one side only, that side is taken, even where it equals the base; present on both with equal
    digests, either; else a conflict, named by whether the base has the key, with the base's digest.
    """
    part = lambda df, n: df.select(*keys, F.col(digest).alias(f"_{n}"), F.lit(1).alias(f"_in_{n}"))
    j = part(base, "b").join(part(source, "s"), keys, "full_outer").join(part(target, "t"), keys, "full_outer")
    s, t, b = (F.col(f"_in_{n}").isNotNull() for n in "stb")
    same = F.col("_s").eqNullSafe(F.col("_t"))
    outcome = F.when(s & t & same, "same").when(s & t & ~b, "conflict_both_created").when(s & t, "conflict_both_modified").when(s, "source").when(t, "target").otherwise("base_only")
    value = F.when(outcome.startswith("conflict"), F.col("_b")).otherwise(F.coalesce("_s", "_t", "_b"))
    return j.select(*keys, outcome.alias("outcome"), value.alias("digest"))


def chains(nodes: DataFrame, node: str, parent: str, is_end: str) -> DataFrame:
    """``node, ancestor, depth``: each node with itself and its parents up to and with the first that ends a chain.

    A chain stops at an end or at an unknown parent, however long it is. Ways of up to 2**k steps are joined with
    ascents of 2**k steps, so the number of rounds grows with the logarithm of the longest chain; a cycle is an error.
    """
    n = nodes.select(F.col(node).alias("node"), F.col(parent).alias("up"), F.coalesce(F.col(is_end), F.lit(False)).alias("end")).where("node is not null")
    known = n.select(F.col("node").alias("_k"))
    steps = ascents(n.where("not end").join(known, F.col("up") == F.col("_k"), "left_semi"), "node", "up")
    out = n.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth"))
    for k, step in enumerate(steps):
        far = step.withColumnRenamed("node", "_n").join(out, F.col("up") == F.col("node")).select(F.col("_n").alias("node"), "ancestor", (F.col("depth") + 2**k).alias("depth"))
        out = materialize(out.unionByName(far))
    return out


def replay(chain: DataFrame, changes: DataFrame, change_node: str, path: str, order: list[str], value: list[str], deleted: Column) -> DataFrame:
    """State of each node after replaying its chain: for every path the change nearest to the node, unless it deletes."""
    c = changes.select(F.col(change_node).alias("ancestor"), path, *order, *value, deleted.alias("_deleted"))
    j = chain.join(c, "ancestor")
    last = F.max_by(F.struct(*value, "_deleted"), F.struct((-F.col("depth")).alias("_near"), *order))
    return j.groupBy("node", path).agg(last.alias("_last")).where("not _last._deleted").select("node", path, *[F.col("_last")[v].alias(v) for v in value])


def common_ancestors(nodes: DataFrame, node: str, parent: str, pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``a, b, ancestor, distance``: for each pair of nodes the nearest one that both descend from or are, and the steps between them.

    The whole way up counts, through full snapshots and however long; each node is expected once. The deeper
    end is lifted to the other's depth, then both as long as they differ, by ascents of 2**k steps.
    """
    known = nodes.select(F.col(node).alias("_n")).where("_n is not null")
    up = materialize(nodes.select(F.col(node).alias("node"), F.col(parent).alias("up")).where("node is not null").join(known, F.col("up") == F.col("_n"), "left_semi"))
    steps = ascents(up, "node", "up")
    depths = known.join(inheritance_depth(up, "node", "up"), F.col("_n") == F.col("node"), "left").select("_n", F.coalesce("depth", F.lit(0)).alias("_d"))
    ends = pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct()
    ends = ends.join(depths.toDF("a", "_da"), "a").join(depths.toDF("b", "_db"), "b")
    deeper = F.col("_da") >= F.col("_db")
    ends = materialize(ends.select("a", "b", F.when(deeper, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(deeper, F.col("b")).otherwise(F.col("a")).alias("y"), F.abs(F.col("_da") - F.col("_db")).alias("_lift"), F.abs(F.col("_da") - F.col("_db")).alias("distance")))
    for k in reversed(range(len(steps))):
        on = ends.join(steps[k].toDF("x", "_ux"), "x", "left")
        lifted = F.col("_lift") >= 2**k
        ends = materialize(on.select("a", "b", F.when(lifted, F.col("_ux")).otherwise(F.col("x")).alias("x"), "y", F.when(lifted, F.col("_lift") - 2**k).otherwise(F.col("_lift")).alias("_lift"), "distance"))
    for k in reversed(range(len(steps))):
        on = ends.join(steps[k].toDF("x", "_ux"), "x", "left").join(steps[k].toDF("y", "_uy"), "y", "left")
        apart = F.coalesce(F.col("_ux") != F.col("_uy"), F.lit(False))
        ends = materialize(on.select("a", "b", F.when(apart, F.col("_ux")).otherwise(F.col("x")).alias("x"), F.when(apart, F.col("_uy")).otherwise(F.col("y")).alias("y"), (F.col("distance") + F.when(apart, 2 ** (k + 1)).otherwise(0)).alias("distance")))
    same = ends.where("x = y").select("a", "b", F.col("x").alias("ancestor"), "distance")
    one_up = ends.where("x <> y").join(up.toDF("x", "_ux"), "x").join(up.toDF("y", "_uy"), "y").where("_ux = _uy").select("a", "b", F.col("_ux").alias("ancestor"), (F.col("distance") + 2).alias("distance"))
    return same.unionByName(one_up).select(F.col("a").alias(a), F.col("b").alias(b), "ancestor", "distance")
