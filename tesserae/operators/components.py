"""Connected components of an edge list by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.runtime import materialize


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 50) -> DataFrame:
    """``node, component``: each node that has an edge, with the least node of its component.

    Each round links every node's larger neighbours, then its smaller ones and itself, to the least
    neighbour; both steps are plain aggregations and the number of rounds grows with the logarithm of
    the number of nodes. Loops and null ends are ignored; no edges give no rows.
    """
    # Written as (larger, smaller).
    links = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        after = materialize(small)
        if after.exceptAll(links).isEmpty() and links.exceptAll(after).isEmpty():
            break
        links = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
