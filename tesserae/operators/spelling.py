"""Names of close spelling: joins by edit distance without loss."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.runtime import materialize, parts

#: Names of one length that a group of the join compares at a time; bounds what a task holds, changes no result.
BLOCK = 1000
#: Longs of 64 bits in which a name's pairs of letters are marked.
LONGS = 4


def _marked(df: DataFrame, name: str, least: float) -> DataFrame:
    """Rows with length ``_n``, the edits ``_k`` that the threshold allows a name of this length, and the pairs of letters as bits ``_0, _1, ...``."""
    pairs = F.when(F.col("_n") > 1, F.transform(F.sequence(F.lit(1), F.col("_n") - 1), lambda i: F.pmod(F.xxhash64(F.substring(name, i, F.lit(2))), F.lit(64 * LONGS)).cast("int"))).otherwise(F.array().cast("array<int>"))
    bits = [F.expr(f"aggregate(_pairs, 0L, (s, h) -> s | if(h div 64 = {j}, shiftleft(1L, h), 0L))").alias(f"_{j}") for j in range(LONGS)]
    edits = F.floor((1 - least) * F.col("_n") + 1e-6).cast("int")
    return df.withColumn("_n", F.length(name)).withColumn("_k", edits).withColumn("_pairs", pairs).select("*", *bits).drop("_pairs")


def candidates(df: DataFrame, group: str, name: str, least: float) -> DataFrame:
    """``a, b, k, m, n``: pairs of different names of a group that may be so similar, of lengths ``m <= n``, with ``k`` edits allowed.

    No similar pair is missing: an edit changes the length by one at most and undoes two pairs of letters at most, so
    names that differ in length by more than ``k``, or of which one has more than ``2 k`` pairs that the other has not,
    are farther apart. Equal lengths of a group meet in blocks, so that its size splits the work.
    """
    m = materialize(_marked(df.select(F.col(group).alias("_g"), F.col(name).alias("_d")).where("_g is not null and _d is not null").distinct(), "_d", least))
    sizes = m.groupBy("_g", F.col("_n").alias("_short")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks"))
    short = m.withColumnRenamed("_n", "_short").join(sizes, ["_g", "_short"]).withColumn("_block", F.pmod(F.xxhash64("_d"), F.col("_blocks")).cast("int"))
    long = m.withColumn("_short", F.explode(F.sequence(F.col("_n") - F.col("_k"), F.col("_n")))).join(sizes, ["_g", "_short"]).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    keys = ["_g", "_short", "_block"]
    short = short.select(*keys, F.col("_d").alias("a"), *[F.col(f"_{j}").alias(f"_a{j}") for j in range(LONGS)])
    long = long.select(*keys, F.col("_d").alias("b"), F.col("_k").alias("k"), F.col("_n").alias("n"), *[F.col(f"_{j}").alias(f"_b{j}") for j in range(LONGS)])
    n_parts = parts(df.sparkSession)
    both = long.repartition(n_parts, *keys).join(short.repartition(n_parts, *keys).hint("merge"), keys)
    only = lambda x, y: " + ".join(f"bit_count(_{x}{j} & ~_{y}{j})" for j in range(LONGS))
    return both.where(f"{only('a', 'b')} <= 2 * k").where(f"{only('b', 'a')} <= 2 * k").where("n > _short or a < b").select("a", "b", "k", F.col("_short").alias("m"), "n")


def _trimmed(df: DataFrame) -> DataFrame:
    """Pairs with ``_x, _y``: the names without most of what both begin with and both end with, which changes no distance."""
    df = df.withColumn("_p", F.lit(0))
    for w in (32, 16, 8, 4):
        df = df.withColumn("_p", F.expr(f"_p + if(substr(a, _p + 1, {w}) = substr(b, _p + 1, {w}), {w}, 0)"))
    df = df.withColumn("_x", F.expr("substr(a, _p + 1)")).withColumn("_y", F.expr("substr(b, _p + 1)")).withColumn("_q", F.lit(0))
    for w in (32, 16, 8, 4):
        end = f"_q + {w}"
        df = df.withColumn("_q", F.expr(f"_q + if(m - _p >= {end} and substr(_x, -({end}), {w}) = substr(_y, -({end}), {w}), {w}, 0)"))
    return df.withColumn("_x", F.expr("substr(_x, 1, m - _p - _q)")).withColumn("_y", F.expr("substr(_y, 1, n - _p - _q)"))


def close_names(df: DataFrame, group: str, name: str, least: float) -> DataFrame:
    """``a, b, similarity``: pairs ``a < b`` of different names of a group whose similarity is ``least`` or more: 1 - edit distance / longer length."""
    # An array of one distance or none: computed once a pair, and only as far as the edits allowed.
    near = _trimmed(candidates(df, group, name, least)).select("a", "b", "n", F.explode(F.expr("array_remove(array(levenshtein(_x, _y, k)), -1)")).alias("_edits"))
    s = 1 - F.col("_edits") / F.col("n")
    return near.where(s >= least).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.round(s, 6).alias("similarity"))
