"""Order-dependent operators: neighbours in time, sequences, trends, islands.

A window over a key puts all rows of that key into one task, in order. Where a key may hold a large share
of all rows, :func:`previous_rows` splits the order itself into ranges instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.runtime import materialize


def previous_rows(df: DataFrame, key: str, order: list[str], columns: list[str], prefix: str = "prev_") -> DataFrame:
    """Each row with ``columns`` of the row before it under the same key, null for the first.

    Rows are ranged by (key, order), so a key with any share of the rows spans several tasks; the last row of
    each range, one per task, is handed to the next. ``order`` should tell the rows of a key apart. Null keys
    are a key of their own.
    """
    placed = materialize(df.repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id()))
    row = F.struct(*[F.col(c) for c in columns])
    inner = Window.partitionBy("_range", key).orderBy(*order)
    seen = placed.withColumn("_before", F.lag(row).over(inner)).withColumn("_first", F.row_number().over(inner) == 1)
    last = placed.groupBy("_range").agg(F.max_by(F.struct(F.col(key).alias("k"), row.alias("row")), F.struct(F.col(key).isNotNull(), key, *order)).alias("last"))
    # One row per range: no more than there are tasks.
    tails = last.select("_range", F.lag("last").over(Window.orderBy("_range")).alias("_tail"))
    joined = seen.join(F.broadcast(tails), "_range", "left")
    before = F.when(F.col("_first"), F.when(F.col("_tail.k").eqNullSafe(F.col(key)), F.col("_tail.row"))).otherwise(F.col("_before"))
    return joined.withColumn("_before", before).select(*df.columns, *[F.col("_before")[c].alias(prefix + c) for c in columns])


def adjacent_pairs(df: DataFrame, actor: str, what: str, at: str, tie: str) -> DataFrame:
    """How often one kind of event follows another for the same actor: ``first, second, n, mean_seconds, confidence``.

    Confidence is the share of all events plus 0.3, at most 0.9.
    """
    w = Window.partitionBy(actor).orderBy(at, tie)
    pairs = df.select(F.col(what).alias("first"), F.lead(what).over(w).alias("second"), (F.unix_micros(F.lead(F.col(at).cast("timestamp")).over(w)) - F.unix_micros(F.col(at).cast("timestamp"))).alias("gap")).where("second is not null")
    total = df.agg(F.count(F.lit(1)).alias("total"))
    n = pairs.groupBy("first", "second").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("gap") / 1e6, 3).alias("mean_seconds"))
    return n.join(F.broadcast(total)).select("first", "second", "n", "mean_seconds", F.round(F.least(F.lit(0.9), F.col("n") / F.col("total") + 0.3), 6).alias("confidence"))


def trend(df: DataFrame, series: str, at: str, value: str, last: int) -> DataFrame:
    """Direction and relative change of each series over its last points: ``series, n, direction, rate``.

    Above 70 percent rises it is increasing, below 30 percent decreasing, without any change stable, else
    volatile. Series with fewer points than ``last`` are left out. The rate is (last - first) / first, 0 for a first of 0.
    """
    newest = df.withColumn("_r", F.row_number().over(Window.partitionBy(series).orderBy(F.desc(at)))).where(F.col("_r") <= last)
    step = F.col(value) - F.lag(value).over(Window.partitionBy(series).orderBy(at))
    ups, downs, n = F.sum(F.when(F.col("_d") > 0, 1).otherwise(0)), F.sum(F.when(F.col("_d") < 0, 1).otherwise(0)), F.count(F.lit(1))
    direction = F.when((ups == 0) & (downs == 0), "stable").when(ups / (n - 1) > 0.7, "increasing").when(ups / (n - 1) < 0.3, "decreasing").otherwise("volatile")
    first, end = F.min_by(value, at), F.max_by(value, at)
    rate = F.when(first == 0, 0.0).otherwise((end - first) / first)
    return newest.withColumn("_d", step).groupBy(series).agg(n.alias("n"), direction.alias("direction"), F.round(rate, 6).alias("rate")).where(F.col("n") >= last)


def forecast(df: DataFrame, series: str, x: str, y: str, ahead: int) -> DataFrame:
    """Straight line through each series, carried on: ``series, slope, forecast``."""
    return df.groupBy(series).agg(F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x) + F.regr_slope(y, x) * (F.max(x) + ahead), 6).alias("forecast"))


def islands(df: DataFrame, key: str, begin: str, end: str, gap: Column | float, tie: str) -> DataFrame:
    """Intervals merged where less than ``gap`` lies between: ``key, begin, end, n``; ends of earlier intervals may reach beyond later ones."""
    order = Window.partitionBy(key).orderBy(begin, end, tie)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col(begin) > reach + gap), 1).otherwise(0)
    return df.withColumn("_fresh", fresh).withColumn("_island", F.sum("_fresh").over(order)).groupBy(key, "_island").agg(F.min(begin).alias("begin"), F.max(end).alias("end"), F.count(F.lit(1)).alias("n")).drop("_island")


def clamped_score(df: DataFrame, key: str, order: list[str], delta: Column, start: float = 0.5) -> DataFrame:
    """A score per key that moves by each delta in order and never leaves [0, 1]."""
    steps = F.array_sort(F.collect_list(F.struct(*order, delta.alias("_d"))))
    fold = F.aggregate(steps, F.lit(start), lambda s, x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), s + x["_d"])))
    return df.groupBy(key).agg(F.round(fold, 6).alias("score"))
