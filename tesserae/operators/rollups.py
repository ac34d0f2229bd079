"""Aggregations over activity: rates, histograms, budgets of storage, and change summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def success_rate(df: DataFrame, ok: Column, order: list[Column], last: int, empty: float) -> DataFrame:
    """Share of ``ok`` among the last rows by ``order``; ``empty`` where there are none. A null outcome counts as failed."""
    return df.orderBy(*order).limit(last).agg(F.coalesce(F.avg(F.when(ok, 1.0).otherwise(0.0)), F.lit(empty)).alias("success_rate"))


def operation_metrics(df: DataFrame, operation: str, at: str, duration: str, as_of: Column, hours: int = 24) -> DataFrame:
    """Number and mean duration per operation in the hours before ``as_of``, and the rate per second of the last hour."""
    within = df.where((F.col(at) >= as_of - F.expr(f"INTERVAL {hours} HOURS")) & (F.col(at) <= as_of))
    recent = F.col(at) >= as_of - F.expr("INTERVAL 1 HOURS")
    return within.groupBy(operation).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(duration), 6).alias("mean_duration"), F.round(F.sum(F.when(recent, 1).otherwise(0)) / F.lit(3600.0), 9).alias("per_second"))


def daily_histogram(df: DataFrame, at: str) -> DataFrame:
    return df.where(F.col(at).isNotNull()).groupBy(F.date_format(at, "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def peakiness(df: DataFrame, bucket: str) -> DataFrame:
    """How far a histogram's largest bucket stands out: a tenth of max / mean, 0.9 at most, 0 without rows."""
    n = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.when(F.max("n").isNull(), 0.0).otherwise(F.round(F.least(F.lit(0.9), F.max("n") / F.avg("n") / 10), 6)).alias("peakiness"))


def content_sharing(df: DataFrame, digest: str, size: str) -> DataFrame:
    """What storing equal contents once saves: rows, different contents, bytes of both and their ratio. Null digests store nothing."""
    each = df.where(F.col(digest).isNotNull()).groupBy(F.col(digest).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.max(size).alias("size"))
    total, unique = F.coalesce(F.sum(F.col("n") * F.col("size")), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_contents"), total.alias("total_bytes"), unique.alias("unique_bytes"), (total - unique).alias("saved_bytes"), F.round(F.coalesce(F.try_divide(unique, total), F.lit(1.0)), 6).alias("ratio"))


def kind(c: str = "change_type") -> Column:
    """Kind of change in lower case."""
    return F.lower(F.col(c)["kind"])


def change_counts(df: DataFrame, key: str) -> DataFrame:
    """Created, modified and deleted files per key, the signed change of size, and a short text ``+n =n -n``."""
    of = lambda *k: F.sum(F.when(kind().isin(*k), 1).otherwise(0))
    signed = F.when(kind() == "created", F.col("size_bytes")).when(kind() == "deleted", -F.col("size_bytes")).otherwise(0)
    counts = df.groupBy(key).agg(of("created").alias("n_created"), of("modified", "renamed", "moved").alias("n_modified"), of("deleted").alias("n_deleted"), F.coalesce(F.sum(signed), F.lit(0)).alias("size_delta"))
    text = F.concat(F.lit("+"), F.col("n_created").cast("string"), F.lit(" ="), F.col("n_modified").cast("string"), F.lit(" -"), F.col("n_deleted").cast("string"))
    return counts.withColumn("summary", text)


def change_scope(df: DataFrame, key: str, path: str) -> DataFrame:
    """Files, folders and top folders per key, and the scope they make."""
    folder = F.regexp_replace(path, r"/?[^/]*$", "")
    top = F.when(F.col(path).contains("/"), F.split(path, "/")[0]).otherwise("")
    n = df.where(F.col(path).isNotNull()).groupBy(key).agg(F.countDistinct(path).alias("n_files"), F.countDistinct(folder).alias("n_folders"), F.countDistinct(top).alias("n_tops"))
    scope = F.when(F.col("n_files") == 1, "file").when(F.col("n_folders") == 1, "folder").when(F.col("n_tops") == 1, "component").otherwise("project")
    return n.withColumn("scope", scope)


def normalised_strength(df: DataFrame, target: str, strength: Column) -> DataFrame:
    """Total strength per target over the greatest total; the single greatest number is joined, not a window over all rows."""
    per = df.groupBy(target).agg(F.sum(strength).alias("strength"))
    top = per.agg(F.max("strength").alias("top"))
    return per.join(F.broadcast(top)).select(target, "strength", F.round(F.coalesce(F.try_divide("strength", "top"), F.lit(0.0)), 6).alias("normalised"))
