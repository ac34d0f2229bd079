"""What a cache would hold after a history of accesses, computed as a set instead of replayed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.latest import latest_per_key


def least_recently_used(accesses: DataFrame, key: str, at: str, tie: str, capacity: int) -> DataFrame:
    """``key, at``: content of a cache that drops its least recently used entry: the last ``capacity`` keys by last access."""
    last = latest_per_key(accesses.where(F.col(key).isNotNull()), [key], [at, tie], [at, tie])
    return last.orderBy(F.desc(at), F.desc(tie)).limit(capacity).select(key, at)


def alive(entries: DataFrame, at: str, as_of: Column, hours: int) -> DataFrame:
    """Entries younger than their time to live."""
    return entries.where(F.col(at) > as_of - F.expr(f"INTERVAL {hours} HOURS"))


def resolve_in_order(wanted: DataFrame, key: str, sources: list[tuple[DataFrame, str, float]], value: str) -> DataFrame:
    """``key, value, confidence``: each key by the first source that knows it; a source is (table of key and value, name, confidence)."""
    found = None
    for rank, (source, _, confidence) in enumerate(sources):
        s = source.select(key, value, F.lit(rank).alias("_rank"), F.lit(confidence).alias("confidence"))
        found = s if found is None else found.unionByName(s)
    best = found.groupBy(key).agg(F.min(F.struct("_rank", value, "confidence")).alias("b"))
    return wanted.select(key).distinct().join(best, key, "left").select(key, F.col(f"b.{value}").alias(value), F.col("b.confidence").alias("confidence"))
