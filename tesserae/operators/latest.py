"""Latest row per key, top rows and retention, without sorting a key's rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[str | Column], columns: list[str] | None = None) -> DataFrame:
    """One row per key: the one that is greatest by ``order``; nulls count as least.

    A plain aggregation with a map-side combine, so a hot key is reduced where its rows lie. Rows that tie
    on the whole order are told apart by the remaining columns, which makes the result repeatable as long
    as these can be ordered. Null keys form a group of their own; no rows give no rows.
    """
    columns = columns or [c for c in df.columns if c not in keys]
    order_columns = [F.col(o) if isinstance(o, str) else o for o in order]
    picked = F.max_by(F.struct(*[F.col(c) for c in columns]), F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order_columns)]))
    return df.groupBy(*keys).agg(picked.alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in columns])


def keep_newest(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows by ``order``: each task keeps its own best n before they meet."""
    return df.orderBy(*order).limit(n)


def surviving(df: DataFrame, key: str, tombstones: DataFrame, tombstone_key: str) -> DataFrame:
    """Rows whose key has no tombstone; null keys survive, as no tombstone names them."""
    return df.join(tombstones.select(F.col(tombstone_key).alias("_gone")).distinct(), F.col(key) == F.col("_gone"), "left_anti")
