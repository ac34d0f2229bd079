"""References to records that do not exist, per parent table and period.

Parent and child keys of all references are put into one long table tagged by parent table, which
is grouped once by (parent table, key). Before that shuffle the children are folded to one row per
(parent table, key, referring record), and the group itself is a plain min/max aggregation with a
map-side combine, so a key held by a third of all rows costs no more than any other. Only the keys
that turn out bad (no live parent, or a parent that arrived after some child) are joined back: those that
more children name than ``HOT_CHILDREN`` by a broadcast, as there can be no more of them than one in so
many rows, so that no task gets all children of a hot key; the rest by a shuffle on the key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.runtime import materialize


HOT_CHILDREN = 1_000_000


@dataclass(frozen=True)
class Reference:
    """One reference: ``child.child_key`` names ``parent.parent_key``.

    ``deleted`` is an expression over the parent that is true on a row which records its deletion.
    """

    name: str
    child: DataFrame
    child_id: str
    child_key: str
    child_arrived: str
    child_time: str
    parent: DataFrame
    parent_key: str
    parent_arrived: str
    deleted: Column


def normal_key(c: Column) -> Column:
    """Key without surrounding blanks and case; blank becomes null."""
    k = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(k != "", k)


def _children(ref: Reference) -> DataFrame:
    """One row per referring record and key: its first arrival and its own time."""
    c = ref.child
    # A record delivered more than once arrived with its first delivery; the key of each delivery counts.
    return (
        c.select(
            F.lit(ref.name).alias("ref_table"),
            c[ref.child_id].cast("string").alias("record_id"),
            normal_key(c[ref.child_key]).alias("key"),
            c[ref.child_arrived].alias("arrived"),
            c[ref.child_time].alias("at"),
        )
        .where("record_id is not null")
        .groupBy("ref_table", "record_id")
        .agg(F.collect_set("key").alias("keys"), F.min("arrived").alias("arrived"), F.min("at").alias("at"))
        .select("ref_table", "record_id", F.explode("keys").alias("key"), "arrived", "at")
    )


def _parents(ref: Reference) -> DataFrame:
    p = ref.parent
    return p.select(
        F.lit(ref.name).alias("ref_table"),
        normal_key(p[ref.parent_key]).alias("key"),
        F.lit(True).alias("is_parent"),
        p[ref.parent_arrived].alias("parent_first"),
        F.coalesce(ref.deleted, F.lit(False)).alias("is_deleted"),
        F.lit(None).cast(ref.child.schema[ref.child_arrived].dataType).alias("child_first"),
    ).where("key is not null")


def orphans(references: list[Reference], *, hot_children: int = HOT_CHILDREN) -> DataFrame:
    """Rows ``ref_table, record_id, key, at, reason``, one per record and key; reason is ``missing``, ``deleted`` or ``late``.

    Null and blank references are no cases. A null arrival of either side proves no lateness. A target
    with several rows is deleted if any of them says so and arrived with its first. Repeated deliveries
    of a record count once. Empty parents make every reference missing, empty children give no rows.
    Extra columns of the tables are never carried along, so their names cannot clash.
    """
    parts, kids = [], []
    for ref in references:
        c = _children(ref)
        kids.append(c)
        tagged = c.select("ref_table", "key", F.lit(False).alias("is_parent"), F.lit(None).cast(ref.parent.schema[ref.parent_arrived].dataType).alias("parent_first"), F.lit(False).alias("is_deleted"), F.col("arrived").alias("child_first"))
        parts += [_parents(ref), tagged]
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    children = kids[0]
    for c in kids[1:]:
        children = children.unionByName(c)
    bad = materialize(
        long.groupBy("ref_table", "key")
        .agg(F.sum(F.when(F.col("is_parent"), 0).otherwise(1)).alias("n_children"), F.max("is_parent").alias("has_parent"), F.max("is_deleted").alias("is_deleted"), F.min("parent_first").alias("parent_first"), F.min("child_first").alias("child_first"))
        .where("not has_parent or is_deleted or parent_first > child_first")
        .drop("child_first")
    )
    verdict = F.struct("has_parent", "is_deleted", "parent_first")
    hot = bad.where(F.col("n_children") > hot_children).select("ref_table", "key", verdict.alias("_hot"))
    cold = bad.where(F.col("n_children") <= hot_children).select("ref_table", F.col("key").alias("_key"), verdict.alias("_cold"))
    met = children.join(F.broadcast(hot), ["ref_table", "key"], "left")
    # Children of hot keys are done and spread by their own id.
    met = met.withColumn("_key", F.when(F.col("_hot").isNull(), F.col("key")).otherwise(F.concat(F.lit("\0"), F.col("record_id"))))
    both = met.join(cold, ["ref_table", "_key"], "left").withColumn("v", F.coalesce("_hot", "_cold")).where("v is not null")
    reason = F.when(~F.col("v.has_parent"), "missing").when(F.col("v.is_deleted"), "deleted").when(F.col("v.parent_first") > F.col("arrived"), "late")
    return both.withColumn("reason", reason).where("reason is not null").select("ref_table", "record_id", "key", "at", "reason")


def orphan_report(cases: DataFrame, period: str = "month") -> DataFrame:
    """``ref_table, period, reason, n_records``: distinct referring records per table, period of their own time and reason."""
    return (
        cases.groupBy("ref_table", "record_id", "reason")
        .agg(F.min("at").alias("at"))
        .groupBy("ref_table", F.date_format(F.date_trunc(period, "at"), "yyyy-MM-dd").alias("period"), "reason")
        .agg(F.count(F.lit(1)).alias("n_records"))
    )
