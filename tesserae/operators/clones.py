"""Repeated runs of lines across files, by content hash and by shared lines; sets of folders that overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.runtime import materialize, parts


def window_hashes(text: str, n: int) -> Column:
    """Hashes of every run of ``n`` normalised lines (trimmed, without blank and comment lines), in order; null where there is none."""
    kept = F.filter(F.transform(F.split(F.col(text), r"\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("//") & ~x.startswith("#"))
    runs = F.transform(F.sequence(F.lit(1), F.size(kept) - (n - 1)), lambda i: F.sha2(F.array_join(F.slice(kept, i, F.lit(n)), "\n"), 256))
    return F.when(F.size(kept) >= n, runs)


def line_windows(df: DataFrame, key: str, hashes: str) -> DataFrame:
    """``key, line_no, h``: one row per run of lines."""
    return df.select(key, F.posexplode(hashes).alias("line_no", "h"))


def exact_clones(windows: DataFrame, key: str) -> DataFrame:
    """``h, n_places, n_files``: runs of lines that stand in more than one place; counted, never paired."""
    return windows.groupBy("h").agg(F.count(F.lit(1)).alias("n_places"), F.countDistinct(key).alias("n_files")).where("n_places > 1")


def duplication(windows: DataFrame, key: str, clones: DataFrame) -> DataFrame:
    """``key, n_windows, n_cloned, share``: how much of each file's runs of lines stands elsewhere too."""
    marked = windows.join(clones.select("h", F.lit(1).alias("_c")), "h", "left")
    return marked.groupBy(key).agg(F.count(F.lit(1)).alias("n_windows"), F.count("_c").alias("n_cloned"), F.round(F.count("_c") / F.count(F.lit(1)), 6).alias("share"))


#: Rows of one key that a join compares at a time; bounds what a task holds, changes no result.
BLOCK = 1000


def _blocks(df: DataFrame, by: str) -> DataFrame:
    """``by, _blocks``: into how many blocks the rows of each value are split."""
    return df.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks"))


def _first_folders(df: DataFrame, key: str, path: str, least: float) -> tuple[DataFrame, DataFrame]:
    """``_k, _c``: keys with a key that stands for all with the same folders; ``_c, _s, _n, _at, _f`` of each ``_c``: its folders, rarest first, and the first of them one by one.

    Two sets that share more than ``least`` share one of these: of ``n`` folders at least ``m`` must be shared, so not
    all of the first ``n - m + 1`` can be missing from the other.
    """
    rows = df.where(F.col(path).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.regexp_replace(path, r"/?[^/]*$", "").alias("_f")).distinct()
    rows = rows.join(rows.groupBy("_f").agg(F.count(F.lit(1)).alias("_often")), "_f")
    sets = materialize(rows.groupBy("_k").agg(F.transform(F.array_sort(F.collect_list(F.struct("_often", "_f"))), lambda x: x["_f"]).alias("_s")))
    classes = sets.groupBy("_s").agg(F.min("_k").alias("_c"))
    keys = sets.join(classes, "_s").select("_k", "_c")
    n, floor = F.size("_s"), F.floor(least * F.size("_s"))
    shared = F.greatest(F.lit(1), floor + F.when(F.round(floor / n, 6) > least, 0).otherwise(1)).cast("int")
    firsts = classes.select("_c", "_s", n.alias("_n"), F.posexplode(F.slice("_s", F.lit(1), F.greatest(F.lit(0), n - shared + 1))).alias("_at", "_f"))
    return materialize(keys), materialize(firsts)


def overlap_candidates(firsts: DataFrame, least: float) -> DataFrame:
    """``_c, _d, _sc, _sd``: pairs of different sets, once each, that share a first folder and whose sizes and places let them share more than ``least``."""
    n_parts = parts(firsts.sparkSession)
    f = firsts.join(_blocks(firsts, "_f"), "_f")
    one = f.withColumn("_block", F.pmod(F.xxhash64("_c"), F.col("_blocks")).cast("int")).drop("_blocks").repartition(n_parts, "_f", "_block")
    other = f.select("_f", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"), *[F.col(x).alias(y) for x, y in (("_c", "_d"), ("_s", "_sd"), ("_n", "_nd"), ("_at", "_atd"))]).repartition(n_parts, "_f", "_block")
    most = F.least(F.col("_n") - F.col("_at"), F.col("_nd") - F.col("_atd"))
    near = other.join(one.withColumnRenamed("_s", "_sc").hint("merge"), ["_f", "_block"]).where("_c < _d").where(F.round(most / (F.col("_n") + F.col("_nd") - most), 6) > least)
    return near.where(F.element_at(F.array_intersect("_sc", "_sd"), 1) == F.col("_f")).select("_c", "_d", "_sc", "_sd")


def directory_overlap(df: DataFrame, key: str, path: str, least: float) -> DataFrame:
    """``a, b, overlap``: all pairs of keys whose sets of folders share more than ``least`` of them (0 or more).

    Sets are compared once however many keys have them, and only where they share one of their rarest folders, so a
    folder that every key touches does not pair all of them.
    """
    keys, firsts = _first_folders(df, key, path, least)
    both = F.size(F.array_intersect("_sc", "_sd"))
    pairs = overlap_candidates(firsts, least).select("_c", "_d", F.round(both / (F.size("_sc") + F.size("_sd") - both), 6).alias("overlap"))
    same = keys.groupBy("_c").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1").select("_c", F.col("_c").alias("_d"), F.lit(1.0).alias("overlap"))
    pairs = pairs.unionByName(same).where(F.col("overlap") > least)
    b = keys.join(_blocks(keys, "_c"), "_c").select(F.col("_c").alias("_d"), F.col("_k").alias("b"), F.pmod(F.xxhash64("_k"), F.col("_blocks")).cast("int").alias("_block"))
    a = pairs.join(keys, "_c").join(_blocks(keys, "_c").withColumnRenamed("_c", "_d"), "_d").withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    n_parts = parts(df.sparkSession)
    met = a.repartition(n_parts, "_d", "_block").join(b.repartition(n_parts, "_d", "_block"), ["_d", "_block"]).where("_c <> _d or _k < b")
    return met.select(F.least("_k", "b").alias("a"), F.greatest("_k", "b").alias("b"), "overlap")
