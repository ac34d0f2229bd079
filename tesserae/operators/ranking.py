"""Relevance scores, selection under a budget, and search over an inverted index."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def weighted(parts: dict[str, float]) -> Column:
    """Sum of columns by weight; a null part counts as 0."""
    total = F.lit(0.0)
    for name, w in parts.items():
        total = total + w * F.coalesce(F.col(name), F.lit(0.0))
    return total


def first_wins(df: DataFrame, keys: list[Column], seq: str) -> DataFrame:
    """The row of least ``seq`` per key, by aggregation; ``seq`` should be unique."""
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    picked = F.min_by(F.struct(*df.columns), seq).alias("_row")
    return df.groupBy(*named).agg(picked).select("_row.*")


def fill_budget(df: DataFrame, group: str, score: str, cost: str, tie: str, budget: int) -> DataFrame:
    """Greedy choice per group by falling score: a row is taken if it still fits, else skipped; ``columns, taken_before``.

    Whether a row fits depends on all better rows, so a group is read in order by one task, in batches: its
    running cost is all that is kept in memory, however large the group. Null costs count as 0.
    """
    schema = StructType([*df.schema.fields, StructField("taken_before", LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, used = object(), 0
        for batch in batches:
            keep, before = [], []
            for g, c in zip(batch[group], batch[cost].fillna(0)):
                if g != now:
                    now, used = g, 0
                keep.append(used + c <= budget)
                before.append(used)
                used += c if keep[-1] else 0
            batch["taken_before"] = before
            yield batch[keep]

    return df.repartition(group).sortWithinPartitions(group, F.desc(score), tie).mapInPandas(run, schema)


def diverse(df: DataFrame, group: str, score: str, tie: str, items: str, most: int, overlap: float) -> DataFrame:
    """Greedy choice of at most ``most`` rows per group by falling score, leaving out rows whose items overlap a chosen one's too much.

    Only the chosen rows of the current group are in memory.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, chosen = object(), []
        for batch in batches:
            keep = []
            for g, its in zip(batch[group], batch[items]):
                if g != now:
                    now, chosen = g, []
                s = set(its) if its is not None else set()
                ok = len(chosen) < most and all(len(s & c) <= overlap * max(1, len(s | c)) for c in chosen)
                keep.append(ok)
                if ok:
                    chosen.append(s)
            yield batch[keep]

    return df.repartition(group).sortWithinPartitions(group, F.desc(score), tie).mapInPandas(run, df.schema)


def longest_prefix(df: DataFrame, probe: str, keys: DataFrame, key: str, value: str, most: int) -> DataFrame:
    """``probe, key, value`` of the longest key that begins each probe; keys of at most ``most`` letters.

    Each probe is cut into its own prefixes, so the search is an equality join.
    """
    p = df.select(probe).distinct().where(F.length(probe) > 0)
    cut = p.select(probe, F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length(probe), F.lit(most))), lambda n: F.substring(F.col(probe), F.lit(1), n))).alias("_p"))
    j = cut.join(keys.select(F.col(key).alias("_p"), F.col(value).alias("_v")), "_p")
    return j.groupBy(probe).agg(F.max(F.struct(F.length("_p").alias("l"), "_p", "_v")).alias("b")).select(probe, F.col("b._p").alias(key), F.col("b._v").alias(value))


def terms(df: DataFrame, doc: str, text: str) -> DataFrame:
    """``doc, term, tf, doc_len``: inverted index of lower-case words, one row per document and term."""
    w = df.where(F.col(text).isNotNull()).select(doc, F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9_]+)"), 1).alias("_w"))
    return w.select(doc, F.size("_w").alias("doc_len"), F.explode("_w").alias("term")).groupBy(doc, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("doc_len").alias("doc_len"))


def bm25(index: DataFrame, doc: str, query: list[str], corpus: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``doc, score`` of every document with a query term; ``corpus`` is one row with n_docs and mean_len."""
    hits = index.where(F.col("term").isin(*query))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # no more rows than query terms
    j = hits.join(F.broadcast(df), "term").join(F.broadcast(corpus))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / F.col("mean_len")))
    return j.groupBy(doc).agg(F.round(F.sum(part), 6).alias("score"))


def trigrams(c: Column) -> Column:
    """Different letter triples of a padded lower-case text."""
    p = F.concat(F.lit("  "), F.lower(c), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))


def trigram_search(df: DataFrame, key: str, text: str, wanted: str, least: float) -> DataFrame:
    """``key, similarity`` of rows whose trigrams are similar to those of ``wanted``."""
    t = trigrams(F.lit(wanted))
    s = F.size(F.array_intersect(trigrams(F.col(text)), t)) / F.size(F.array_union(trigrams(F.col(text)), t))
    return df.where(F.col(text).isNotNull()).select(key, F.round(s, 6).alias("similarity")).where(F.col("similarity") >= least)


def coverage(df: DataFrame, group: str, text: str, wanted: list[str]) -> DataFrame:
    """``group, coverage``: share of wanted words that some text of the group contains."""
    hit = [F.max(F.when(F.col(text).contains(w), 1.0).otherwise(0.0)) for w in wanted]
    total = hit[0]
    for h in hit[1:]:
        total = total + h
    return df.groupBy(group).agg(F.round(total / len(wanted), 6).alias("coverage"))


def diversity(df: DataFrame, group: str, kinds: dict[str, int]) -> DataFrame:
    """``group, diversity``: mean over the given columns of different values by rows, at most by the column's own limit."""
    n = F.count(F.lit(1))
    parts = [F.countDistinct(c) / (F.least(n, F.lit(limit)) if limit else n) for c, limit in kinds.items()]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return df.groupBy(group).agg(F.round(total / len(parts), 6).alias("diversity"))


def expand_within(df: DataFrame, group: str, score: str, cost: str, tie: str, least: float, budget: int) -> DataFrame:
    """Rows above a score, best first, up to the first that exceeds the budget."""
    w = Window.partitionBy(group).orderBy(F.desc(score), tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.where(F.col(score) > least).withColumn("spent", F.sum(cost).over(w)).where(F.col("spent") <= budget)
