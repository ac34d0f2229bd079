"""Near-duplicate records by a chosen-path join over token triples.

Each set of triples is represented by ``COORDINATES`` tokens of its own that one-permutation minhash samples, one
for each slot of the hash, so that two sets hold the same token in a slot with a probability of their similarity.
A tree of buckets is grown from several roots, the runs: a record enters a run's bucket by one sampled token, and
the records of a bucket too large for brute force are split again, each time on slots that the node samples by its
own hash, into buckets of records that share the sampled token. Two children are grown per node, so a pair of
similarity 0.7 survives any number of splits with a probability of 0.81. Nothing that falls into a small bucket is
left out; a large bucket that a split hardly shrinks, or that is left after ``DEPTH`` splits, is compared in full
but for the records of its commonest label among each other, which no result can name; its records are dealt into
blocks and the comparisons of two blocks are one group of work, so no task gets a whole hot bucket.

Runs are repeated until the target recall: pairs that hold are counted by the number of runs that found them, and
from those found once and twice the number that no run has found yet is estimated (Chao's estimator). The first
``FIRST_RUNS`` runs are followed by ``MORE_RUNS`` at a time as long as the estimated recall is below ``RECALL``.

Only candidates that a 64-bit summary does not rule out are compared exactly, on whole sets. Exact copies of a set
take part once, by a representative; groups and numbers of links are found from representatives and the members
of each class, without a pair of copies ever being written out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.tokens import slices
from tesserae.operators.components import connected_components
from tesserae.runtime import materialize

COORDINATES = 64
#: Runs before recall is estimated for the first time, runs added at a time, and the recall that ends them.
FIRST_RUNS, MORE_RUNS, RECALL = 8, 4, 0.9995
BUCKET = 24
#: Records of a large bucket that one block holds, on average.
BLOCK = 2048
DEPTH = 8
#: A bucket that a split leaves this much of is of one kind; splitting it again would only copy it.
STUCK = 0.9
#: Summaries (a bit per coordinate) of a pair of similarity 0.7 differ in 9.6 bits on average, with a
#: standard deviation of 2.9; of unrelated sets in 32.
SUMMARY_BITS = 27
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_IS_TOKEN = np.zeros(256, dtype=bool)
_IS_TOKEN[[*b"abcdefghijklmnopqrstuvwxyz0123456789_"]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def triples(texts: list[str | None], least_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, hash)`` of the distinct token triples of each text that has enough tokens, sorted by both.

    Tokens are maximal runs of a-z, 0-9 and _ after lower-casing.
    """
    none = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    lowered = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    size = np.array([len(t) + 1 for t in lowered], dtype=np.int64)
    raw = np.frombuffer(b"\n".join(lowered) + b"\n", dtype=np.uint8)
    inside = _IS_TOKEN[raw]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(start) < 3:
        return none
    # Polynomial hash of each token from sums over its letters, by its place inside the token.
    place = np.arange(len(raw)) - np.repeat(np.concatenate([[0], start]), np.diff(np.concatenate([[0], start, [len(raw)]])))
    longest = int((end - start).max())
    power = np.cumprod(np.concatenate([[1], np.full(longest, 0x100000001B3, dtype=np.uint64)]).astype(np.uint64))
    letter = np.where(inside, (raw.astype(np.uint64) + np.uint64(1)) * power[np.where(inside, place, 0)], 0)
    token = _mix(np.add.reduceat(letter, start) + (end - start).astype(np.uint64))
    row = np.searchsorted(np.cumsum(size), start, side="right")
    enough = np.bincount(row, minlength=len(texts)) >= least_tokens
    h = _mix(_mix(_mix(token[:-2]) * np.uint64(3) + token[1:-1]) * np.uint64(5) + token[2:])
    row, same = row[:-2], row[:-2] == row[2:]
    keep = same & enough[row]
    row, h = row[keep], h[keep]
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[fresh], h[fresh]


def coordinates(row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    """One-permutation minhash of each row as int32, shape (rows, COORDINATES).

    An empty coordinate borrows from the coordinates that its own hash sequence names, so that it
    agrees between two sets as often as any other. Rows without triples hold 0.
    """
    out = np.full((rows, COORDINATES), -1, dtype=np.int64)
    if not len(h):
        return np.zeros((rows, COORDINATES), dtype=np.int32)
    slot = row * COORDINATES + (h & np.uint64(COORDINATES - 1)).astype(np.int64)
    value = (h >> np.uint64(6)).astype(np.int64)
    order = np.lexsort((value, slot))
    slot, value = slot[order], value[order]
    first = np.ones(len(slot), dtype=bool)
    first[1:] = slot[1:] != slot[:-1]
    out.ravel()[slot[first]] = value[first]
    has = (out >= 0).any(axis=1)
    empty, filled = out < 0, out.copy()
    for attempt in range(1, 4096):
        todo = empty & has[:, None] & (filled < 0)
        r, c = np.nonzero(todo)
        if not len(r):
            break
        donor = (_mix(c.astype(np.uint64) * np.uint64(7919) + np.uint64(attempt)) & np.uint64(COORDINATES - 1)).astype(np.int64)
        got = out[r, donor]
        ok = got >= 0
        filled[r[ok], c[ok]] = _mix(got[ok].view(np.uint64) + np.uint64(attempt)).view(np.int64) >> 3 & ((1 << 58) - 1)
    return (_mix(filled.view(np.uint64)) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _sketches(records: DataFrame, kind: str, least_tokens: int) -> DataFrame:
    """``_id, _label, s1, s2, n, bits, sig``: identity, size and sketch of each record's set of triples."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, 2_000_000):
                row, h = triples(part.column(2).to_pylist(), least_tokens)
                n = np.bincount(row, minlength=part.num_rows)
                has = np.flatnonzero(n)
                if not len(has):
                    continue
                sig = coordinates(row, h, part.num_rows)[has]
                begin = np.searchsorted(row, has)
                s1, s2 = np.add.reduceat(_mix(h), begin).view(np.int64), np.add.reduceat(_mix(h ^ _MIX2), begin).view(np.int64)
                bits = np.packbits((sig & 1).astype(np.uint8), axis=1).copy().view(np.int64).ravel()
                at = pa.array(has)
                offsets = pa.array(np.arange(len(has) + 1, dtype=np.int32) * COORDINATES)
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(s1), pa.array(s2), pa.array(n[has]), pa.array(bits), pa.ListArray.from_arrays(offsets, pa.array(sig.ravel()))], names=["_id", "_label", "s1", "s2", "n", "bits", "sig"])

    return records.mapInArrow(run, f"_id {kind}, _label long, s1 long, s2 long, n long, bits long, sig array<int>")


def _sets(records: DataFrame, kind: str, least_tokens: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 2_000_000):
                row, h = triples(part.column(1).to_pylist(), least_tokens)
                offsets = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(h.view(np.int64)))], names=["_id", "triples"])

    return records.mapInArrow(run, f"_id {kind}, triples array<long>")


def _bucket_pairs(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of one bucket that sizes, labels and summaries do not rule out."""
    side = lambda x: rows.select("node", *(["run"] if x == "a" else []), *[F.col(c).alias(f"{c}_{x}") for c in ("rep", "low", "high", "n", "bits")])
    may = f"rep_a < rep_b and least(n_a, n_b) * {den} >= greatest(n_a, n_b) * {num} and not (low_a = high_b and high_a = low_b) and bit_count(bits_a ^ bits_b) <= {SUMMARY_BITS}"
    return side("a").join(side("b"), "node").where(may).select("run", "rep_a", "rep_b")


def _crowded_pairs(rows: DataFrame, num: int, den: int, block: int = BLOCK) -> DataFrame:
    """The same for large buckets ``node, ..., held``: records of a bucket's commonest label are only compared with those of other labels.

    A record belongs to one of ``held / block`` blocks. Those without the commonest label meet every block of their
    bucket, each meeting in a group of its own.
    """
    common = rows.where("low = high").groupBy("node", "low").agg(F.count(F.lit(1)).alias("k")).groupBy("node").agg(F.max(F.struct("k", "low")).alias("c")).select("node", F.col("c.low").alias("common"))
    marked = rows.join(common, "node", "left").withColumn("is_common", F.coalesce((F.col("low") == F.col("common")) & (F.col("high") == F.col("common")), F.lit(False)))
    blocks = (F.floor(F.col("held") / block) + 1).cast("int")
    dealt = marked.withColumn("_n", blocks).withColumn("_own", F.pmod(F.xxhash64("rep", "node"), F.col("_n")).cast("int"))
    side = lambda x, df: df.select("node", "_a", "_b", *[F.col(c).alias(f"{c}_{x}") for c in ("rep", "low", "high", "n", "bits")])
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias(c)
    left = dealt.where("not is_common").select("*", F.col("_own").alias("_a"), every("_b"))
    right = dealt.select("*", F.col("_own").alias("_b"), every("_a"))
    may = f"rep_a <> rep_b and least(n_a, n_b) * {den} >= greatest(n_a, n_b) * {num} and not (low_a = high_b and high_a = low_b) and bit_count(bits_a ^ bits_b) <= {SUMMARY_BITS}"
    pairs = side("a", left).join(side("b", right), ["node", "_a", "_b"]).where(may)
    return pairs.select("node", F.least("rep_a", "rep_b").alias("rep_a"), F.greatest("rep_a", "rep_b").alias("rep_b"))


def _candidates(sketches: DataFrame, num: int, den: int, first: int, runs: int) -> DataFrame:
    """``rep_a, rep_b, hits``: pairs that share a bucket in some of the runs ``first .. first + runs - 1``, and in how many."""
    slim = ["run", "rep", "low", "high", "n", "bits"]
    stuck = f"held > {BUCKET} and held >= {STUCK} * was"
    run = F.explode(F.sequence(F.lit(first), F.lit(first + runs - 1))).alias("run")
    rows = sketches.select(*slim[1:], "sig", run).select(F.xxhash64("run", F.element_at("sig", F.pmod("run", F.lit(COORDINATES)) + 1)).alias("node"), *slim, F.lit(None).cast("long").alias("was"))
    found, level = None, 0
    while True:
        size = rows.groupBy("node").agg(F.count(F.lit(1)).alias("held"), F.min("low").alias("lowest"), F.max("high").alias("highest")).where("held > 1 and lowest <> highest").select("node", "held")
        sized = rows.join(size, "node")
        small = _bucket_pairs(sized.where(f"held <= {BUCKET}").select("node", *slim), num, den)
        found = small if found is None else found.unionByName(small)
        level += 1
        crowded = materialize(sized.where(f"held > {BUCKET}").select("node", *slim, "held", F.coalesce(F.expr(stuck), F.lit(False)).alias("stuck")))
        done = crowded.isEmpty()
        if not done:
            left = crowded.where(F.col("stuck") | F.lit(level > DEPTH))
            of_run = left.select("node", "run").distinct()
            found = found.unionByName(_crowded_pairs(left.drop("run"), num, den).join(of_run, "node").select("run", "rep_a", "rep_b"))
        if done or level > DEPTH:
            return found.distinct().groupBy("rep_a", "rep_b").agg(F.count(F.lit(1)).alias("hits"))
        crowded = crowded.where("not stuck").drop("stuck")
        # Two slots, sampled by the node, split its records by their tokens.
        child = lambda k: F.pmod(F.xxhash64(F.lit(k), "node"), F.lit(COORDINATES)).cast("int")
        other = F.pmod(child(1) + 1 + F.pmod(F.xxhash64(F.lit(2), "node"), F.lit(COORDINATES - 1)), F.lit(COORDINATES)).cast("int")
        rows = (
            crowded.join(sketches.select("rep", "sig"), "rep")
            .select(*slim, "held", "sig", "node", F.explode(F.array(child(1), other)).alias("at"))
            .select(F.xxhash64("node", "at", F.element_at("sig", F.col("at") + 1)).alias("node"), *slim, F.col("held").alias("was"))
        )


def _exact(candidates: DataFrame, texts: DataFrame, kind: str, num: int, den: int, least_tokens: int) -> DataFrame:
    """The candidates ``rep_a, rep_b`` whose whole sets are similar enough."""
    wanted = candidates.select(F.explode(F.array("rep_a", "rep_b")).alias("_id")).distinct()
    sets = _sets(texts.select("_id", "_text").join(wanted, "_id", "left_semi"), kind, least_tokens).groupBy("_id").agg(F.first("triples").alias("triples"))
    shared = F.size(F.array_intersect("ta", "tb"))
    return (
        candidates.select("rep_a", "rep_b")
        .join(sets.select(F.col("_id").alias("rep_a"), F.col("triples").alias("ta")), "rep_a")
        .join(sets.select(F.col("_id").alias("rep_b"), F.col("triples").alias("tb")), "rep_b")
        .select("rep_a", "rep_b", shared.alias("both"), (F.size("ta") + F.size("tb") - shared).alias("either"))
        .where(f"both * {den} >= either * {num}")
        .select("rep_a", "rep_b")
    )


def estimated_recall(found: int, once: int, twice: int, runs: int) -> float:
    """Share of all pairs that is found, by Chao's estimate of those that no run has found."""
    missing = (runs - 1) / runs * once * (once - 1) / (2 * (twice + 1))
    return found / (found + missing) if found else 1.0


def near_duplicate_classes(records: DataFrame, id_column: str, label_column: str, text_column: str, *, num: int = 7, den: int = 10, least_tokens: int = 30) -> tuple[DataFrame, DataFrame]:
    """Members ``rep, _id, _label`` of each class of equal sets, and links ``rep_a, rep_b`` between similar classes.

    A class with several labels is linked to itself. Only classes that a result can name are linked: not two of one
    and the same label. A repeated id is a member once a class, under its least label.
    """
    kind = records.schema[id_column].dataType.simpleString()
    label = F.xxhash64(F.coalesce(F.col(label_column), F.lit("")))
    texts = records.select(F.col(id_column).alias("_id"), label.alias("_label"), F.col(text_column).alias("_text")).where("_id is not null and _text is not null")
    sketched = materialize(_sketches(texts, kind, least_tokens))
    members = sketched.groupBy("s1", "s2", "n", "_id").agg(F.min("_label").alias("_label"))
    classes = sketched.groupBy("s1", "s2", "n").agg(F.min("_id").alias("rep"), F.min("_label").alias("low"), F.max("_label").alias("high"), F.first("bits").alias("bits"), F.first("sig").alias("sig"))
    reps = materialize(classes)
    sketches = reps.select("rep", "low", "high", "n", "bits", "sig")
    hits = good = None
    runs, step = 0, FIRST_RUNS
    while True:
        fresh = materialize(_candidates(sketches, num, den, runs, step))
        unknown = fresh if hits is None else fresh.join(hits, ["rep_a", "rep_b"], "left_anti")
        holds = materialize(_exact(unknown, texts, kind, num, den, least_tokens))
        good = holds if good is None else good.unionByName(holds)
        hits = fresh if hits is None else materialize(hits.unionByName(fresh).groupBy("rep_a", "rep_b").agg(F.sum("hits").alias("hits")))
        runs, step = runs + step, MORE_RUNS
        c = good.join(hits, ["rep_a", "rep_b"]).agg(F.count(F.lit(1)), F.count(F.when(F.col("hits") == 1, 1)), F.count(F.when(F.col("hits") == 2, 1))).first()
        if estimated_recall(c[0], c[1], c[2], runs) >= RECALL or runs >= COORDINATES:
            break
    within = reps.where("low <> high").select(F.col("rep").alias("rep_a"), F.col("rep").alias("rep_b"))
    people = members.join(reps.select("s1", "s2", "n", "rep"), ["s1", "s2", "n"]).select("rep", "_id", "_label")
    return people, good.unionByName(within)


def near_duplicate_pairs(records: DataFrame, id_column: str, label_column: str, text_column: str, *, num: int = 7, den: int = 10, least_tokens: int = 30) -> DataFrame:
    """``id_a, id_b``: records of different labels whose triples' Jaccard similarity is at least num / den.

    The smaller id comes first and pairs are distinct. Texts with fewer than ``least_tokens`` tokens,
    null texts and null ids are left out; a null label counts as empty; repeated deliveries of an id count
    once; no rows give no pairs. Candidates come from the chosen-path join, similarities are exact.
    """
    people, links = near_duplicate_classes(records, id_column, label_column, text_column, num=num, den=den, least_tokens=least_tokens)
    side = lambda x: people.select(F.col("rep").alias(f"rep_{x}"), F.col("_id").alias(f"i{x}"), F.col("_label").alias(f"l{x}"))
    pairs = links.join(side("a"), "rep_a").join(side("b"), "rep_b").where("la <> lb and ia <> ib")
    return pairs.select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")).distinct()


def near_duplicate_groups(records: DataFrame, id_column: str, label_column: str, text_column: str, *, num: int = 7, den: int = 10, least_tokens: int = 30) -> DataFrame:
    """``id, group_id, n_links``: each record with a near duplicate, its group by the least id, and how many it has.

    Components are those of the classes, whose members are all linked or share their links; the number of links is
    the size of the linked classes less their members of the record's own label. No pair of members is written out.
    Texts, nulls and repeats behave as in :func:`near_duplicate_pairs`.
    """
    people, links = near_duplicate_classes(records, id_column, label_column, text_column, num=num, den=den, least_tokens=least_tokens)
    people, links = materialize(people), materialize(links)
    sized = people.groupBy("rep").agg(F.count(F.lit(1)).alias("size"))
    labelled = people.groupBy("rep", "_label").agg(F.count(F.lit(1)).alias("k"))
    both = links.unionByName(links.where("rep_a <> rep_b").select(F.col("rep_b").alias("rep_a"), F.col("rep_a").alias("rep_b")))
    total = both.join(sized, F.col("rep_b") == F.col("rep")).groupBy("rep_a").agg(F.sum("size").alias("total"))
    own = both.join(labelled, F.col("rep_b") == F.col("rep")).groupBy("rep_a", "_label").agg(F.sum("k").alias("own"))
    # Two members of one class with one label are no link, nor is one that a class holds by itself.
    counted = people.join(total, F.col("rep") == F.col("rep_a")).drop("rep_a").join(own.withColumnRenamed("rep_a", "rep"), ["rep", "_label"], "left").select("rep", "_id", (F.col("total") - F.coalesce("own", F.lit(0))).alias("n")).where("n > 0")
    joined = connected_components(links.where("rep_a <> rep_b"), "rep_a", "rep_b").select(F.col("node").alias("rep"), "component")
    placed = counted.join(joined, "rep", "left").select("_id", F.coalesce("component", "rep").alias("group_id"), "n")
    return placed.groupBy(F.col("_id").alias("id")).agg(F.min("group_id").alias("group_id"), F.sum("n").alias("n_links"))
