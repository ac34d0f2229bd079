"""Filling fixed-capacity containers with items, from a histogram of their sizes.

What is decided centrally depends on the capacity alone, never on the number of items. The counts per size
(at most capacity + 1 numbers) reach the driver and a dynamic programme cuts the sizes into length buckets so
that rounding each item up to its bucket's bound would waste least. Batches form inside a bucket under the
token budget: a batch opens with the largest bucket that has items left and takes its items, largest first,
as long as they fit by their own sizes. Room that a bucket's own items leave is topped up from the next
smaller bucket whose bound fits, since batches of one bucket alone would waste the remainder of capacity
divided by bound. Batches of one kind are planned once, with a multiplicity. Each item then finds its container
from its rank among the items of its size by arithmetic; ranks come from salted windows, so one size may hold
any share of the rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Length buckets per capacity, fewer only where there are fewer sizes. More of them fill better and plan slower.
BUCKETS = 128
#: Rows that one window group holds, on average, of one size.
GROUP_ROWS = 200_000


def bucket_bounds(sizes: list[int], counts: list[int], buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least total padding.

    Padding of an item is its bucket's bound less its size. A price per bucket turns the limit on
    their number into a plain shortest path, which the lower hull of lines solves in one pass; the
    price is found by bisection. With no more sizes than buckets there is no padding at all.
    """
    n = len(sizes)
    if n <= buckets:
        return list(sizes)
    total_c = [0, *np.cumsum(counts).tolist()]
    total_s = [0, *np.cumsum(np.multiply(sizes, counts)).tolist()]

    def cut(price: int) -> list[int]:
        best, came = [0] * (n + 1), [0] * (n + 1)
        hull: list[tuple[int, int, int]] = [(0, 0, 0)]  # slope, height, origin
        head = 0
        for j in range(1, n + 1):
            x = sizes[j - 1]
            while head + 1 < len(hull) and hull[head + 1][0] * x + hull[head + 1][1] <= hull[head][0] * x + hull[head][1]:
                head += 1
            m, b, i = hull[head]
            best[j], came[j] = x * total_c[j] - total_s[j] + price + m * x + b, i
            m, b = -total_c[j], best[j] + total_s[j]
            while len(hull) - head >= 2 and (b - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - m):
                hull.pop()
            hull.append((m, b, j))
        bounds, j = [], n
        while j:
            bounds.append(sizes[j - 1])
            j = came[j]
        return bounds[::-1]

    low, high = 0, total_s[-1] + sizes[-1] * total_c[-1] + 1
    while high - low > 1:
        mid = (low + high) // 2
        if len(cut(mid)) > buckets:
            low = mid
        else:
            high = mid
    return cut(high)


def batch_patterns(sizes: list[int], counts: list[int], bounds: list[int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Batches as ``([(place of the size, items of it)], how many such batches)``; every item is in exactly one.

    ``sizes`` are ascending, positive and different, ``bounds`` those that end a bucket. The same batch is
    repeated until one of its sizes runs short, so there are no more kinds of batches than sizes.
    """
    left, out = list(counts), []
    begin = [0, *(bisect_right(sizes, b) for b in bounds)]
    largest = [e - 1 for e in begin[1:]]  # of each bucket, the place of the largest size with items left
    live = list(range(len(bounds)))
    while live := [j for j in live if largest[j] >= begin[j]]:
        picks: dict[int, int] = {}
        touched = {live[-1]}
        room, top = capacity, len(live)
        place = largest[live[-1]]
        while room and top:
            j = live[top - 1]
            while place >= begin[j] and left[place] == picks.get(place, 0):
                place -= 1
            if place >= begin[j] and sizes[place] <= room:
                k = min(left[place] - picks.get(place, 0), room // sizes[place])
                picks[place] = picks.get(place, 0) + k
                room -= k * sizes[place]
                continue
            # Nothing of this bucket fits any more; on to the next one whose bound does, or that holds the room.
            top = min(top - 1, bisect_right(live, bisect_right(bounds, room)))
            if top:
                place = largest[live[top - 1]]
                touched.add(live[top - 1])
        times = min(left[i] // k for i, k in picks.items())
        for i, k in picks.items():
            left[i] -= k * times
        out.append((list(picks.items()), times))
        for j in touched:
            while largest[j] >= begin[j] and not left[largest[j]]:
                largest[j] -= 1
    return out


class Layout:
    """Where the n-th item of each size goes, as sorted segments of ranks."""

    def __init__(self, sizes: list[int], counts: list[int], capacity: int, buckets: int):
        zero = counts[0] if sizes and sizes[0] == 0 else 0
        sizes, counts = (sizes[1:], counts[1:]) if sizes and sizes[0] == 0 else (sizes, counts)
        self.sizes = np.array(sizes, dtype=np.int64)
        self.bounds = bucket_bounds(sizes, counts, buckets) if sizes else []
        segments: list[tuple[int, int, int, int]] = []
        used, container = [0] * len(sizes), 0
        for batch, times in batch_patterns(sizes, counts, self.bounds, capacity):
            for i, k in batch:
                segments.append((i + 1, used[i], container, k))
                used[i] += k * times
            container += times
        if zero:  # items of no size take no room anywhere; they join the first container
            segments.append((0, 0, 0, zero))
            container = max(container, 1)
        segments.sort()
        self.containers = container
        self.first = np.cumsum([0, zero, *counts])  # flat rank of each size's first item; place 0 holds the items of no size
        self.start = np.array([self.first[b] + r for b, r, _, _ in segments], dtype=np.int64)
        self.base = np.array([c for _, _, c, _ in segments], dtype=np.int64)
        self.each = np.array([k for *_, k in segments], dtype=np.int64)

    def place(self, size: np.ndarray) -> np.ndarray:
        return np.where(size == 0, 0, np.searchsorted(self.sizes, size) + 1)

    def container(self, place: np.ndarray, rank: np.ndarray) -> np.ndarray:
        flat = self.first[place] + rank
        at = np.searchsorted(self.start, flat, side="right") - 1
        return self.base[at] + (flat - self.start[at]) // self.each[at]


def items_of(sizes: DataFrame, id_column: str, size_column: str, budgets: list[tuple[int, int]]) -> DataFrame:
    """``budget_id, <id>, piece, size``: each row once per budget, cut into pieces of the capacity if larger."""
    each = F.explode(F.array(*[F.struct(F.lit(int(b)).alias("budget_id"), F.lit(int(c)).alias("capacity")) for b, c in budgets]))
    size, cap = F.col("_size"), F.col("b.capacity")
    pieces = F.greatest(F.lit(1), F.ceil(size / cap).cast("long"))
    return (
        sizes.select(F.col(id_column).alias("_id"), F.greatest(F.coalesce(F.col(size_column), F.lit(0)), F.lit(0)).cast("long").alias("_size"))
        .select("_id", "_size", each.alias("b"))
        .select("_id", "_size", "b", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)).alias("piece"))
        .select(F.col("b.budget_id").cast("long").alias("budget_id"), F.col("_id").alias(id_column), "piece", F.least(cap, size - F.col("piece") * cap).cast("long").alias("size"))
    )


def fill_containers(sizes: DataFrame, id_column: str, size_column: str, budgets: list[tuple[int, int]], *, buckets: int = BUCKETS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``budget_id, container_id, <id>, piece, n_tokens``: every item of ``sizes`` in one container of each budget.

    ``budgets`` are (id, capacity) with capacities of at least 1. An item larger than a capacity is
    cut into pieces of the capacity and a rest; no other item is cut. Null and negative sizes count
    as 0 and take no room. Repeated rows are items of their own. No rows give no containers. ``sizes``
    is read twice, so hand in a table that is cheap to read again.
    """
    if not budgets or any(c is None or c < 1 for _, c in budgets):
        raise ValueError("every budget needs a capacity of at least 1")
    spark = sizes.sparkSession
    items = items_of(sizes, id_column, size_column, budgets)
    # At most capacity + 1 rows a budget.
    histogram: dict[int, list[tuple[int, int]]] = {int(b): [] for b, _ in budgets}
    for r in items.groupBy("budget_id", "size").agg(F.count(F.lit(1)).alias("n")).collect():
        histogram[r["budget_id"]].append((r["size"], r["n"]))
    layouts, most = {}, 0
    for b, capacity in budgets:
        h = sorted(histogram[int(b)])
        layouts[int(b)] = Layout([s for s, _ in h], [n for _, n in h], int(capacity), buckets)
        most = max([most, *(n for _, n in h)])
    shared = spark.sparkContext.broadcast(layouts)  # some numbers for each size up to the capacity

    kind = sizes.schema[id_column].dataType.simpleString()
    salts = 1 + most // group_rows
    group = ["budget_id", "size"] + ["salt"] * (salts > 1)
    placed = items
    if salts > 1:
        placed = placed.withColumn("salt", F.pmod(F.xxhash64(id_column, "piece"), F.lit(salts)))
    ranked = placed.withColumn("rank", (F.row_number().over(Window.partitionBy(*group).orderBy(id_column, "piece")) - 1).cast("long"))
    if salts > 1:
        before = Window.partitionBy("budget_id", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
        starts = placed.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).select(*group, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
        ranked = ranked.join(starts, group).withColumn("rank", F.col("rank") + F.col("start"))

    def to_container(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            budget, size, rank = (np.asarray(batch.column(i)) for i in (0, 3, 4))
            container = np.zeros(len(rank), dtype=np.int64)
            for b, layout in shared.value.items():
                at = budget == b
                if at.any():
                    container[at] = layout.container(layout.place(size[at]), rank[at])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(container), batch.column(1), batch.column(2), batch.column(3)], names=["budget_id", "container_id", id_column, "piece", "n_tokens"])

    return ranked.select("budget_id", id_column, "piece", "size", "rank").mapInArrow(to_container, f"budget_id long, container_id long, `{id_column}` {kind}, piece long, n_tokens long")
