import itertools
import random

import pytest

from tesserae.llm.packing import BUCKETS, Layout, batch_patterns, bucket_bounds, fill_containers


def _padding(sizes, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= s) - s) for s, c in zip(sizes, counts))


def test_bounds_are_optimal():
    rng = random.Random(1)
    for _ in range(60):
        sizes = sorted(rng.sample(range(1, 60), 8))
        counts = [rng.randrange(1, 9) for _ in sizes]
        k = rng.randrange(2, 8)
        found = bucket_bounds(sizes, counts, k)
        assert len(found) <= k and found[-1] == sizes[-1]
        best = min(_padding(sizes, counts, [*c, sizes[-1]]) for c in itertools.combinations(sizes[:-1], len(found) - 1))
        assert _padding(sizes, counts, found) == best


@pytest.mark.parametrize(("buckets", "group_rows"), [(128, 10**6), (5, 7)])
def test_every_item_once_and_no_container_overfull(spark, buckets, group_rows):
    rng = random.Random(2)
    rows = [(i, rng.choice([0, 3, 3, 3, rng.randrange(1, 70), rng.randrange(1, 400)])) for i in range(600)] + [(600, None), (601, 5), (601, 5)]
    got = fill_containers(spark.createDataFrame(rows, "doc_id long, n long"), "doc_id", "n", [(1, 64), (2, 300)], buckets=buckets, group_rows=group_rows).collect()
    for budget, cap in ((1, 64), (2, 300)):
        mine = [r for r in got if r.budget_id == budget]
        total, size = {}, {}
        for r in mine:
            total[r.container_id] = total.get(r.container_id, 0) + r.n_tokens
            size.setdefault(r.doc_id, []).append((r.piece, r.n_tokens))
        assert max(total.values()) <= cap
        assert sorted(total) == list(range(len(total)))
        for i, n in rows[:600]:
            pieces = sorted(size[i])
            assert [p for p, _ in pieces] == list(range(max(1, -(-n // cap))))
            assert sum(t for _, t in pieces) == n and all(t == cap for _, t in pieces[:-1])
        assert size[600] == [(0, 0)] and size[601] == [(0, 5), (0, 5)]
        if buckets > 100 and budget == 2:
            assert len(total) <= 1.1 * sum(total.values()) / cap + 1


def test_empty_and_wrong_budgets(spark):
    df = spark.createDataFrame([], "doc_id long, n long")
    assert fill_containers(df, "doc_id", "n", [(1, 8)]).count() == 0
    with pytest.raises(ValueError):
        fill_containers(df, "doc_id", "n", [(1, 0)])


def test_batches_hold_every_item_and_buckets_decide():
    rng = random.Random(4)
    for capacity in (37, 200, 1000):
        sizes = sorted(rng.sample(range(1, capacity + 1), min(capacity, 300)))
        counts = [rng.randrange(1, 300) for _ in sizes]
        used = {}
        for buckets in (1, 4, BUCKETS, 10**6):
            bounds = bucket_bounds(sizes, counts, buckets)
            held = [0] * len(sizes)
            for batch, times in batch_patterns(sizes, counts, bounds, capacity):
                assert times > 0 and sum(sizes[i] * k for i, k in batch) <= capacity
                for i, k in batch:
                    held[i] += k * times
            assert held == counts
            used[buckets] = Layout(sizes, counts, capacity, buckets).containers
        assert used[BUCKETS] <= used[4] <= used[1]
        # Close to first fit decreasing over every single size.
        assert used[BUCKETS] <= 1.02 * used[10**6] + 1
        if len(sizes) > BUCKETS:
            assert len(bucket_bounds(sizes, counts, BUCKETS)) <= BUCKETS < len(sizes)
