import random

import pytest

from tesserae.llm import spans


def _brute(rows, span):
    windows = {}
    for i, label, *texts in rows:
        for side, t in enumerate(texts):
            for at in range(len(t or "") - span + 1):
                windows.setdefault(t[at : at + span], set()).add((i, label or "", side, at))
    pairs, cover = set(), {}
    for w in windows.values():
        for a in w:
            for b in w:
                if a[1] != b[1]:
                    cover.setdefault((a[0], a[2]), set()).update(range(a[3], a[3] + span))
                    if a[0] < b[0]:
                        pairs.add((a[0], b[0]))
    return pairs, {k: len(v) for k, v in cover.items()}


def _rows(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdé\n漢 \U0001f600xyz") for _ in range(n))
    pool = [word(n) for n in (38, 39, 40, 41, 60, 90, 200)] + ["a" * 95, "ab" * 30, "a" * 40]
    rows = []
    for i in range(120):
        text = lambda: "".join(rng.choice([word(rng.randrange(1, 30)), rng.choice(pool)]) for _ in range(rng.randrange(0, 5)))
        rows.append((i, rng.choice(["p", "q", "r", "s", None]), rng.choice([None, "", text()]), text()))
    return [*rows, rows[3], rows[4]]


@pytest.mark.parametrize(("seed", "group"), [(1, 64), (2, 3), (3, 10_000)])
def test_pairs_and_coverage_equal_brute_force(spark, seed, group):
    rows = _rows(seed)
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id long, path string, o string, n string, h string")
    pairs, cover = _brute(rows, 40)
    got = [(r.id_a, r.id_b) for r in spans.shared_span_pairs(df, "id", "path", ["o", "n"], span=40, k=16, group=group, block=5 + group).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs
    shared = {(r.id, "on".index(r.side)): r.shared_chars for r in spans.shared_coverage(df, "id", "path", ["o", "n"], span=40, k=16, group=group).collect()}
    assert shared == cover


def test_empty(spark):
    df = spark.createDataFrame([], "id long, path string, o string, n string")
    assert spans.shared_span_pairs(df, "id", "path", ["o", "n"]).count() == 0


def test_one_header_in_a_third_of_the_rows(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    header = word(300)
    rows = [(i, "one" if i % 2 else f"p{i % 7}", None, header + word(80)) for i in range(150)] + [(1000 + i, f"q{i}", None, word(300)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, path string, o string, n string")
    want = {(a[0], b[0]) for a in rows[:150] for b in rows[:150] if a[0] < b[0] and a[1] != b[1]}
    for group in (2048, 20):
        got = [(r.id_a, r.id_b) for r in spans.shared_span_pairs(df, "id", "path", ["o", "n"], group=group, block=40).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert {r.shared_chars for r in spans.shared_coverage(df, "id", "path", ["o", "n"]).collect()} <= set(range(300, 305))


def test_runs_of_one_letter_have_few_anchors():
    _, pos, _ = spans.anchors(["xyz" * 40 + "a" * 20_000 + "qrs" * 40], 64, 137)
    assert len(pos) < 1000
