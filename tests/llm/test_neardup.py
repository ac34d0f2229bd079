import random
import re

import pytest

from tesserae.llm import neardup


def _triples(t):
    w = re.findall("[a-z0-9_]+", t.lower())
    return set(zip(w, w[1:], w[2:])) if len(w) >= 30 else set()


def _brute(rows):
    sets = {i: (p or "", _triples(t)) for i, p, t in rows if t and i is not None}
    return {(a, b) for a, (pa, sa) in sets.items() for b, (pb, sb) in sets.items() if a < b and pa != pb and sa and sb and 10 * len(sa & sb) >= 7 * len(sa | sb)}


def _rows(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Éa", "K_x", "import", "def", "return"]
    rows, boiler = [], "import os def main return zero else one two three four five six seven eight nine ten "
    for base in range(40):
        text = [rng.choice(words) for _ in range(rng.randrange(25, 200))]
        for _ in range(rng.randrange(1, 5)):
            copy = list(text)
            for _ in range(rng.randrange(0, 1 + len(text) // 22)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), rng.choice(["a", "b", "c", None]), boiler * rng.randrange(0, 2) + rng.choice([" ", "\r\n", "--"]).join(copy)))
    return [*rows, (900, "z", None), (901, "z", ""), (902, "y", "one " * 10), (903, "x", "one " * 50), (904, "y", "one " * 60), rows[0], rows[1], (None, "q", rows[0][2])]


@pytest.mark.parametrize(("bucket", "seed"), [(24, 1), (2, 2)])
def test_pairs(spark, monkeypatch, bucket, seed):
    monkeypatch.setattr(neardup, "BUCKET", bucket)
    rows = _rows(seed)
    df = spark.createDataFrame([(*r, 1) for r in rows], "id long, path string, new_content string, n long")
    want = _brute(rows)
    got = [(r.id_a, r.id_b) for r in neardup.near_duplicate_pairs(df, "id", "path", "new_content").collect()]
    assert len(got) == len(set(got)) and set(got) <= want
    assert len(got) >= 0.98 * len(want) > 30


def test_a_third_of_the_rows_is_one_family(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    family = [rng.choice(words) for _ in range(120)]
    rows = []
    for i in range(90):
        copy = list(family)
        copy[rng.randrange(120)] = f"x{i}"
        rows.append((i, "same" if i > 3 else f"other{i}", " ".join(copy)))
    rows += [(100 + i, "p", " ".join(rng.choice(words) for _ in range(100))) for i in range(150)]
    got = {(r.id_a, r.id_b) for r in neardup.near_duplicate_pairs(spark.createDataFrame(rows, "id long, path string, t string"), "id", "path", "t").collect()}
    assert got == _brute(rows) and len(got) > 300


@pytest.mark.parametrize("block", [3, 4096])
def test_blocks_hold_all_pairs_of_large_buckets(spark, monkeypatch, block):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    family = [rng.choice(words) for _ in range(90)]
    rows = []
    for i in range(60):
        copy = list(family)
        copy[rng.randrange(90)] = f"x{i}"
        rows.append((i, f"p{i % 4}", " ".join(copy)))
    monkeypatch.setattr(neardup, "BUCKET", 4)
    monkeypatch.setattr(neardup._crowded_pairs, "__defaults__", (block,))
    got = {(r.id_a, r.id_b) for r in neardup.near_duplicate_pairs(spark.createDataFrame(rows, "id long, path string, t string"), "id", "path", "t").collect()}
    assert got == _brute(rows) and len(got) > 1000


def test_groups_count_links_without_writing_pairs(spark):
    rows = _rows(3)
    copies = [(2000 + i, f"c{i % 3}", rows[5][2]) for i in range(40)]
    rows += copies
    want = _brute(rows)
    n, leader = {}, {}
    for a, b in want:
        n[a], n[b] = n.get(a, 0) + 1, n.get(b, 0) + 1
        leader.setdefault(a, a), leader.setdefault(b, b)
    for _ in range(60):
        for a, b in want:
            leader[a] = leader[b] = min(leader[a], leader[b])
    df = spark.createDataFrame([(*r, 1) for r in rows], "id long, path string, new_content string, n long")
    got = {r.id: (r.group_id, r.n_links) for r in neardup.near_duplicate_groups(df, "id", "path", "new_content").collect()}
    assert got == {i: (leader[i], n[i]) for i in n}


def test_estimate():
    assert neardup.estimated_recall(0, 0, 0, 8) == 1.0 and neardup.estimated_recall(1000, 0, 5, 8) == 1.0
    assert neardup.estimated_recall(1000, 40, 10, 8) < 0.95


def test_empty(spark):
    assert neardup.near_duplicate_pairs(spark.createDataFrame([], "id long, path string, t string"), "id", "path", "t").count() == 0


def test_one_token_of_millions_of_letters():
    long = "ab12" * 1_100_000
    row, h = neardup.triples([f"one two {long} three", f"one two {long}x three", f"one two {long} three"], 3)
    sets = [set(h[row == i].tolist()) for i in range(3)]
    assert sets[0] == sets[2] and len(sets[0]) == 2 and not sets[0] & sets[1]
