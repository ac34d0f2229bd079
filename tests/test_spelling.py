import itertools
import random

from tesserae.operators import spelling


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def close(names, least):
    found = {}
    for a, b in itertools.combinations(sorted(set(names)), 2):
        s = 1 - distance(a, b) / max(len(a), len(b))
        if s >= least:
            found[a, b] = round(s, 6)
    return found


def changed(rng, name):
    name = list(name)
    for _ in range(rng.randrange(1, 12)):
        i = rng.randrange(len(name) + 1)
        name[i : i + rng.randrange(2)] = rng.choice(["", "x", "é", "日", " "])
    return "".join(name)


def test_close_names(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK", 7)
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé日") for _ in range(rng.randrange(2, 7))) for _ in range(40)]
    base = [" ".join(rng.choices(words, k=rng.randrange(1, 7))) for _ in range(40)]
    names = {n for n in base + [changed(rng, rng.choice(base)) for _ in range(200)] if n} | {"a", "b", "ab", "abcde", "abcdx", "abcxx", "abcdefghij", "abcdefghxx", "xbcdefghix"}
    df = spark.createDataFrame([("g", n) for n in names] * 2 + [("h", "abcde"), ("h", "abcdy"), (None, "abcde"), ("g", None)], "g string, d string")
    got = spelling.close_names(df, "g", "d", 0.8).collect()
    want = {**close(names, 0.8), ("abcde", "abcdy"): 0.8}
    assert len(want) > 100 and want["abcde", "abcdx"] == 0.8 and want["abcdefghij", "abcdefghxx"] == 0.8
    assert len(got) == len(want) and {(r.a, r.b): r.similarity for r in got} == want


def test_common_ends(spark):
    rng = random.Random(9)
    names = {"é" * rng.randrange(0, 70) + "".join(rng.choices("ab日", k=rng.randrange(1, 6))) + "z" * rng.randrange(0, 50) for _ in range(120)}
    got = spelling.close_names(spark.createDataFrame([("g", n) for n in names], "g string, d string"), "g", "d", 0.8).collect()
    want = close(names, 0.8)
    assert len(got) == len(want) > 20 and {(r.a, r.b): r.similarity for r in got} == want


def test_few_names_are_compared(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randrange(3, 8))) for _ in range(200)]
    names = {"Auto: " + " ".join(rng.choices(words, k=rng.randrange(3, 8))) for _ in range(1500)}
    df = spark.createDataFrame([("Auto:", n) for n in names], "g string, d string")
    assert spelling.candidates(df, "g", "d", 0.8).count() < len(names) ** 2 / 2 * 0.05
