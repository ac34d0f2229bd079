import random

from pyspark.sql import functions as F

from tesserae.operators import graph, structure

CODE = """import os

class Base:
    def __init__(self, a, b=1):
        self.size_of = a
        self.rest_of = b

    def get_size(self):
        return compute(self.size_of)

def outer(x):
    if x:
        return helper(x)
        dead_line = 1
    total_sum = 0
    for i in x:
        total_sum = total_sum + i
    return total_sum
"""


def test_definitions(spark):
    df = structure.with_definitions(spark.createDataFrame([(1, CODE, "z"), (2, None, "z"), (3, "", "z")], "id int, t string, definitions2 string"), "t")
    d = {r.name: r for r in df.select("id", F.explode("definitions").alias("d")).select("d.*").collect()}
    assert set(d) == {"Base", "__init__", "get_size", "outer"}
    assert (d["Base"].kind, d["Base"].line_no, d["Base"].end_line, d["Base"].fields) == ("class", 3, 10, ["size_of", "rest_of"])
    assert (d["__init__"].parent, d["__init__"].n_params, d["__init__"].is_public) == ("Base", 2, False)
    assert d["outer"].parent is None and d["outer"].calls == ["helper"] and d["get_size"].calls == ["compute"]


def test_flow(spark):
    df = spark.createDataFrame([(1, CODE)], "id int, t string")
    e = {tuple(r) for r in structure.with_flow(df, "t").select(F.explode("flow").alias("e")).select("e.*").collect()}
    assert (12, 13, "next") in e and (12, 15, "skip") in e and not any(s == 13 for s, _, _ in e)
    s = df.select(F.explode(structure.statements(F.col("t"))).alias("s")).select("s.*")
    assert {(r.line_no, r.target) for r in s.where("target <> ''").collect()} >= {(14, "dead_line"), (15, "total_sum"), (17, "total_sum")}
    assert s.where("line_no = 17").first().reads == ["total_sum"]


def test_shortest_paths(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "x"), ("x", "c"), ("c", "a"), ("c", "d"), (None, "a"), ("q", None)], "s string, t string")
    p = spark.createDataFrame([("a", "d"), ("d", "a"), ("a", "a"), ("q", "z"), (None, "a"), ("a", "c")], "f string, g string")
    got = {(r.f, r.g): r.path for r in graph.shortest_paths(e, "s", "t", p, "f", "g").collect()}
    assert got == {("a", "d"): ["a", "b", "c", "d"], ("a", "a"): ["a"], ("a", "c"): ["a", "b", "c"]}


def shortest(edges, a, b):
    """The least of the shortest ways by levels, or none."""
    ways, seen = {a: [a]}, {a}
    while ways and b not in ways:
        new = {}
        for s, d in edges:
            if s in ways and d not in seen:
                new[d] = min(new.get(d, ["~"]), ways[s] + [d])
        ways, seen = new, seen | set(new)
    return ways.get(b)


def test_shortest_paths_mixed(spark):
    rng = random.Random(6)
    # Trees of parents, a circle with tails, a loop, and ways that part.
    edges = [(f"t{i:02}", f"t{rng.randrange(max(0, i - 3), i):02}") for i in range(1, 40)] + [(f"c{i}", f"c{(i + 1) % 5}") for i in range(5)] + [("u0", "u1"), ("u1", "c3"), ("l", "l")]
    edges += [("t00", "w0"), ("t00", "w1"), ("w0", "w2"), ("w1", "w2"), ("w2", "w3"), ("w3", "w1")]
    names = sorted({n for e in edges for n in e}) + ["none"]
    pairs = {(rng.choice(names), rng.choice(names)) for _ in range(700)} | {("u0", "c2"), ("c4", "c3"), ("t39", "w3"), ("w1", "w3"), ("c1", "u1"), ("l", "l"), ("none", "none"), ("t00", "none")}
    got = graph.shortest_paths(spark.createDataFrame(edges, "s string, t string"), "s", "t", spark.createDataFrame(sorted(pairs), "f string, g string"), "f", "g").collect()
    want = {p: w for p in pairs if (w := shortest(edges, *p))}
    assert len(got) == len(want) > 100 and {(r.f, r.g): r.path for r in got} == want


def test_shortest_paths_rounds(spark, monkeypatch):
    calls, whole = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df: calls.append(1) or whole(df))
    e = spark.createDataFrame([(i, i + 1) for i in range(70)], "s long, t long")
    p = spark.createDataFrame([(0, 70), (3, 68), (70, 0)], "f long, g long")
    got = {(r.f, r.g): r.path for r in graph.shortest_paths(e, "s", "t", p, "f", "g").collect()}
    assert got == {(0, 70): list(range(71)), (3, 68): list(range(3, 69))}
    assert len(calls) < 20  # a round a step would be 70
