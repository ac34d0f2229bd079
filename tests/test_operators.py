import random

import pytest
from pyspark.sql import functions as F

from tesserae.operators import clones, graph, history, ranking, rollups, snapshots
from tesserae.operators.components import connected_components
from tesserae.operators.latest import keep_newest, latest_per_key, surviving


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_latest_per_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 3, "z"), ("b", None, "n"), (None, 2, "q")], "k string, t int, v string")
    assert rows(latest_per_key(df, ["k"], ["t", "v"], ["v"])) == rows(spark.createDataFrame([("a", "z"), ("b", "n"), (None, "q")], "k string, v string"))
    assert [r.v for r in keep_newest(df, [F.desc_nulls_last("t"), F.asc("v")], 2).collect()] == ["y", "z"]
    assert surviving(df, "k", spark.createDataFrame([("a",), (None,)], "d string"), "d").count() == 2


@pytest.mark.parametrize("parts", ["1", "7"])
def test_previous_rows_cross_ranges(spark, parts):
    rng = random.Random(4)
    data = [(rng.choice(["hot"] * 6 + ["a", "b", None]), i, rng.randrange(9)) for i in range(400)]
    rng.shuffle(data)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r.i: r.prev_v for r in history.previous_rows(spark.createDataFrame(data, "k string, i int, v int"), "k", ["i"], ["v"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want, last = {}, {}
    for k, i, v in sorted(data, key=lambda r: r[1]):
        want[i] = last.get(k)
        last[k] = v
    assert got == want


def test_trends(spark):
    data = [(s, i, float(v)) for s, vs in {"up": [1, 2, 3, 4, 5], "down": [5, 4, 3, 2, 1], "flat": [3] * 5, "few": [1, 2], "wild": [1, 5, 1, 5, 1]}.items() for i, v in enumerate(vs)]
    got = {r.s: (r.direction, r.rate) for r in history.trend(spark.createDataFrame(data, "s string, i int, v double"), "s", "i", "v", 5).collect()}
    assert got == {"up": ("increasing", 4.0), "down": ("decreasing", -0.8), "flat": ("stable", 0.0), "wild": ("volatile", 0.0)}


def test_islands_and_scores(spark):
    df = spark.createDataFrame([("k", 1, 4, 1), ("k", 2, 3, 2), ("k", 9, 9, 3), ("k", 20, 21, 4), ("j", 1, 1, 5)], "k string, b int, e int, id int")
    assert rows(history.islands(df, "k", "b", "e", 5, "id")) == [("j", 1, 1, 1), ("k", 1, 9, 3), ("k", 20, 21, 1)]
    s = spark.createDataFrame([("k", 1, 0.9), ("k", 2, -0.3), ("k", 3, -0.9)], "k string, t int, d double")
    assert rows(history.clamped_score(s, "k", ["t"], F.col("d"))) == [("k", 0.0)]


def test_rollups_on_nothing(spark):
    e = spark.createDataFrame([], "x string, n int")
    assert rollups.success_rate(e, F.lit(True), [F.asc("x")], 5, 1.0).collect()[0][0] == 1.0
    assert rollups.peakiness(e, "x").collect()[0][0] == 0.0
    assert tuple(rollups.content_sharing(e, "x", "n").collect()[0]) == (0, 0, 0, 0, 0, 1.0)


def test_snapshots(spark):
    s = lambda d: spark.createDataFrame(list(d.items()), "p string, h string")
    b, a = s({"x": "1", "y": "2", "z": None}), s({"y": "3", "w": "4", "z": None})
    assert rows(snapshots.snapshot_diff(b, a, "p", "h")) == [("w", "created"), ("x", "deleted"), ("y", "modified")]
    base, left, right = s({"a": "0", "b": "0", "e": "0"}), s({"a": "1", "b": "2", "c": "3", "d": "5"}), s({"a": "1", "b": "9", "d": "6", "f": "7"})
    got = {r.p: (r.outcome, r.digest) for r in snapshots.three_way_merge(base, left, right, ["p"], "h").collect()}
    assert got == {"a": ("same", "1"), "b": ("conflict_both_modified", "0"), "c": ("source", "3"), "d": ("conflict_both_created", None), "e": ("base_only", "0"), "f": ("target", "7")}


def test_chains_have_no_longest_length(spark):
    n = spark.createDataFrame([(i, i - 1 if i else None, i == 3) for i in range(44)], "id int, up int, full boolean")
    got = snapshots.chains(n, "id", "up", "full").where("node = 43").collect()
    assert sorted((r.depth, r.ancestor) for r in got) == [(d, 43 - d) for d in range(41)]
    with pytest.raises(RuntimeError):
        snapshots.chains(spark.createDataFrame([("x", "y", False), ("y", "x", False)], "id string, up string, full boolean"), "id", "up", "full")


def test_chains_stop_at_ends_and_unknown_parents(spark):
    n = spark.createDataFrame([("a", None, True), ("b", "a", False), ("c", "b", None), ("q", "nowhere", False), ("f", "c", True)], "id string, up string, full boolean")
    c = snapshots.chains(n, "id", "up", "full")
    by = {}
    for r in c.collect():
        by.setdefault(r.node, []).append((r.depth, r.ancestor))
    assert sorted(by["c"]) == [(0, "c"), (1, "b"), (2, "a")] and by["f"] == [(0, "f")] and by["q"] == [(0, "q")]
    ch = spark.createDataFrame([("b", 1, "p", "h1", False), ("c", 2, "p", "h2", False), ("a", 3, "z", "h3", False), ("c", 4, "z", None, True)], "node string, i int, path string, h string, gone boolean")
    state = snapshots.replay(c, ch, "node", "path", ["i"], ["h"], F.col("gone"))
    assert {(r.path, r.h) for r in state.where("node = 'c'").collect()} == {("p", "h2")}
    assert {(r.path, r.h) for r in state.where("node = 'b'").collect()} == {("p", "h1"), ("z", "h3")}


def test_common_ancestors_through_full_snapshots_and_long_chains(spark):
    rng = random.Random(6)
    up = {i: i - 1 for i in range(1, 80)} | {i: rng.randrange(i) for i in range(80, 120)} | {0: None, 200: None, 201: 200, 202: 201, 300: 999}

    def above(n):
        return [n, *(above(up[n]) if up.get(n) in up else [])]

    pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(200)] + [(79, 0), (0, 79), (5, 5), (79, 202), (202, 0), (201, 202), (300, 300), (300, 1), (1, 777), (None, 1)]
    want = set()
    for a, b in pairs:
        both = [(above(a).index(n) + above(b).index(n), n) for n in above(a) if n in above(b)] if a in up and b in up else []
        want |= {(a, b, n, d) for d, n in both[:1]}
    nodes = spark.createDataFrame([(n, p, n % 5 == 0) for n, p in up.items()], "id int, up int, full boolean")
    got = snapshots.common_ancestors(nodes, "id", "up", spark.createDataFrame(pairs, "l int, r int"), "l", "r")
    assert rows(got.select("l", "r", "ancestor", "distance")) == sorted(want, key=str)


def _closure(edges):
    reach = {a: {b for x, b in edges if x == a} for a, _ in edges}
    while True:
        more = {a: bs | {c for b in bs for c in reach.get(b, ())} for a, bs in reach.items()}
        if more == reach:
            return reach
        reach = more


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(34)] + [(3, 3), (7, 7)]
    df = spark.createDataFrame(edges, "s int, d int")
    reach = _closure(edges)
    strong = {}
    for a in reach:
        mates = {b for b in reach[a] if a in reach.get(b, ())} | {a}
        if len(mates) > 1:
            strong[a] = min(mates)
    assert {r.node: r.component for r in graph.strong_components(df, "s", "d").collect()} == strong
    undirected = _closure([(a, b) for a, b in edges if a != b] + [(b, a) for a, b in edges if a != b])
    assert {r.node: r.component for r in connected_components(df, "s", "d").collect()} == {a: min(bs | {a}) for a, bs in undirected.items()}


def test_graph_small(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "s string, d string")
    assert rows(graph.degrees(e, "s", "d").select("node", "n_out", "n_in", "n_neighbours")) == [("a", 2, 1, 2), ("b", 1, 2, 2), ("c", 2, 1, 3), ("d", 0, 1, 1)]
    assert rows(graph.reachable(e, spark.createDataFrame([("a",)], "x string"), "s", "d", 2)) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2)]
    assert rows(graph.simple_paths(e, "s", "d", 3)) == [(["a", "b", "c", "d"],)]
    assert graph.strong_components(e.limit(0), "s", "d").count() == 0 and connected_components(e.limit(0), "s", "d").count() == 0
    assert rows(graph.inheritance_depth(spark.createDataFrame([("x", "y"), ("y", "z"), ("x", "z")], "c string, p string"), "c", "p")) == [("x", 2), ("y", 1)]


def test_inheritance_depth_of_long_chains_and_cycles(spark):
    rng = random.Random(3)
    up = [(i, i + 1) for i in range(150)] + [(i, rng.randrange(i + 1, 230)) for i in range(200, 229)] + [(205, 100), (3, 90)]
    want = {}
    for i in [*reversed(range(200)), *reversed(range(200, 230))]:
        want |= {i: 1 + max(want.get(p, 0) for c, p in up if c == i)} if any(c == i for c, _ in up) else {}
    assert want[0] == 150
    assert {r.node: r.depth for r in graph.inheritance_depth(spark.createDataFrame(up, "c int, p int"), "c", "p").collect()} == want
    with pytest.raises(RuntimeError):
        graph.inheritance_depth(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 1)], "c int, p int"), "c", "p")
    assert graph.inheritance_depth(spark.createDataFrame([], "c int, p int"), "c", "p").count() == 0


def test_budget_and_diversity(spark):
    df = spark.createDataFrame([("g", 1, 0.9, 50), ("g", 2, 0.8, 60), ("g", 3, 0.7, 40), ("g", 4, 0.6, None), ("h", 5, 0.1, 10)], "g string, id int, s double, c long")
    assert rows(ranking.fill_budget(df, "g", "s", "c", "id", 100).select("id", "taken_before")) == [(1, 0), (3, 50), (4, 90), (5, 0)]
    d = spark.createDataFrame([("g", 1, 0.9, ["a", "b"]), ("g", 2, 0.8, ["a", "b"]), ("g", 3, 0.7, ["c"]), ("g", 4, 0.6, None)], "g string, id int, s double, w array<string>")
    assert rows(ranking.diverse(d, "g", "s", "id", "w", 5, 0.7).select("id")) == [(1,), (3,), (4,)]
    assert ranking.fill_budget(df.limit(0), "g", "s", "c", "id", 100).count() == 0


def test_search(spark):
    keys = spark.createDataFrame([("ab", 1), ("abc", 2), ("x", 3)], "k string, v int")
    assert rows(ranking.longest_prefix(spark.createDataFrame([("abcd",), ("abx",), ("q",), ("",), (None,)], "p string"), "p", keys, "k", "v", 5)) == [("abcd", "abc", 2), ("abx", "ab", 1)]
    t = spark.createDataFrame([(1, "restore"), (2, "restored"), (3, "zzz"), (4, None)], "id int, t string")
    assert [r.id for r in ranking.trigram_search(t, "id", "t", "restore", 0.5).orderBy("id").collect()] == [1, 2]


def test_clones(spark):
    body = "\n".join(f"line {i}" for i in range(8))
    df = spark.createDataFrame([(1, body), (2, "// c\n" + body.replace("\n", "  \n\n")), (3, "short"), (4, None)], "id int, t string")
    w = clones.line_windows(df.select("id", clones.window_hashes("t", 6).alias("h6")), "id", "h6")
    assert {(r.n_places, r.n_files) for r in clones.exact_clones(w, "id").collect()} == {(2, 2)}
    assert rows(clones.duplication(w, "id", clones.exact_clones(w, "id"))) == [(1, 3, 3, 1.0), (2, 3, 3, 1.0)]


def overlaps(sets, least):
    o = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a in sets for b in sets if a < b}
    return {k: v for k, v in o.items() if v > least}


@pytest.mark.parametrize("least", [0.0, 0.3, 0.5, 0.6])
def test_directory_overlap(spark, monkeypatch, least):
    monkeypatch.setattr(clones, "BLOCK", 5)
    rng = random.Random(8)
    sets = {f"k{i:03}": set(rng.choices(["src", "lib", "", *[f"d/{j}" for j in range(12)]], [9, 5, 3] + [1] * 12, k=rng.randrange(1, 8))) for i in range(150)}
    data = [(k, f"{d}/f{n}.py".lstrip("/")) for k, s in sets.items() for d in s for n in range(2)] + [(None, "src/a"), ("k000", None)]
    got = clones.directory_overlap(spark.createDataFrame(data, "k string, p string"), "k", "p", least).collect()
    want = overlaps(sets, least)
    assert len(got) == len(want) > 100 and {(r.a, r.b): r.overlap for r in got} == want


def test_directory_overlap_misses_no_pair(spark):
    # Twelve least hashes found none of these pairs, though they share four of seven folders.
    data = [(2 * i + side, f"d{i}/{w}/f.py") for i in (22724, 32316, 36602) for side, ws in enumerate(["abcdef", "abcdx"]) for w in ws]
    got = clones.directory_overlap(spark.createDataFrame(data, "k long, p string"), "k", "p", 0.5)
    assert rows(got) == [(45448, 45449, 0.571429), (64632, 64633, 0.571429), (73204, 73205, 0.571429)]
