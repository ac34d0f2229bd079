from pyspark.sql import functions as F

from tesserae.llm.handwritten import content_kind, declared, declared_marks, not_handwritten, parse_attributes, path_keys, rule_key, rules_of

MADE = "\n".join(f"export function get_{w}(m) {{ return m.f[{i}].v{i * 77}; }}" for i, w in enumerate("abcdefghijklmnop"))
MINIFIED = "var a1=function(b,c){return b.delta>617?c(b,23):void 0};f3.prototype.lock=function(f){this.o31=f||{};for(var o=0;o<84;o++)this.rule[o]=!0};" * 9
OWN = "import os\n\ndef f(a):\n    # generated values are checked by hand\n    return a\n\nTABLE = [1, 2, 3]\n"


def test_globs_and_precedence():
    root = ("", "lib/** linguist-vendored\n*.gen.js linguist-generated=true\n/only.js linguist-generated\nd?c/[ab]*.py -linguist-vendored\n# c\nx text")
    deeper = ("lib/own", "*.js -linguist-vendored\n")
    assert declared("lib/a.js", [root, deeper]) is True
    assert declared("lib/own/a.js", [deeper, root]) is False
    assert declared("q/r/s.gen.js", [root]) is True and declared("q/only.js", [root]) is None and declared("only.js", [root]) is True
    assert declared("doc/abc.py", [root]) is False and declared("doc/cbc.py", [root]) is None
    assert declared("library/a.js", [root]) is None
    assert parse_attributes('"a b" linguist-vendored !linguist-generated') == [("a b", {"linguist-vendored": True, "linguist-generated": None})]


def test_content():
    assert content_kind("src/a.js", MADE) == "generated"
    assert content_kind("src/a.js", MINIFIED) == "minified"
    assert content_kind("a.py", "# Code generated by x-y v2. DO NOT EDIT.\nx = 1\n") == "generated"
    assert content_kind("a.ts", "// Was generated by x once, now maintained by us. DO NOT EDIT\nlet a = 1;") is None
    assert content_kind("a.ts", "// Do not modify the order: tests rely on it.\n") is None
    assert content_kind("a.js", "/*! some-lib v1.2.3 - (c) the some-lib authors, MIT licence */\nlet a;") == "vendored"
    assert content_kind("a.js", "// Copyright the Probe contributors. Terms in LICENSE.txt.\nlet a;") is None
    assert content_kind("a.py", "X = [\n" + "    1, 22, 133, 44,\n" * 100 + "]\n") == "data"
    assert content_kind("a.py", OWN) is None and content_kind("a.png", MINIFIED) is None and content_kind("a.js", "  ") is None


def test_table(spark):
    rows = [(1, "vendor/x/a.py", OWN), (2, "src/vendors/a.py", OWN), (3, "src/a.js", MADE), (4, "a/package-lock.json", "{}"), (5, "b.py", None), (6, "vendor/b.png", "zz"), (7, "vendor/e.py", ""), (8, None, OWN), (9, "src/own.js", MADE), (10, "src/mark.py", OWN), (3, "src/a.js", MADE)]
    rows += [(100 + i, f"r{i}/__made__/f.js", MADE) for i in range(40)] + [(200, "z/__made__/g.js", OWN)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, path string, t string, reason string")
    homes = spark.createDataFrame([(i, "w" if i in (9, 10) else "v") for i in (1, 9, 10)], "id long, workspace string")
    marks = spark.createDataFrame([("w", "", "src/own.js -linguist-generated\nsrc/mark.py linguist-generated")], "workspace string, folder string, text string")
    got = {r.id: r.reason for r in not_handwritten(df, "id", "path", "t", homes, marks).collect()}
    want = {1: "pattern", 3: "generated", 4: "pattern", 10: "declared", 200: "folder"} | {100 + i: "generated" for i in range(40)}
    assert got == want
    assert not_handwritten(df.limit(0), "id", "path", "t").count() == 0


RULES = [
    ("a", "", "lib/** linguist-vendored\n*.gen.js linguist-generated=true\n/only.js linguist-generated\nd?c/[ab]*.py -linguist-vendored\n*stub* linguist-generated"),
    ("a", "lib/own", "*.js -linguist-vendored\nkeep.py !linguist-vendored"),
    ("b", "", "lib/** linguist-vendored\n*.gen.js linguist-generated\n*.js linguist-vendored\nstubs/** linguist-generated"),
    ("c", "", "*.gen.js -linguist-generated\nstubs/** linguist-generated\n*.js linguist-vendored"),
]
PATHS = ["lib/a.js", "lib/own/a.js", "lib/own/keep.py", "q/r/s.gen.js", "q/only.js", "only.js", "doc/abc.py", "doc/cbc.py", "library/a.js", "x/my-stub-1.rs", "stubs/a.py", "a", ".hidden"]


def test_rules_joined_by_key_resolve_like_one_by_one(spark):
    files = spark.createDataFrame([(w, p) for w in "abcd" for p in PATHS], "workspace string, _path string")
    rules = rules_of(spark.createDataFrame(RULES, "workspace string, folder string, text string"))
    got = {(r.workspace, r["_path"]): r.mark for r in declared_marks(files, rules).collect()}
    want = {(w, p): m for w in "abcd" for p in PATHS if (m := declared(p, [(f, t) for v, f, t in RULES if v == w])) is not None}
    assert got == want


def test_keys(spark):
    assert [rule_key(g) for g in ("*.pb.go", "go.sum", "vendor/**", "src/*/gen_*.py", "*gen*", "/a/b.c")] == ["s:.pb.go", "n:go.sum", "d:vendor", "d:src", "*", "n:b.c"]
    df = spark.createDataFrame([("a/b/x.pb.go",), ("x",), ("",)], "p string")
    assert [set(r[0]) for r in df.select(path_keys(F.col("p"))).collect()][0] == {"*", "n:x.pb.go", "s:.pb.go", "s:.go", "d:a", "d:b"}


def test_mined_rules_reach_repositories_that_declare_nothing(spark):
    own = "import os\n\ndef f(a):\n    return a\n"
    rows = [(1, "stubs/new.py"), (2, "q/w.gen.js"), (3, "src/a.js"), (4, "src/stubs.py"), (5, "stubs/b.py"), (6, "lib/z.py")]
    df = spark.createDataFrame([(i, p, own) for i, p in rows], "id long, path string, t string")
    homes = spark.createDataFrame([(1, "d"), (2, "d"), (3, "d"), (4, "d"), (5, "b"), (6, None)], "id long, workspace string")
    got = {r.id: r.reason for r in not_handwritten(df, "id", "path", "t", homes, spark.createDataFrame(RULES, "workspace string, folder string, text string")).collect()}
    # *.gen.js is disputed, *.js too general; lib/** is declared by two repositories and holds for unknown ones too.
    assert got == {1: "mined", 5: "declared", 6: "mined"}


def test_marks_anywhere_and_in_any_language():
    assert content_kind("a.js", "// " + "x" * 900 + "\n\n/*! some-lib v1.2.3 - (c) the some-lib authors, MIT licence */\nlet a;") == "vendored"
    assert content_kind("a.sql", "-- Code generated by x-y v2. DO NOT EDIT.\nselect 1;\n") == "generated"
    assert content_kind("a.lua", "local a = 1\n" * 200 + "-- Code generated by x-y v2. DO NOT EDIT.\n") == "generated"
    assert content_kind("a.md", "# Code generated by x-y\nHow to read it. DO NOT EDIT files by hand.\n") is None
