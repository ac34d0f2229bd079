import gzip
import json

from pyspark.sql import functions as F

from tesserae.functions import text
from tesserae.sources import files
from tesserae.streaming import jobs


def test_scan(spark, tmp_path):
    (tmp_path / "a/node_modules").mkdir(parents=True)
    (tmp_path / "a/x.py").write_text("x = 1")
    (tmp_path / "a/big.py").write_text("y" * 500)
    (tmp_path / "a/node_modules/z.py").write_text("z")
    (tmp_path / "r.md").write_text("hi")
    f = files.scan_files(spark, str(tmp_path), ignore=["**/node_modules/**"], max_bytes=100)
    assert sorted(r.path for r in f.collect()) == ["a/x.py", "r.md"]
    assert [r.path for r in files.scan_files(spark, str(tmp_path), only=["*.md", "*.txt"]).collect()] == ["r.md"]
    digest = f.where("path = 'r.md'").select("digest").collect()[0][0]
    assert bytes(files.content_if_unchanged(f, "r.md", digest).collect()[0][0]) == b"hi"
    assert files.content_if_unchanged(f, "r.md", "0").count() == 0


def test_git_log(spark, tmp_path):
    (tmp_path / "log").write_text("h1|Ann|a@x|2025-01-02T03:04:05Z|fix: a | b|HEAD\n\nbad line\nh2|Bob|b@x|nonsense|s|\n".replace("nonsense", "2025-01-03T00:00:00Z"))
    got = {r.hash: (r.author, r.subject, r.refs) for r in files.git_log(spark, str(tmp_path / "log")).collect()}
    assert got == {"h1": ("Ann", "fix: a | b", "HEAD"), "h2": ("Bob", "s", "")}


def test_event_stream_and_json_lines(spark, tmp_path):
    (tmp_path / "sse").write_text(': ping\ndata: {"a": 1}\n\nevent: x\ndata: {"a": 2}\ndata: broken\ndata: [DONE]\n')
    assert sorted(r.a or 0 for r in files.event_stream(spark, str(tmp_path / "sse"), "a int").collect()) == [0, 1, 2]
    (tmp_path / "n.json").write_text('{"a": 1}\n{"a": 2}\nnope\n')
    assert files.json_lines(spark, str(tmp_path / "n.json"), "a int").count() == 3


def test_backup_and_bundle(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, "c", "y")], "id int, n string, o string")
    files.backup(df, str(tmp_path / "b"))
    lines = [json.loads(x) for p in (tmp_path / "b").glob("*.json.gz") for x in gzip.open(p, "rt")]
    assert sorted(x["id"] for x in lines) == [1, 2, 3]
    assert sorted(map(tuple, files.restore(spark, str(tmp_path / "b"), df.schema).collect())) == sorted(map(tuple, df.collect()))
    bundle = files.export_bundle(df, "id", keys=[1, 2])
    new = files.import_bundle(bundle.union(bundle), df.where("id = 2"), "id", df.schema)
    assert [tuple(r) for r in new.collect()] == [(1, "a", None)]
    files.write_by_key(df, str(tmp_path / "p"), "n")
    assert spark.read.parquet(str(tmp_path / "p")).where("n = 'b'").count() == 1


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, "2025-01-01 00:00:00", "a"), (1, "2025-01-01 02:00:00", "b"), (2, "2025-01-01 00:30:00", "c")], "k long, t string, v string").withColumn("t", F.to_timestamp("t")).write.parquet(str(tmp_path / "e.parquet"))
    s = jobs.stream_table(spark, str(tmp_path), "e")
    out = jobs.run_to_table(jobs.latest_per_key(s.withColumn("at", F.unix_micros("t")), "k", ["at"], ["v"]), "update")
    assert {(r.k, r.v) for r in out.collect()} == {(1, "b"), (2, "c")}
    out = jobs.run_to_table(jobs.sessions(s, "t", "k", "1 hour", "1 day"), "complete")
    assert sorted((r.k, r.n) for r in out.collect()) == [(1, 1), (1, 1), (2, 1)]
    seen = []
    jobs.drain(s, lambda batch, number: seen.append(batch.count()))
    assert sum(seen) == 3


def test_text_functions(spark):
    one = lambda **c: spark.range(1).select(*[v.alias(k) for k, v in c.items()]).collect()[0].asDict()
    x = F.lit("// c\r\n  a = 1;\n\n  if (b && c) d(e);\n")
    got = one(n=text.normalised_code(x), c=text.cyclomatic_complexity(x), f=text.calls(x), s=text.human_size(F.lit(1536)), u=text.safe_file_name(F.lit("a:b/c ")), e=text.safe_file_name(F.lit(" ")), t=text.truncated(F.lit("abcdefgh"), 6), p=text.common_prefix(F.array(F.lit("a/b/c"), F.lit("a/b/d"))), v=text.template_names(F.lit("x ${{ a.b }} ${{c}}")), g=text.fill_template(F.lit("x ${{ a }}"), {"a": "$1"}), k=text.keep_trailing_lines(F.lit("aaaaaaaa\nbbbb\ncccc"), 2), z=text.name_similarity(F.lit(""), F.lit("")))
    assert got == {"n": "a = 1;\nif (b && c) d(e);", "c": 3, "f": ["d", "if"], "s": "1.5 KB", "u": "a_b_c", "e": "unnamed", "t": "abc...", "p": "a/b", "v": ["a.b", "c"], "g": "x $1", "k": "bbbb\ncccc", "z": 1.0}
    import re

    assert re.search(text.glob("**/tests/*.p?"), "a/tests/x.py") and not re.search(text.glob("*.py"), "a/x.py")
    canon = text.canonical_identifiers(["if"])
    df = spark.createDataFrame([("if x:\n  y(x)",), ("if a:\n b(a)",), (None,)], "t string").select(canon("t").alias("c"))
    assert [r.c for r in df.collect()] == ["if _V1_ : _V2_ ( _V1_ )"] * 2 + [None]
