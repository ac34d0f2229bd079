from datetime import datetime

from pyspark.sql import functions as F

from tesserae.operators.integrity import Reference, orphan_report, orphans

D = lambda d: datetime(2025, 1, d)


def _frames(spark, children, parents):
    c = spark.createDataFrame(children, "id string, session_id string, ingested_at timestamp, created_at timestamp, key string, is_parent int")
    p = spark.createDataFrame(parents, "id string, ingested_at timestamp, deleted boolean, record_id string, ref_table string")
    return [Reference("t", c, "id", "session_id", "ingested_at", "created_at", p, "id", "ingested_at", F.col("deleted"))]


def test_cases(spark):
    children = [
        ("a", "P1", D(5), D(2), "x", 0),
        ("b", " p1 ", D(1), D(2), "x", 0),  # arrived before its parent
        ("b", "p1", D(9), D(2), "x", 0),
        ("c", "gone", D(5), D(2), "x", 0),
        ("d", None, D(5), D(2), "x", 0),
        ("e", "  ", D(5), D(2), "x", 0),
        ("f", "dead", D(5), None, "x", 0),
        ("g", "p1", None, D(2), "x", 0),
        ("c", "GONE", D(6), D(3), "x", 0),
        (None, "gone", D(5), D(2), "x", 0),
    ]
    parents = [("p1", D(3), False, "r", "s"), ("P1 ", D(8), None, "r", "s"), ("dead", D(1), False, "r", "s"), ("dead", D(9), True, "r", "s"), (None, D(1), False, "r", "s"), ("late", None, None, "r", "s")]
    refs = _frames(spark, children, parents)
    got = {(r.record_id, r.reason) for r in orphans(refs).collect()}
    assert got == {("b", "late"), ("c", "missing"), ("f", "deleted")}
    report = {(r.period, r.reason, r.n_records) for r in orphan_report(orphans(refs)).collect()}
    assert report == {("2025-01-01", "late", 1), ("2025-01-01", "missing", 1), (None, "deleted", 1)}


def test_empty_tables(spark):
    assert orphans(_frames(spark, [], [])).count() == 0
    assert orphans(_frames(spark, [("a", "x", D(1), D(1), "k", 0)], [])).count() == 1
    assert orphans(_frames(spark, [], [("x", D(1), False, "r", "s")])).count() == 0


def test_one_key_holds_most_rows(spark):
    for hot in (10, 10**6):
        _one_key_holds_most_rows(spark, hot)


def _one_key_holds_most_rows(spark, hot):
    children = [(str(i), "hot" if i % 3 else f"k{i}", D(2), D(2), "x", 0) for i in range(3000)]
    assert orphans(_frames(spark, children, [("k0", D(1), False, "r", "s")]), hot_children=hot).count() == 2999
