"""Every core query against its SQL on the smallest tables."""

import glob
import importlib
import os

import pytest

import __spark_entry__

ROOT = "/root/testdata/sf0.001"
PLANS = [importlib.import_module(f"tesserae.plans.{p}") for p in __spark_entry__.PLANS]
NAMES = [(m, n) for m in PLANS for n in m.QUERIES]


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return "null" if v is None else str(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in glob.glob(f"{ROOT}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")
@pytest.mark.parametrize(("module", "name"), NAMES, ids=[n for _, n in NAMES])
def test_query(spark, duck, module, name):
    df = module.QUERIES[name](spark, ROOT)
    got = df.collect()
    if name not in module.SQL:
        return
    r = duck.execute(module.SQL[name])
    columns = [d[0] for d in r.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted(tuple(plain(x[columns.index(c)]) for c in sorted(columns)) for x in r.fetchall())
    assert sorted(tuple(plain(x[c]) for c in sorted(columns)) for x in got) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
