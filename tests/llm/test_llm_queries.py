"""The fixed columns of the queries, and the core without this package's queries in it."""

import os

import pytest

from tesserae.llm.queries import QUERIES, SQL

ROOT = "/root/testdata/sf0.001"
COLUMNS = {
    "p2_found": [("file_change_id", "bigint"), ("side", "string"), ("line_no", "bigint")],
    "p3_found": [("id_a", "bigint"), ("id_b", "bigint")],
    "p4_found": [("id_a", "bigint"), ("id_b", "bigint")],
    "p5_found": [("file_change_id", "bigint")],
    "p6_found": [("file_change_id", "bigint")],
    "p7_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
    "p9_found": [("doc_id", "bigint")],
}


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_distinct_rows(spark, name):
    df = QUERIES[name](spark, ROOT)
    if name in COLUMNS:
        assert df.dtypes == COLUMNS[name]
    rows = [str(r) for r in df.collect()]
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))
    assert set(SQL) <= set(QUERIES)
