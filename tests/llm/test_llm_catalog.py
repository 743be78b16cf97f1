import os
from collections import Counter

import pytest

from codestrata.llm import catalog

BASE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables here")

COLUMNS = {
    "p1_found": {"chunk_id": "bigint", "line_no": "int"},
    "p2_found": {"chunk_id": "bigint", "function_name": "string"},
    "p3_found": {"vec_id": "bigint", "neighbor_id": "bigint"},
    "p4_found": {"chunk_id": "bigint", "group_id": "bigint"},
    "p5_found": {"chunk_id": "bigint", "span_start": "int", "span_end": "int"},
    "p6_found": {"vec_id": "bigint", "first_id": "bigint"},
    "p7_found": {"thread_id": "string", "turn_no": "int", "message_id": "string"},
    "p10_found": {"doc_id": "bigint", "sent_start": "int", "sent_end": "int"},
}


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_queries_run_with_their_columns_and_equal_their_twins(spark, name):
    df = catalog.queries()[name](spark, BASE)
    if name in COLUMNS:
        assert dict(df.dtypes) == COLUMNS[name]
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name.endswith("_found"):
        assert len(set(rows)) == len(rows)
    if name in catalog.oracle_sql():
        import duckdb

        con = duckdb.connect()
        for f in os.listdir(BASE):
            con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{BASE}/{f}'")
        twin = con.sql(catalog.oracle_sql()[name])
        order = [twin.columns.index(c) for c in df.columns]
        assert Counter(rows) == Counter(tuple(r[i] for i in order) for r in twin.fetchall())
