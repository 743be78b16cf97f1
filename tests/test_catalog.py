import os

import pytest

import __spark_entry__ as entry
from codestrata.plans import catalog

BASE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_every_query_runs_with_the_columns_of_its_twin(spark, name):
    df = catalog.queries()[name](spark, BASE)
    assert df.columns and df.count() >= 0
    if name in catalog.oracle_sql():
        import duckdb

        con = duckdb.connect()
        for f in os.listdir(BASE):
            con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{BASE}/{f}'")
        twin = con.sql(catalog.oracle_sql()[name])
        assert sorted(twin.columns) == sorted(df.columns)
        assert len(twin.fetchall()) == df.count()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
