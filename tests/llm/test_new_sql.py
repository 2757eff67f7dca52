import glob
import os

import duckdb
import pytest

from tagveil.llm import registry

SF = "/root/testdata/sf0.001"


def plain(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(str(r[i]).lower() for i in order) for r in rows)


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = registry.QUERIES[name](spark, SF)
    want = con.sql(registry.ORACLE_SQL[name])
    rows = df.collect()
    assert rows and plain(df.columns, rows) == plain(want.columns, want.fetchall())
