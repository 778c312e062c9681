"""Queries of the operators against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from inkwell.llm import registry
from tests.test_oracles import DATA, norm


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    df = registry.queries()[name](spark, DATA)
    cur = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(norm(r[columns.index(c)]) for c in sorted(columns)) for r in cur.fetchall())
    assert sorted(tuple(norm(r[c]) for c in sorted(columns)) for r in df.collect()) == want
