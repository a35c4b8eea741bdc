import math

import duckdb
import pytest

from slotwise.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    df, want = QUERIES[name](spark, SF), con.sql(ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    plain = lambda v: ("nan" if math.isnan(v) else f"{v:.6g}") if isinstance(v, float) else str(v)
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(plain(r[want.columns.index(c)]) for c in cols) for r in want.fetchall())
