"""Each training-data query that SQL can express against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from tidemark.llm import entries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(entries.ORACLE_SQL))
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = entries.QUERIES[name](spark, SF), con.sql(entries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    shown = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    a = sorted(tuple(shown(v) for v in r) for r in got.select(*names).collect())
    b = sorted(tuple(shown(v) for v in r) for r in want.project(", ".join(f'"{n}"' for n in names)).fetchall())
    assert a and a == b
