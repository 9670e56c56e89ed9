"""Each query of the panel operators against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from tidemark import queries

SF = "/root/testdata/sf0.001"
#: The smallest tables have too few names a date for these, which would compare nothing.
CROSS_SECTIONS = {"ic_series", "ic_summary", "ic_by_year", "hac_significance", "rolling_ic", "walk_forward_folds", "walk_forward_summary", "ic_decay", "decay_peak", "ic_by_group", "marginal_ic", "top_group_excess", "factor_statuses", "stability_scores", "marginal_ic_of_many"}
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_agrees_with_sql(spark, name):
    con, sf = duckdb.connect(), SF.replace("0.001", "0.01") if name in CROSS_SECTIONS else SF
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf)
    want = con.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    shown = lambda v: f"{v:.5f}" if isinstance(v, float) else str(v)
    a = sorted(tuple(shown(v) for v in r) for r in got.select(*names).collect())
    b = sorted(tuple(shown(v) for v in r) for r in want.project(", ".join(f'"{n}"' for n in names)).fetchall())
    assert len(a) == len(b)
    assert a or name not in CROSS_SECTIONS
    differ = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert len(differ) <= len(a) // 1000, differ[:3]
