"""The payoff query against its SQL where books lack gains or losses."""

import datetime as dt

import duckdb

from tidemark import queries


def test_payoff_agrees_without_gains_or_losses(spark, tmp_path):
    prices = {"up": [2e5, 3e5, 4e5], "down": [1e4, 2e4, 3e4], "both": [1e4, 2e5, 3e5], "even": [1.4e5, 1.4e5, 1.4e5], "tail": [1.4e5] * 9 + [2e5], "none": [None, None]}
    rows = [(i, p, b, dt.date(2024, 1, 1 + i)) for b, ps in prices.items() for i, p in enumerate(ps)]
    path = str(tmp_path / "orders.parquet")
    con = duckdb.connect()
    con.execute("CREATE TABLE orders (o_orderkey BIGINT, o_totalprice DOUBLE, o_orderpriority VARCHAR, o_orderdate TIMESTAMP)")
    con.executemany("INSERT INTO orders VALUES (?, ?, ?, ?)", rows)
    con.execute(f"COPY orders TO '{path}' (FORMAT parquet)")
    names = ["book", "profit_factor", "profit_loss_ratio", "tail_ratio"]
    got = sorted(str(tuple(r)) for r in queries.QUERIES["payoff"](spark, str(tmp_path)).select(*names).collect())
    want = sorted(str(r) for r in con.execute(f"SELECT {', '.join(names)} FROM ({queries.ORACLE_SQL['payoff']})").fetchall())
    assert got == want
    assert any(r.startswith("('up', None, None, ") for r in got)
