"""A query whose rule goes by time, on a tape whose print numbers are not in the order of time, against its SQL."""

from __future__ import annotations

import os

import duckdb
from check import compare, oracle

from tidemark.plans.registry import ORACLES, QUERIES, load_all

load_all()


def test_recovered_before(spark, sf, tmp_path):
    for name in os.listdir(sf):
        if name != "events.parquet":
            os.symlink(f"{sf}/{name}", f"{tmp_path}/{name}")
    duckdb.connect().execute(f"""COPY (SELECT * REPLACE (event_id * 7919 % 100003 AS event_id, user_id % 5 AS user_id)
        FROM '{sf}/events.parquet' ORDER BY ts) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    name = "win_13_recovered_before"
    df = QUERIES[name](spark, str(tmp_path))
    rows = [tuple(r) for r in df.collect()]
    cur = oracle(str(tmp_path)).execute(ORACLES[name])
    diff = compare(rows, df.columns, cur.fetchall(), [d[0] for d in cur.description])
    assert any(r[df.columns.index("nrec")] for r in rows) and diff is None, diff
