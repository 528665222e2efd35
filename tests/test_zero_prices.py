"""Queries that divide by prices, on a tape with prices of zero, against their SQL."""

from __future__ import annotations

import os

import duckdb
import pytest
from check import compare, oracle

from tidemark.plans.registry import ORACLES, QUERIES, load_all

load_all()


@pytest.fixture(scope="module")
def zeros(sf, tmp_path_factory):
    """The tables with every seventh price, and all prices of some coins, at zero."""
    folder = str(tmp_path_factory.mktemp("zeros"))
    for name in os.listdir(sf):
        if name != "events.parquet":
            os.symlink(f"{sf}/{name}", f"{folder}/{name}")
    duckdb.connect().execute(f"""COPY (SELECT * REPLACE (CASE WHEN event_id % 7 = 0 OR user_id % 5 = 2 THEN 0.0 ELSE value END AS value)
        FROM '{sf}/events.parquet' ORDER BY event_id) TO '{folder}/events.parquet' (FORMAT parquet)""")
    return folder


@pytest.mark.parametrize("name", [
    "str_06_stream_dip_signal",
    "win_15_fee_estimate",
    "cln_03_main_pool_consistency",
    "cln_05_quote_ref_jump",
    "cst_11_eth_booking",
    "win_05_dip",
    "win_07_coin_stats",
    "win_11_trend",
    "win_12_lookback_return",
    "win_13_dip_episodes",
    "win_13_recovered_before",
    "win_14_sell_flags",
    "win_21_runup",
    "win_22_race",
    "win_23_peak_after",
    "win_25_at_call_features",
])
def test_zero_prices(spark, zeros, name):
    df = QUERIES[name](spark, zeros)
    rows = [tuple(r) for r in df.collect()]
    cur = oracle(zeros).execute(ORACLES[name])
    diff = compare(rows, df.columns, cur.fetchall(), [d[0] for d in cur.description], tol=2e-6)
    assert rows and diff is None, diff
