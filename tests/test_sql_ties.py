"""Queries on a tape of equal seconds, prices of zero and quotients that end on half a millionth, against their SQL to the last digit."""

from __future__ import annotations

import os

import duckdb
import pytest
from check import compare, oracle

from tidemark.plans.registry import ORACLES, QUERIES, load_all

load_all()


def tape_of(sf, folder, **columns):
    for name in os.listdir(sf):
        if name != "events.parquet":
            os.symlink(f"{sf}/{name}", f"{folder}/{name}")
    changed = ", ".join(f"{expr} AS {name}" for name, expr in columns.items())
    duckdb.connect().execute(f"COPY (SELECT * REPLACE ({changed}) FROM '{sf}/events.parquet' ORDER BY event_id) TO '{folder}/events.parquet' (FORMAT parquet)")
    return str(folder)


def differs(spark, folder, name):
    df = QUERIES[name](spark, folder)
    rows = [tuple(r) for r in df.collect()]
    cur = oracle(folder).execute(ORACLES[name])
    assert rows
    return compare(rows, df.columns, cur.fetchall(), [d[0] for d in cur.description])


TIES = "CASE WHEN event_id % 4 = 0 THEN 32.0 ELSE event_id * 37 % 3200 / 100.0 END"


@pytest.mark.parametrize("columns", [
    {"value": TIES},
    {"ts": "date_trunc('day', ts)", "props": "CASE WHEN event_id % 20 = 0 THEN '{\"k\": 90}' ELSE '{\"k\": 1}' END"},
], ids=["half a millionth", "equal seconds"])
def test_sell_flags(spark, sf, tmp_path, columns):
    diff = differs(spark, tape_of(sf, tmp_path, **columns), "win_14_sell_flags")
    assert diff is None, diff


@pytest.mark.parametrize("columns", [
    {"value": "CASE WHEN event_id % 4 = 0 THEN 32.0 ELSE (1560 + event_id * 37 % 40) / 100.0 END"},
    {"value": "CASE WHEN event_id % 7 = 0 OR user_id % 5 = 2 THEN 0.0 ELSE value END"},
    {"ts": "date_trunc('day', ts)"},
], ids=["half a millionth", "zeros", "equal seconds"])
def test_dip_candidates(spark, sf, tmp_path, columns):
    diff = differs(spark, tape_of(sf, tmp_path, **columns), "trd_03_dip_candidates")
    assert diff is None, diff


def test_marks_of_prints_of_unknown_size(spark, sf, tmp_path):
    folder = tape_of(sf, tmp_path, props="CASE WHEN event_id % 3 = 0 THEN '{}' ELSE props END", user_id="user_id % 4")
    diff = differs(spark, folder, "trd_10_marks")
    assert diff is None, diff
