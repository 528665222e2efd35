"""Every registered query against its SQL, on the smallest scale."""

from __future__ import annotations

import pytest
from check import compare

import __spark_entry__ as entry
from tidemark.plans.registry import ORACLES as SQL
from tidemark.plans.registry import QUERIES, load_all

load_all()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["cell", "trades", "coins", "mean_ret", "tp_share"]
    assert df.count() >= 1


def test_every_query_but_the_file_hashes_has_sql():
    assert sorted(set(QUERIES) - set(SQL)) == ["src_07_file_inventory"]
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    df = QUERIES[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    if name not in SQL:
        assert rows
        return
    cur = con.execute(SQL[name])
    diff = compare(rows, df.columns, cur.fetchall(), [d[0] for d in cur.description], tol=2e-6)
    assert diff is None, diff
