"""Whitening against numpy on all rows."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import whitening as WH

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, components=16, counts=False):
    ok = [(i, tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)) for i, v, *_ in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    if not ok:
        return []
    size = max(Counter(len(v) for _, v in ok).items(), key=lambda p: p[::-1])[0]
    ok = [(i, v) for i, v in ok if len(v) == size]
    times = Counter(v for _, v in ok)
    xs = list(times)
    w = np.array([times[v] if counts else 1 for v in xs])
    n, sums = int(w.sum()), [sum(int(k) * v[j] for k, v in zip(w, xs)) for j in range(size)]
    c = np.array([[(n * x - s) / n for x, s in zip(v, sums)] for v in xs])
    v = (c * w[:, None]).T @ c / n
    e, u = np.linalg.eigh(v)
    order = [k for k in np.argsort(-e)[:components] if e[k] > 1e-12 * e.max() and e[k] > 0]
    white = {x: row @ u[:, order] / np.sqrt(e[order]) for x, row in zip(xs, c)}
    return [(i, k + 1, n, sum((n * a - s) ** 2 for a, s in zip(x, sums)), white[x][k], e[j] / np.trace(v)) for i, x in ok for k, j in enumerate(order)]


def check(df, rows, counts=False):
    want = plain(rows, counts=counts)
    got = WH.whitened_rows(df, counts=counts).collect()
    assert len(got) == len(want)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[3], abs(r[4]))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    sign: dict = {}
    for g, w in zip(got, want):
        assert g[4] == pytest.approx(w[4], abs=1e-7) or g[4] == pytest.approx(-w[4], abs=1e-7)
        if abs(w[4]) > 1e-6:
            assert sign.setdefault(g[1], g[4] * w[4] > 0) == (g[4] * w[4] > 0)
        assert g[5] == pytest.approx(w[5], rel=1e-6) and g[6] < 1e-6
    assert len({g[6] for g in got}) <= 1
    return got


def vectors(n=300, d=20, seed=3):
    r = np.random.default_rng(seed)
    return [(2**60 + i, [float(x) for x in (r.normal(size=d) * np.linspace(2, 0.5, d)).astype(np.float32)], i) for i in range(n)]


def test_against_numpy(spark):
    """Copies, a hot vector, nulls and non-finite entries, other lengths, null ids beside large ones."""
    rows = vectors()
    hot = rows[0][1]
    odd = [(None, hot, 1), (1, None, 1), (2, [], 1), (3, [1.0] * 19 + [None], 1), (4, [1.0] * 19 + [math.nan], 1), (5, [1.0] * 19 + [-math.inf], 1), (6, [1.0, 2.0], 1)]
    rows = rows + [(i, hot, 0) for i in range(2000)] + rows[5:9] + odd
    for counts in (False, True):
        check(spark.createDataFrame(rows, SCHEMA).repartition(5), rows, counts)


def test_given_embeddings(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = check(df, [tuple(r) for r in df.select("vec_id", "embedding").collect()])
    assert {g[1] for g in got} == set(range(1, 17))


def test_few_vectors_flat_dimensions_and_large_entries(spark):
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert WH.whitened_rows(make([])).count() == 0
    assert WH.whitened_rows(make([(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)])).count() == 0
    few = [(i, [float(i), 2.0 * i, 7.0, float(i % 3)], 0) for i in range(5)]
    check(make(few), few)
    large = [(1, [3e30, 1.0], 0), (2, [-3e30, 2.0], 0), (3, [5.0, 3.0], 0)]
    out = WH.whitened_rows(make(large)).collect()
    assert {r["vec_id"] for r in out} == {1, 2, 3} and max(r["deviation"] for r in out) == WH.LIMIT


def test_exact_beyond_doubles(spark):
    rows = [(i, [float(i * i * 100), float(i)], 0) for i in range(60)]
    check(spark.createDataFrame(rows, SCHEMA), rows)
