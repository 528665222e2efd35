"""Exits against a plain walk over the prints; the ladder; what the ordered fold carries; parts, slices and live pools."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import joins as J
from tidemark.operators import resample as R
from tidemark.operators import stats as S
from tidemark.operators import trades as X
from tidemark.operators.ladder import Ladder, with_ranks
from tidemark.operators.slicing import PARTS, ordered_fold, rank_select

PRINT = "tok string, pool string, ts long, blk long, li int, px double, usd double, kind string, impact double, low_other double"


def walk(p, prints, end, tp_lat, wait, min_usd, drain, deep):
    """One position, print by print, as the rule reads."""
    c = p["clip"] / p["entry_px"]
    priceable = lambda r: r["kind"] == "v4" or r["usd"] >= min_usd
    last = next(r for r in prints if r["blk"] == p["entry_blk"])
    state, plan, trigger, why = "open", p["deadline"], None, "time"
    for r in prints + [None]:
        now = end + 1 if r is None or r["ts"] > end else r["ts"]
        if r is not None and r["blk"] <= p["entry_blk"]:
            continue
        over = now > end
        now = min(now, end)
        if state == "open" and now >= plan or state == "due" and now > plan:
            why = "tp" if state == "due" else "time"
            if priceable(last):
                return why, last["px"], plan, trigger
            state = "wait"
        if state == "wait" and now > plan + wait:
            return "fb", last["px"], plan + wait, trigger
        if over:
            return "end", last["px"], end, trigger
        if r["px"] < drain * p["entry_px"]:
            is_deep = r["kind"] == "v4" and r["impact"] is not None and c * r["impact"] <= deep
            if is_deep or r["low_other"] is not None and r["low_other"] < 2 * drain * p["entry_px"]:
                return "drain", r["px"], r["ts"], trigger
        if state == "wait" and priceable(r):
            return why, r["px"], r["ts"], trigger
        if state == "open":
            own = r["impact"] if r["kind"] == "v4" else 0.0
            if priceable(r) and own is not None and r["px"] / (1 + c * own) >= p["tp_line"]:
                state, plan, trigger = "due", r["ts"] + tp_lat, r["px"]
        last = r


def test_exits_against_a_walk(spark):
    """Thin pools at the line, crashes in the wait, prints of one second, pools without depth, several sizes and targets, long tapes."""
    r = random.Random(4)
    rows, blk = [], 0
    for pool, n in (("a", 700), ("b", 40), ("c", 300), ("d", 3)):
        t, px = 1000, 10.0
        for _ in range(n):
            t += r.choice([0, 0, 1, 7, 40])
            blk += 1
            px = max(0.05, px * r.choice([0.8, 0.97, 1.0, 1.02, 1.3])) if r.random() < 0.9 else r.choice([0.2, 4.0, 25.0])
            kind = "v2" if pool == "c" or r.random() < 0.3 else "v4"
            rows.append(dict(tok="k", pool=pool, ts=t, blk=blk, li=0, px=px, usd=r.choice([1.0, 20.0]), kind=kind,
                             impact=None if kind == "v2" or r.random() < 0.1 else r.choice([0.0, 0.01, 0.3, 2.0]), low_other=r.choice([None, px, px / 3, 9.0])))
    end = max(x["ts"] for x in rows if x["pool"] == "a") - 100
    by = {p: [x for x in rows if x["pool"] == p] for p in "abcd"}
    pos = []
    for i in range(300):
        e = r.choice(by[r.choice("aaabc")])
        if e["ts"] <= end:
            tp = r.choice([1.2, 2.0, 4.0])
            pos.append(dict(id=i, tok="k", pool=e["pool"], entry_ts=e["ts"], entry_blk=e["blk"], entry_px=e["px"], deadline=e["ts"] + r.choice([1, 30, 400, 5000]),
                            tp_line=e["px"] * tp, clip=r.choice([0.0, 1.0, 7.0, 3.3])))
    prints = X.with_next_priceable(spark.createDataFrame([tuple(x[c.split()[0]] for c in PRINT.split(", ")) for x in rows], PRINT), ["tok", "pool"], 10.0, 500)
    at = {x["blk"]: x["rk"] for x in prints.collect()}
    P = spark.createDataFrame([(*p.values(), at[p["entry_blk"]]) for p in pos],
                              "id long, tok string, pool string, entry_ts long, entry_blk long, entry_px double, deadline long, tp_line double, clip double, entry_rk long")
    out = X.exit_first_hit(P, prints, ["tok", "pool"], ["id"], end, [1.2, 2.0, 8.4], [1.0, 7.0], 20, 60, 10.0, 0.3, markup=1.0, slice_width=500)
    got = {x["id"]: (x["reason"], x["exit_px"], x["exit_ts"], x["trigger_px"]) for x in out.collect()}
    want = {p["id"]: walk(p, by[p["pool"]], end, 20, 60, 10.0, 0.3, X.DEEP) for p in pos}
    seen = {}
    for i, w in want.items():
        g = got[i]
        assert g[:3] == w[:3], (pos[[p["id"] for p in pos].index(i)], g, w)
        assert w[0] != "tp" or g[3] == w[3]
        seen[w[0]] = seen.get(w[0], 0) + 1
    assert set(seen) == {"drain", "tp", "time", "fb", "end"}, seen


def test_ladder_on_a_hot_second(spark):
    """Most prints of a key in one second: the first hit is found whatever the hopes of the buckets; rows met grow with the levels."""
    r = random.Random(1)
    rows = [("a", r.choice([5, 5, 5, r.randrange(1000)]), i, 0, r.random() * 100, r.random()) for i in range(3000)] + [("b", r.randrange(1000), i, 0, r.random() * 100, r.random()) for i in range(5)]
    prints = with_ranks(spark.createDataFrame(rows, "k string, ts long, blk long, li int, px double, g double"), ["k"], slice_width=100)
    order = {k: sorted((x for x in rows if x[0] == k), key=lambda x: x[1:4]) for k in "ab"}
    rank = {(x["k"], x["blk"]): x["rk"] for x in prints.collect()}
    assert all(rank[k, x[2]] == i - len(v) for k, v in order.items() for i, x in enumerate(v))
    ladder = Ladder(prints, ["k"], {"top": F.col("px")}, {}, ["px", "g", "ts", "blk"])
    assert ladder.levels == 3
    pos = [(i, k, -r.randrange(0, len(order[k]) + 1), r.choice([50.0, 90.0, 99.0, 101.0]), r.choice([0.0, 20.0])) for i in range(200) for k in [r.choice("aaab")]]
    P = spark.createDataFrame(pos, "id long, k string, lo long, line double, s double")
    hit = lambda: F.col("px") - F.col("s") * F.col("g") >= F.col("line")
    got = {x["id"]: x["hit"]["blk"] for x in ladder.first(P, ["id"], lambda: F.col("top") >= F.col("line"), hit, ["ts", "blk"]).collect()}
    for i, k, lo, line, s in pos:
        v = order[k]
        assert got.get(i) == next((x[2] for x in v[len(v) + lo:] if x[4] - s * x[5] >= line), None) if lo else i not in got
    units = P.select(F.size(ladder._units(F.col("lo"))).alias("n")).agg(F.max("n")).first()[0]
    assert units <= 7 * (ladder.levels + 1)


def test_fold_carries_large_integers_beside_nulls(spark):
    big = 2**60
    rows = [("k", i, big + 2 * i + 1 if i % 3 else None, 10 * i, 10 * i + 5) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, i long, ref long, s long, e long").coalesce(1)
    out = X.greedy_nonoverlap(df, ["k"], ["s"], "s", "e", partitions=3).collect()
    assert {(r["i"], r["ref"]) for r in out} == {(r[1], r[2]) for r in rows} and all(r["taken"] for r in out)
    keyed = ordered_fold(df.withColumn("key", F.col("ref")), ["key"], ["i"], lambda s, p: ({"n": (s or {"n": 0})["n"] + len(p)}, {"n": [len(p)] * len(p)}), [("n", "long")], partitions=2)
    assert {r["ref"]: r["n"] for r in keyed.filter("ref is not null").collect()} == {r[2]: 1 for r in rows if r[2]}
    cap = X.capacity_select(df.withColumn("cell", F.lit(1)), "cell", ["s"], "ref", "s", "e", 5).collect()
    assert sum(r["status"] == "taken" for r in cap) == 60


def test_an_hour_is_spent_once(spark):
    rows = [("k", 0, 5, 0), ("k", 10, 12, 0), ("k", 20, 40, 1), ("k", 30, 31, 2), ("k", 45, 46, 2), ("k", 47, 48, 2), ("k", None, 9, 3)]
    df = spark.createDataFrame(rows, "k string, s long, e long, h long")
    taken = {r["s"]: r["taken"] for r in X.greedy_nonoverlap(df, ["k"], ["s"], "s", "e", once="h", partitions=2).collect()}
    assert taken == {None: False, 0: True, 10: False, 20: True, 30: False, 45: True, 47: False}


def test_pegged_prices_are_ordered_in_parts(spark):
    """A hundred thousand different values within one percent."""
    n = 100_000
    df = spark.range(n).selectExpr("100D + (id * 7919 % 100000) / 100000D as x", "'g' as g")
    got = rank_select(df, ["g"], "x", {"lo": F.lit(0), "mid": F.floor(F.col("n") / 2), "hi": F.col("n") - 1}).first()
    assert (got["n"], got["lo"], got["mid"], got["hi"]) == (n, 100.0, pytest.approx(100.5), pytest.approx(100.99999))
    assert n / PARTS < 10


def test_dead_pools_are_not_met(spark):
    """A coin with thousands of pools that no longer print: a row meets the live ones only."""
    dead = [("k", f"d{i}", i, i, 0, 1.0, 5.0) for i in range(5000)]
    live = [("k", p, 100_000 + 300 * j, 10_000 + 10 * j + q, 0, 2.0 + j, 5.0) for j in range(10) for q, p in enumerate(("x", "y"))]
    prints = spark.createDataFrame(dead + live, "tok string, pool string, ts long, blk long, li int, px double, usd double")
    left = spark.createDataFrame([(1, "k", 101_000), (2, "k", 101_800), (3, "k", 200_000), (4, "k", 2_500)], "id long, tok string, ts long")
    out = J.state_by_pool_at(left, prints, max_age=1800, slice_width=10_000)
    rows = out.collect()
    count = {i: sum(r["id"] == i for r in rows) for i in (1, 2, 3, 4)}
    assert count[1] == count[2] == 2 and count[3] == 0 and count[4] == sum(2_500 - 1800 <= t <= 2_500 for t in range(5000))


def test_resamples_do_not_depend_on_slices(spark, monkeypatch):
    r = random.Random(2)
    rows = [(r.choice("ab"), f"c{r.randrange(40)}", r.randrange(12), r.gauss(1, 3)) for _ in range(500)]
    df = spark.createDataFrame(rows, "cell string, coin string, day long, x double")
    run = lambda: [S.block_bootstrap(df, ["cell"], "x", "day", 60), S.coin_bootstrap(df, ["cell"], "x", "coin", 60), S.reality_check(df, "cell", "x", "coin", "day", 60)]
    whole = [sorted(map(tuple, d.collect())) for d in run()]
    monkeypatch.setattr(R, "SLICE_UNITS", 7)
    monkeypatch.setattr(R, "BLOCK", 16)
    for a, b in zip(whole, run(), strict=True):
        for x, y in zip(a, sorted(map(tuple, b.collect())), strict=True):
            assert x == pytest.approx(y)
    u = {}
    for c, _, d, x in rows:
        s = u.setdefault((c, d), [0.0, 0])
        s[0], s[1] = s[0] + x, s[1] + 1
    for cell, se, lo, hi, units in whole[0]:
        days = sorted(d for c, d in u if c == cell)
        means = []
        for b in range(60):
            st = R.draws(f"bb|{b}", range(-(-len(days) // 2))) % len(days)
            take = [u[cell, days[(st[k // 2] + k % 2) % len(days)]] for k in range(len(days))]
            means.append(sum(t[0] for t in take) / max(1, sum(t[1] for t in take)))
        assert (se, lo, hi, units) == (pytest.approx(np.std(means, ddof=1)), pytest.approx(np.percentile(means, 2.5)), pytest.approx(np.percentile(means, 97.5)), len(days))
