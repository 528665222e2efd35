"""As-of, range, interval and matching joins (JON).

As-of and prefix joins are one union, one sliced window and one filter: both sides are shuffled once by
(key, time slice) and no pair of rows is ever formed. Catalyst picks the physical form of everything else.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import DAY, bucket, hash_u32, round_half_up
from tidemark.operators.slicing import running, width_or_layout


def prefix_at(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    aggs: dict[str, tuple[str, Column]],
    left_ts: str = "ts",
    right_ts: str = "ts",
    tie: Sequence[str] = (),
    strict: bool = False,
    forward: bool = False,
    slice_width: int | None = None,
) -> DataFrame:
    """For each left row, aggregates over all right rows of its key up to its time (or from it, ``forward``).

    ``aggs`` uses the kinds of ``running`` with expressions over the right columns. ``strict`` leaves out right
    rows at exactly the left time. ``tie`` orders right rows of equal time.
    """
    by, tie = list(by), list(tie)
    sign = -1 if forward else 1
    t = lambda c: F.col(c) * F.lit(sign)
    probes = left.select(
        *by, t(left_ts).alias("_t"), F.lit(0 if strict else 1).alias("_side"),
        *[F.lit(0).cast("long").alias(f"_o{i}") for i in range(len(tie))], F.struct(*left.columns).alias("__left"))
    facts = right.select(
        *by, t(right_ts).alias("_t"), F.lit(1 if strict else 0).alias("_side"),
        *[t(c).cast("long").alias(f"_o{i}") for i, c in enumerate(tie)],
        *[x.alias(f"_v_{n}") for n, (_, x) in aggs.items()])
    both = probes.unionByName(facts, allowMissingColumns=True)
    got = running(
        both, by, ["_t", "_side", *[f"_o{i}" for i in range(len(tie))]],
        {n: (k, F.col(f"_v_{n}")) for n, (k, _) in aggs.items()}, bucket("_t", width_or_layout(slice_width)))
    return got.filter(F.col("__left").isNotNull()).select("__left.*", *aggs)


def asof_backward(
    left: DataFrame, right: DataFrame, by: Sequence[str], name: str = "r", tol: int | None = None,
    strict: bool = False, left_ts: str = "ts", right_ts: str = "ts", tie: Sequence[str] = (),
    columns: Sequence[str] | None = None, slice_width: int | None = None,
) -> DataFrame:
    """JON-1: struct ``name`` of the last right row at or before (``strict``: before) the left time."""
    return _asof(left, right, by, name, tol, strict, left_ts, right_ts, tie, columns, slice_width, False)


def asof_forward(
    left: DataFrame, right: DataFrame, by: Sequence[str], name: str = "r", tol: int | None = None,
    strict: bool = False, left_ts: str = "ts", right_ts: str = "ts", tie: Sequence[str] = (),
    columns: Sequence[str] | None = None, slice_width: int | None = None,
) -> DataFrame:
    """JON-2: struct ``name`` of the first right row at or after the left time; null when later than ``tol``."""
    return _asof(left, right, by, name, tol, strict, left_ts, right_ts, tie, columns, slice_width, True)


def _asof(left, right, by, name, tol, strict, left_ts, right_ts, tie, columns, slice_width, forward):
    cols = list(columns) if columns else [c for c in right.columns if c not in by]
    if right_ts not in cols:
        cols = [right_ts, *cols]
    out = prefix_at(left, right, by, {name: ("last", F.struct(*cols))}, left_ts, right_ts, tie, strict,
                    forward, slice_width)
    if tol is not None:
        age = F.abs(F.col(left_ts) - F.col(f"{name}.{right_ts}"))
        out = out.withColumn(name, F.when(age <= F.lit(tol), F.col(name)))
    return out


def interp_linear(
    left: DataFrame, series: DataFrame, by: Sequence[str] = (), left_ts: str = "ts", x: str = "ts", y: str = "v",
    name: str = "interp", outside: str = "clamp", slice_width: int | None = None, step: int | None = None,
) -> DataFrame:
    """JON-3: linear value between the neighbouring points; outside the series clamp, or extend the end line.

    Each point carries its next point, so one backward as-of yields both neighbours. A sentinel in front of each
    series makes rows before the first point find it. A series without keys goes through ``_interp_global``.
    """
    if not by:
        return _interp_global(left, series, left_ts, x, y, name, outside, step or 600)
    keys = list(by)
    pts = series.select(*keys, F.col(x).alias("x"), F.col(y).cast("double").alias("y")).withColumn("nx", -F.col("x"))
    nxt = running(pts, keys, ["nx"], {"n": ("last", F.struct("x", "y"))}, bucket("nx", width_or_layout(slice_width)), False)
    point = "struct<x:bigint,y:double>"
    head = pts.groupBy(*keys).agg(F.min_by(F.struct("x", "y"), "x").alias("n")).select(
        *keys, F.lit(-(2 ** 40)).alias("x"), F.lit(None).cast("double").alias("y"), F.col("n").cast(point).alias("n"))
    facts = nxt.select(*keys, "x", "y", F.col("n").cast(point).alias("n")).unionByName(head)
    got = asof_backward(left, facts, keys, "_s", left_ts=left_ts, right_ts="x", slice_width=slice_width)
    t, s = F.col(left_ts), lambda c: F.col(f"_s.{c}")
    line = lambda x0, y0, x1, y1: y0 + (y1 - y0) * (t - x0) / (x1 - x0)
    inside = line(s("x"), s("y"), s("n.x"), s("n.y"))
    if outside == "clamp":
        before, after = s("n.y"), s("y")
    else:  # the first two and the last two points define the end lines
        ends = pts.groupBy(*keys).agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
        near = pts.join(ends, keys).groupBy(*keys).agg(
            F.min_by(F.struct("x", "y"), F.when(F.col("x") > F.col("x0"), F.col("x"))).alias("_s2"),
            F.max_by(F.struct("x", "y"), F.when(F.col("x") < F.col("x1"), F.col("x"))).alias("_s3"))
        got = got.join(near, keys, "left")
        before = line(s("n.x"), s("n.y"), F.col("_s2.x"), F.col("_s2.y"))
        after = line(F.col("_s3.x"), F.col("_s3.y"), s("x"), s("y"))
    value = F.when(s("y").isNull(), before).when(s("n").isNull(), after).otherwise(inside)
    return got.select(*left.columns, value.alias(name))


def _interp_global(left, series, left_ts, x, y, name, outside, step):
    """One series for all rows: its segments, cut at multiples of ``step``, join the rows on the bucket of their time.

    The rows are not shuffled while the segment table is small enough for Spark to broadcast by its own size check;
    beyond that the join is a sort-merge on the bucket. The two ends are scalar values.
    """
    pts = series.select(F.col(x).alias("x"), F.col(y).cast("double").alias("y"), F.lit(0).alias("_k"), (-F.col(x)).alias("nx"))
    nxt = running(pts, ["_k"], ["nx"], {"n": ("last", F.struct("x", "y"))}, bucket("nx", step * 4096), False)
    seg = nxt.filter(F.col("n").isNotNull()).select(
        F.col("x").alias("_x0"), F.col("y").alias("_y0"), F.col("n.x").alias("_x1"), F.col("n.y").alias("_y1"))
    seg = seg.withColumn("_b", F.explode(F.sequence(bucket("_x0", step), bucket(F.col("_x1") - 1, step))))
    t = F.col(left_ts)
    rows = left.withColumn("_b", bucket(left_ts, step))
    got = rows.join(seg, (rows["_b"] == seg["_b"]) & (t >= seg["_x0"]) & (t < seg["_x1"]), "left")
    line = lambda x0, y0, x1, y1: y0 + (y1 - y0) * F.try_divide(t - x0, x1 - x0)
    inside = line(F.col("_x0"), F.col("_y0"), F.col("_x1"), F.col("_y1"))
    head, tail = pts.agg(F.min_by("y", "x"), F.min("x")), pts.agg(F.max_by("y", "x"), F.max("x"))
    first = lambda d, i: d.select(d.columns[i]).scalar()
    y_first, x_first, y_last, x_last = first(head, 0), first(head, 1), first(tail, 0), first(tail, 1)
    if outside == "clamp":
        before, after = y_first, y_last
    else:
        ends = seg.agg(F.min_by(F.struct("_x1", "_y1"), "_x0").alias("a"), F.max_by(F.struct("_x0", "_y0"), "_x0").alias("z"))
        pick = lambda c: ends.select(F.col(c)).scalar()
        before = line(x_first, y_first, pick("a._x1"), pick("a._y1"))
        after = line(pick("z._x0"), pick("z._y0"), x_last, y_last)
    value = F.when(F.col("_x0").isNotNull(), inside).when(t < x_first, before).otherwise(after)
    return got.select(*left.columns, value.alias(name))


def block_time(left: DataFrame, anchors: DataFrame, blk: str = "blk", name: str = "block_ts", step: int = 25_000) -> DataFrame:
    """PRJ-17: time of a block by piecewise-linear interpolation, extended outside the anchors."""
    out = interp_linear(left, anchors, (), blk, "blk", "ts", name, "extend", step=step)
    return out.withColumn(name, round_half_up(F.col(name)))


def asof_multires(
    left: DataFrame, prints: DataFrame, by: Sequence[str], at: str, now: str,
    rings: Sequence[tuple[int, int]] = ((60, 60), (600, 150), (3600, 52)), order: Sequence[str] = ("ts", "blk", "li"),
    px: str = "px", name: str = "px_at", slice_width: int | None = None,
) -> DataFrame:
    """JON-4: close of the last strictly earlier bucket, finest ring first; a ring reaches ``n`` buckets back of now.

    A bucket b lies strictly before t's bucket exactly when its end is at or before t, so all rings share one as-of.
    """
    facts = None
    for i, (w, _) in enumerate(rings):
        one = (prints.groupBy(*by, bucket("ts", w).alias("b"))
               .agg(F.max_by(px, F.struct(*order)).alias("close"))
               .select(*by, ((F.col("b") + 1) * w).alias("end"), "b", "close", F.lit(i).alias("ring")))
        facts = one if facts is None else facts.unionByName(one)
    got = prefix_at(
        left, facts, by,
        {f"_r{i}": ("last", F.when(F.col("ring") == i, F.struct("b", "close"))) for i in range(len(rings))},
        left_ts=at, right_ts="end", slice_width=slice_width)
    ok = [F.when(F.col(f"_r{i}.b") > bucket(now, w) - n, F.col(f"_r{i}.close")) for i, (w, n) in enumerate(rings)]
    return got.withColumn(name, F.coalesce(*ok)).drop(*[f"_r{i}" for i in range(len(rings))])


def range_join(
    left: DataFrame, right: DataFrame, by: Sequence[str], lo: str, hi: str, width: int, right_ts: str = "ts",
    how: str = "inner",
) -> DataFrame:
    """JON-5 / JON-6: right rows with lo <= ts <= hi as an equi-join on (key, time bucket) plus a residual.

    Use it where every match is wanted. For the first match use ``trades.first_crossing``, for counts and sums
    ``prefix_at``: both avoid forming the pairs.
    """
    spans = left.withColumn("_b", F.explode(F.sequence(bucket(lo, width), bucket(hi, width))))
    facts = right.withColumn("_b", bucket(right_ts, width))
    cond = (F.col(right_ts) >= F.col(lo)) & (F.col(right_ts) <= F.col(hi))
    return spans.join(facts, [*by, "_b"], "inner").filter(cond).drop("_b")


def range_sums(
    left: DataFrame, right: DataFrame, by: Sequence[str], lo: Column, hi: Column,
    aggs: dict[str, tuple[str, Column]], row_id: Sequence[str], right_ts: str = "ts", slice_width: int | None = None,
) -> DataFrame:
    """Counts and sums of the right rows in [lo, hi] per left row: prefix at hi minus prefix before lo, no pairs."""
    names = list(aggs)
    ends = left.select("*", F.explode(F.array(
        F.struct(hi.alias("_at"), F.lit(1).alias("_sg")), F.struct((lo - 1).alias("_at"), F.lit(-1).alias("_sg"))
    )).alias("_e")).select(*left.columns, "_e._at", "_e._sg")
    got = prefix_at(ends, right, by, aggs, left_ts="_at", right_ts=right_ts, slice_width=slice_width)
    carried = [c for c in left.columns if c not in row_id]
    return got.groupBy(*row_id).agg(
        *[F.first(c).alias(c) for c in carried],
        *[F.sum(F.coalesce(F.col(n), F.lit(0)) * F.col("_sg")).alias(n) for n in names]).select(*left.columns, *names)


def state_by_pool_at(
    left: DataFrame, prints: DataFrame, tok: str = "tok", pool: str = "pool", left_ts: str = "ts",
    max_age: int = 1800, tie: Sequence[str] = ("blk", "li"), columns: Sequence[str] = ("ts", "px", "usd"),
    strict: bool = False, slice_width: int | None = None,
) -> DataFrame:
    """JON-7: one row per (left row, pool of its token that printed within ``max_age``) with the pool's last state.

    A presence index (token, interval of ``max_age``, pool) says which pools can be fresh at a time: those that printed in its interval or the one
    before. So a row meets the live pools only, however many dead ones its token has.
    """
    at = F.explode(F.array(bucket("ts", max_age), bucket("ts", max_age) + 1)).alias("_at")
    present = prints.select(tok, pool, at).distinct()
    probes = left.drop(pool).withColumn("_at", bucket(left_ts, max_age)).join(present, [tok, "_at"]).drop("_at")
    got = asof_backward(probes, prints, [tok, pool], "state", max_age, strict, left_ts, "ts", tie, columns, slice_width)
    return got.filter(F.col("state").isNotNull())


def cheapest_pool(left, prints, row_id: Sequence[str], cost: Column, **kw) -> DataFrame:
    """JON-8: the fresh pool with the lowest cost per left row, ties to the lower pool name."""
    got = state_by_pool_at(left, prints, **kw).withColumn("_cost", cost)
    pick = F.min_by(F.struct("pool", "state", "_cost"), F.struct("_cost", "pool"))
    return got.groupBy(*row_id).agg(pick.alias("_p")).select(
        *row_id, F.col("_p.pool").alias("best_pool"), F.col("_p.state").alias("best_state"), F.col("_p._cost").alias("best_cost"))


def reference_price(left, prints, row_id: Sequence[str], depth: str = "usd", max_age: int = DAY, **kw) -> DataFrame:
    """JON-10: price of the deepest pool with a state at most ``max_age`` old, causal; ties to the lower pool name."""
    got = state_by_pool_at(left, prints, max_age=max_age, **kw)
    rank = F.struct((-F.col(f"state.{depth}")).alias("d"), F.col("pool"))
    return got.groupBy(*row_id).agg(F.min_by(F.struct("pool", "state"), rank).alias("_p")).select(
        *row_id, F.col("_p.pool").alias("ref_pool"), F.col("_p.state.px").alias("ref_px"))


def best_route(left, direct: DataFrame, via: DataFrame, row_id: Sequence[str], rate: str = "rate") -> DataFrame:
    """JON-9: best of the direct routes and the two-leg routes; ``direct`` and ``via`` hold candidates per row id.

    The lower rate wins; a row without candidates keeps a null rate.
    """
    d = direct.groupBy(*row_id).agg(F.min(rate).alias("direct_rate"))
    legs = via.groupBy(*row_id, "leg").agg(F.min(rate).alias("leg_rate"))
    two = legs.groupBy(*row_id).agg(
        F.when(F.count("leg_rate") == 2, F.max(F.when(F.col("leg") == 1, F.col("leg_rate")))
               * F.max(F.when(F.col("leg") == 2, F.col("leg_rate")))).alias("via_rate"))
    out = left.join(d, list(row_id), "left").join(two, list(row_id), "left")
    return (out.withColumn("route_rate", F.least("direct_rate", "via_rate"))
            .withColumn("route", F.when(F.col("route_rate").isNull(), F.lit("none"))
                        .when(F.col("direct_rate") <= F.coalesce("via_rate", F.lit(float("inf"))), F.lit("direct"))
                        .otherwise(F.lit("via"))))


def distinct_others_within(
    df: DataFrame, by: str, who: str, row_id: str, w: int, ts: str = "ts", name: str = "others",
    slice_width: int | None = None,
) -> DataFrame:
    """JON-13: distinct other ``who`` of the same key within +-w of each row, by a sweep instead of a self-join.

    Each who's rows closer than 2w merge into one covering interval; the answer is the number of intervals that
    cover the row, less its own.
    """
    base = df.select(row_id, by, who, F.col(ts).alias("t"), (-F.col(ts)).alias("nt"), (-F.col(row_id)).alias("nid"))
    prev = running(base, [by, who], ["t", row_id], {"p": ("last", F.col("t"))}, bucket("t", width_or_layout(slice_width)), False)
    both = running(prev, [by, who], ["nt", "nid"], {"n": ("last", F.col("t"))}, bucket("nt", width_or_layout(slice_width)), False)
    opens = both.filter(F.col("p").isNull() | (F.col("t") - F.col("p") > 2 * w)).select(
        by, (F.col("t") - w).alias("at"), F.lit(1).alias("d"))
    closes = both.filter(F.col("n").isNull() | (F.col("n") - F.col("t") > 2 * w)).select(
        by, (F.col("t") + w + 1).alias("at"), F.lit(-1).alias("d"))
    probes = df.withColumn("_t", F.col(ts))
    got = prefix_at(probes, opens.unionByName(closes), [by], {name: ("sum", F.col("d"))}, "_t", "at",
                    slice_width=slice_width)
    return got.withColumn(name, F.col(name) - 1).drop("_t")


def prior_events(
    df: DataFrame, by: str, who: str, row_id: str, ts: str = "ts", slice_width: int | None = None,
) -> DataFrame:
    """JON-14: strictly earlier rows of the key, and distinct other ``who`` among them."""
    first = df.groupBy(by, who).agg(F.min(ts).alias("_first"))
    rows = df.groupBy(by, F.col(ts).alias("t")).agg(F.count("*").alias("c"), F.lit(0).alias("f"))
    firsts = first.select(by, F.col("_first").alias("t"), F.lit(0).alias("c"), F.lit(1).alias("f"))
    facts = rows.unionByName(firsts)
    got = prefix_at(df, facts, [by], {"prior_rows": ("sum", F.col("c")), "_who": ("sum", F.col("f"))}, ts, "t",
                    strict=True, slice_width=slice_width)
    got = got.join(first, [by, who], "left")
    return (got.withColumn("prior_rows", F.coalesce("prior_rows", F.lit(0)))
            .withColumn("prior_others", F.coalesce("_who", F.lit(0)) - (F.col("_first") < F.col(ts)).cast("int"))
            .drop("_who", "_first"))


def ring_draw(
    signals: DataFrame, pool: DataFrame, group: Sequence[str], member: str, k: int, seed: str,
    signal_id: Sequence[str], own: str,
) -> DataFrame:
    """JON-11 / TRD-13 / TRD-15: up to ``k`` distinct members of the signal's group, never its own.

    The members of a group stand on a ring in hash order; a signal takes the next ones from a hashed position and
    steps over itself. The cost is signals x (k + 1) rows, not signals x members.
    ``pool`` holds one row per (group, member).
    """
    group = list(group)
    pos = pool.select(*group, F.col(member).alias("twin")).withColumn(
        "_h", hash_u32(seed, *[F.col(c) for c in group], F.col("twin")))
    ranked = running(pos.withColumn("_one", F.lit(1)), group, ["_h", "twin"], {"_pos": ("count", F.col("_one"))},
                     F.floor(F.col("_h") / F.lit(2 ** 24)))
    sizes = pool.groupBy(*group).agg(F.count("*").alias("n_pool"))
    sig = signals.join(sizes, group)
    start = hash_u32(seed, "start", *[F.col(c) for c in signal_id]) % F.col("n_pool")
    steps = (sig.withColumn("_start", start)
             .withColumn("_step", F.explode(F.sequence(F.lit(0), F.least(F.lit(k), F.col("n_pool") - 1).cast("int"))))
             .withColumn("_pos", (F.col("_start") + F.col("_step")) % F.col("n_pool") + 1))
    got = steps.join(ranked.select(*group, "_pos", "twin"), [*group, "_pos"]).filter(F.col("twin") != F.col(own))
    w = Window.partitionBy(*signal_id).orderBy("_step")
    got = got.withColumn("draw", F.row_number().over(w)).filter(F.col("draw") <= k)
    return got.drop("_pos", "_step", "_start")


def paired(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """JON-16: the same keys under two settings and the difference b - a."""
    left = a.select(*keys, F.col(value).alias("a_value"))
    right = b.select(*keys, F.col(value).alias("b_value"))
    return left.join(right, list(keys)).withColumn("diff", F.col("b_value") - F.col("a_value"))


def keep_known(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """JON-17, semi form."""
    return df.join(other.select(*keys).distinct(), list(keys), "left_semi")


def drop_known(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """JON-17, anti form."""
    return df.join(other.select(*keys).distinct(), list(keys), "left_anti")


def audit_join(trades: DataFrame, flags: DataFrame, keys: Sequence[str], flag: str, group: Sequence[str]) -> DataFrame:
    """JON-18: trades with their audit flag, and how many trades the audit covers and flags."""
    got = trades.join(flags.select(*keys, F.col(flag).alias("_f")), list(keys), "left")
    return got.groupBy(*group).agg(
        F.count("*").alias("trades"), F.count("_f").alias("covered"),
        F.sum(F.coalesce(F.col("_f").cast("int"), F.lit(0))).alias("flagged"))


def interval_flag(df: DataFrame, intervals: DataFrame, by: Sequence[str], name: str = "flag", ts: str = "ts",
                  lo: str = "s", hi: str = "e", slice_width: int | None = None) -> DataFrame:
    """PRJ-11: whether some interval of the key has lo <= ts < hi: the furthest end among those begun is past ts."""
    got = prefix_at(df, intervals, by, {"_e": ("max", F.col(hi))}, ts, lo, slice_width=slice_width)
    return got.withColumn(name, F.coalesce(F.col("_e") > F.col(ts), F.lit(False))).drop("_e")


def twin_pairs(trades: DataFrame, twins: DataFrame, pair: str, role: str, value: str, roles: Sequence[str]) -> DataFrame:
    """JON-12: trades with the mean of their twins per role, nulls skipped; a trade without any twin is dropped."""
    means = twins.groupBy(pair).agg(
        *[F.avg(F.when(F.col(role) == r, F.col(value))).alias(f"twin_{r}") for r in roles],
        F.count(value).alias("n_twins"))
    return trades.join(means.filter("n_twins > 0"), pair)


def closed_before(events: DataFrame, outcomes: DataFrame, by: str, closed: str, value: str, ts: str = "ts",
                  slice_width: int | None = None) -> DataFrame:
    """JON-15: per event, count, sum, best and log-sum of the key's outcomes closed at or before it."""
    v = F.col(value)
    return prefix_at(events, outcomes, [by], {
        "n_closed": ("count", v), "sum_closed": ("sum", v), "best_closed": ("max", v),
        "logsum_closed": ("sum", F.log(v)),
    }, ts, closed, slice_width=slice_width)
