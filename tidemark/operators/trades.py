"""Signals, entries, exits and selection (TRD).

An outcome depends only on its entry and the prints after it, so all candidates are priced as sets first; the rules
that depend on other positions (held, cool-down, capacity) then select among them in an ordered fold.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import DAY, HOUR, bucket, hash_u32
from tidemark.operators import joins as J
from tidemark.operators.features import thin
from tidemark.operators.ladder import Ladder, with_ranks
from tidemark.operators.ranges import first_crossing, last_below, range_extreme
from tidemark.operators.slicing import SLICE, ordered_fold, running, with_halo, width_or_layout
from tidemark.session import cut_lineage

ORDER = ("ts", "blk", "li")


def assessment_grid(prints: DataFrame, births: DataFrame | None = None, bad: DataFrame | None = None, width: int = HOUR,
                    min_age: int = HOUR) -> DataFrame:
    """TRD-1: (coin, T) for every whole T with a print of the coin in the hour before, old enough and not flagged."""
    g = prints.groupBy("tok", bucket("ts", width).alias("_b")).agg(F.count("*").alias("n_prev")).withColumn(
        "T", (F.col("_b") + 1) * width).drop("_b")
    first = prints.groupBy("tok").agg(F.min("ts").alias("first_ts"))
    if births is not None:
        first = first.join(births, "tok", "left").select("tok", F.least("first_ts", "birth_ts").alias("first_ts"))
    g = g.join(first, "tok").withColumn("age", F.col("T") - F.col("first_ts")).filter(F.col("age") >= min_age).drop("first_ts")
    if bad is not None:
        g = J.interval_flag(g, bad, ["tok"], "_bad", "T").filter("not _bad").drop("_bad")
    return g


def eligible(grid: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """TRD-2: first rule that fails as ``drop_reason`` (null = eligible); an unmeasurable value fails.

    The rules may refer to cell columns attached with ``project.with_cells``.
    """
    reason = F.lit(None).cast("string")
    for name, cond in reversed(list(rules)):
        reason = F.when(~F.coalesce(cond, F.lit(False)), F.lit(name)).otherwise(reason)
    return grid.withColumn("drop_reason", reason)


def dip_candidates(prints: DataFrame, elig: DataFrame, width: int, cond: Column) -> DataFrame:
    """TRD-3: prints in [T, T + width) of eligible (coin, T, cell) rows that meet the cell's signal condition."""
    p = prints.withColumn("T", bucket("ts", width) * width)
    return p.join(elig, ["tok", "T"]).filter(cond)


def call_candidates(calls: DataFrame, delays: Sequence[int], tps: Sequence[float]) -> DataFrame:
    """TRD-4: first call of each caller on a coin, mirrors left out, once per (delay, target)."""
    first = calls.filter(~F.col("mirror")).groupBy("tok", "caller").agg(F.min_by(F.struct("id", "ts"), F.struct("ts", "id")).alias("c"))
    dials = F.array(*[F.struct(F.lit(d).alias("delay"), F.lit(float(x)).alias("tp")) for d in delays for x in tps])
    return first.select("tok", "caller", "c.id", "c.ts", F.explode(dials).alias("d")).select(
        "id", "tok", "caller", "ts", "d.delay", "d.tp")


def priceable(min_usd: float) -> Column:
    return (F.col("kind") == "v4") | (F.col("usd") >= min_usd)


def with_next_priceable(prints: DataFrame, by: Sequence[str], min_usd: float = 10.0, slice_width: int | None = None) -> DataFrame:
    """Adds ``nx``, the next print of the pool that can be priced, and ``rk``, the print's rank from the end of its pool.

    Between a time and the next print nothing changes, so "the last print at t" and "the first priceable print after t" come from one
    as-of on such prints. One pass from the end gives both columns.
    """
    cols = [c for c in ("ts", "blk", "px", "usd", "kind", "depth1_eth") if c in prints.columns]
    return with_ranks(prints, by, ORDER, {"nx": ("last", F.when(priceable(min_usd), F.struct(*cols)))}, slice_width)


def entry_last_state(cands: DataFrame, prints: DataFrame, by: Sequence[str], lat: int = 60, wait: int = HOUR,
                     min_usd: float = 10.0, depth_floor: float = 0.001, slice_width: int | None = None) -> DataFrame:
    """TRD-5: enter at the pool's last state at sig + lat; if that cannot be priced, at the next print within ``wait`` that can.

    ``prints`` carries kind, usd, px and depth1_eth, and ``nx`` and ``rk`` if it was prepared. Status: ok, nofill, skipDepth. ``entry_rk`` is the
    rank of the last print at sig + lat: the exit rules search behind it, and behind the entry's own print.
    """
    cols = ("ts", "blk", "px", "usd", "kind", "depth1_eth")
    if "nx" not in prints.columns:
        prints = with_next_priceable(prints, by, min_usd, slice_width)
    state = prints.select(*by, *ORDER, F.struct(*cols).alias("now"), priceable(min_usd).alias("ok"), "nx", "rk")
    # in front of a pool's first print there is no state, only the first priceable print to wait for
    first = F.min_by(F.struct(F.struct(*cols).alias("nx"), F.col("rk")), F.struct(*ORDER))
    head = prints.filter(priceable(min_usd)).groupBy(*by).agg(first.alias("f")).select(*by, "f.nx", "f.rk").withColumn(
        "ts", F.lit(-(2 ** 40))).withColumn("ok", F.lit(False))
    c = J.asof_backward(cands.withColumn("_at", F.col("ts") + lat), state.unionByName(head, allowMissingColumns=True), by, "_l",
                        left_ts="_at", tie=("blk",), columns=("ts", "now", "ok", "nx", "rk"), slice_width=slice_width)
    now, later = F.coalesce(F.col("_l.ok"), F.lit(False)), F.col("_l.nx.ts") <= F.col("_at") + wait
    out = c.withColumn("_e", F.when(now, F.col("_l.now")).when(later, F.col("_l.nx")))
    thin_pool = (F.col("_e.kind") == "v4") & (F.col("_e.depth1_eth") < depth_floor)
    return out.withColumn("status", F.when(F.col("_e").isNull(), "nofill").when(thin_pool, "skipDepth").otherwise("ok")).withColumn(
        "entry_ts", F.greatest(F.col("_e.ts"), F.when(F.col("_e").isNotNull(), F.col("_at")))).withColumn(
        "entry_blk", F.col("_e.blk")).withColumn("entry_px", F.col("_e.px")).withColumn("entry_rk", F.col("_l.rk")).withColumn(
        "entry_delay", F.when(now, F.lit(0)).otherwise(F.col("_e.ts") - F.col("_at"))).drop("_at", "_l", "_e")


def entry_first_print(cands: DataFrame, prints: DataFrame, row_id: Sequence[str], delay: str, tol: int = 300,
                      cost: Column | None = None, fresh: int = 1800, slice_width: int | None = None) -> DataFrame:
    """TRD-6: first print of the coin at or after call + delay within ``tol``; bought on the cheapest fresh pool then."""
    c = cands.withColumn("_at", F.col("ts") + F.col(delay))
    got = J.asof_forward(c, prints, ["tok"], "_f", tol, left_ts="_at", tie=("blk",), columns=("ts", "px", "pool"), slice_width=slice_width)
    got = got.filter(F.col("_f").isNotNull()).withColumn("fill_ts", F.col("_f.ts")).withColumn("fill_lag", F.col("_f.ts") - F.col("_at")).withColumn(
        "fill_px", F.col("_f.px")).drop("_at", "_f")
    if cost is None:
        return got
    best = J.cheapest_pool(got, prints, row_id, cost, left_ts="fill_ts", max_age=fresh, tie=("blk",), slice_width=slice_width)
    return got.join(best.select(*row_id, "best_pool", F.col("best_state.px").alias("best_px")), list(row_id), "left")


def other_extreme(prints: DataFrame, by: Sequence[str], tx: str, lookback: int, high: bool, name: str,
                  slice_width: int | None = None) -> DataFrame:
    """Extreme price of the other transactions in (t - lookback, t], as a property of the print.

    Prints of one transaction share their second, so earlier seconds are other transactions; within the second the
    best and the best of the rest decide.
    """
    pick = F.max if high else F.min
    far = Window.partitionBy(*by, SLICE).orderBy("ts").rangeBetween(-lookback + 1, -1)
    sec = Window.partitionBy(*by, SLICE, "ts")
    wide = with_halo(prints, "ts", max(width_or_layout(slice_width), lookback), lookback)
    one = wide.withColumn("_f", pick("px").over(far)).withColumn("_b", pick(F.struct("px", tx)).over(sec))
    two = one.withColumn("_r", pick(F.when(F.col(tx) != F.col(f"_b.{tx}"), F.col("px"))).over(sec))
    near = F.when(F.col(tx) == F.col(f"_b.{tx}"), F.col("_r")).otherwise(F.col("_b.px"))
    best = F.greatest("_f", near) if high else F.least("_f", near)
    return two.filter("_own").withColumn(name, best).drop("_f", "_b", "_r", "_own", SLICE)


DEEP = 0.10  # own impact up to which a print of a pool counts as deep


def exit_first_hit(pos: DataFrame, prints: DataFrame, by: Sequence[str], row_id: Sequence[str], data_end: int, slopes: Sequence[float] = (0.0,),
                   clips: Sequence[float] = (0.0,), tp_lat: int = 60, wait: int = DAY, min_usd: float = 10.0, drain: float = 0.05, deep: float = DEEP,
                   markup: float = 1.5, slice_width: int | None = None, each: str | None = None) -> DataFrame:
    """TRD-7: earliest of drain, target and deadline, on the entry pool only and among the prints after the entry's.

    ``pos``: entry_ts, entry_blk, entry_rk, entry_px (what was paid), entry_raw (the price of the entry's print; entry_px if absent), deadline, tp_line and
    clip (size; 0 if absent). ``prints``: px, usd, kind, ``impact`` (price move by a size of one, null where the pool has no depth), ``low_other``
    (lowest price of other transactions in the half hour before), and nx and rk of ``with_next_priceable``.

    A position's own sale moves a v4 pool by w = clip / entry_px * impact. The target is met by px / (1 + w) >= tp_line (w = 0 elsewhere, there the
    print must be priceable). A drain is a print below ``drain`` of the entry that is deep (w up to ``deep``) or that another transaction confirmed
    below twice that level. A target is booked at the last print up to ``tp_lat`` after its trigger, a deadline at the last print before it. If that cannot be
    priced, the position waits up to ``wait`` for a print that can be, and may be drained meanwhile; then the last print is a fallback (fb). What is open at
    ``data_end`` ends there. Reasons: drain, tp, time, fb, end.

    Target and drain are one search on a ladder of ranks (``ladder.Ladder``), whatever the number of prints between. px / (1 + w) >= line means
    px - k * impact >= line with k = line * clip / entry_px, which is the target multiple times the size and so takes as many values as there are
    cells: ``slopes``. A bucket carries the maximum of px - k * impact for each, and for each of ``clips`` the least entry price that one of its prints
    drains if a position paid up to ``markup`` times the raw price. For other slopes, sizes and mark-ups the next lower value gives a hopeful bound.

    ``each`` names an array of ``pos``: structs of tp_line, deadline and what else tells apart the rules that share an entry (a short, fixed list). The
    result has a row for each, with the struct's fields as columns. Rules share what they have in common: one search for the drain, one for each target, one
    state for each time of booking. Searches end where no rule of the entry can use a hit any more.
    """
    if "nx" not in prints.columns or "rk" not in prints.columns:
        prints = with_next_priceable(prints, by, min_usd, slice_width)
    ks, sizes = sorted({0.0, *map(float, slopes)}), sorted({0.0, *map(float, clips)})
    v4 = F.col("kind") == "v4"
    own = F.when(v4, F.col("impact")).otherwise(0.0)
    confirmed = F.greatest(F.col("px") / drain, F.col("low_other") / (2 * drain))
    most = {f"_m{i}": F.when(priceable(min_usd), F.col("px") - k * own) for i, k in enumerate(ks)}
    least = {f"_s{i}": F.when(v4 & F.col("impact").isNotNull(), F.greatest(F.col("px") / drain, F.col("impact") * (c / (deep * markup)))) for i, c in enumerate(sizes)}
    least["_so"] = F.when(F.col("low_other").isNotNull(), confirmed)
    least["_t"] = F.col("ts")
    columns = ("ts", "blk", "px")
    ladder = Ladder(prints.withColumn("_ok", priceable(min_usd)).withColumn("_own", own), by, most, least,
                    ["ts", "blk", "px", "kind", "impact", "low_other", "_ok", "_own"])
    raw = F.col("entry_raw") if "entry_raw" in pos.columns else F.col("entry_px")
    clip = F.col("clip").cast("double") if "clip" in pos.columns else F.lit(0.0)
    own_rule = [each] if each else ["deadline", "tp_line"]
    base = cut_lineage(pos.withColumn("_clip", clip).withColumn("_raw", raw).withColumn("_each", F.col(each) if each else F.array(F.struct(*own_rule))).drop(*own_rule))
    until = F.array_max(F.transform("_each", lambda r: r["deadline"]))
    targets = F.array_distinct(F.transform("_each", lambda r: r["tp_line"].cast("double")))
    asks = F.concat(F.transform(targets, lambda x: F.struct(F.lit(0).alias("_what"), x.alias("_line"), F.least(until - 1, F.lit(data_end)).alias("_end"))), F.array(
        F.struct(F.lit(1).alias("_what"), F.lit(None).cast("double").alias("_line"), F.least(until + max(tp_lat, 0) + wait, F.lit(data_end)).alias("_end"))))
    want = base.select(*dict.fromkeys([*by, *row_id]), "_raw", F.try_divide("_clip", "entry_px").alias("_c"), "_clip", (F.col("entry_rk") + 1).alias("lo"),
                       F.col("entry_ts").alias("_ets"), F.col("entry_blk").alias("_eblk"), asks.alias("_asks"))
    want = want.withColumn("_size", F.when(F.col("_raw") * F.col("_c") * markup >= F.col("_clip"), F.col("_clip")).otherwise(0.0))
    near = 1e-9  # the bounds are compared with this much room, the conditions themselves exactly

    def lower(values: list[float], x: Column, name: str) -> Column:
        """The bound of the largest value that ``x`` reaches; x is never below 0."""
        case = F.col(f"{name}0")
        for i, v in enumerate(values[1:], 1):
            case = F.when(x >= v * (1 - 1e-12), F.col(f"{name}{i}")).otherwise(case)
        return case

    def may() -> Column:
        up = lower(ks, F.col("_c") * F.col("_line"), "_m") >= F.col("_line") * (1 - near)
        room = F.col("_raw") * (1 + near)
        down = F.coalesce(lower(sizes, F.col("_size"), "_s") <= room, F.lit(False)) | F.coalesce(F.col("_so") <= room, F.lit(False))
        return (F.col("_t") <= F.col("_end")) & F.when(F.col("_what") == 0, up).otherwise(down)

    def hit() -> Column:
        up = F.col("_ok") & (F.col("px") / (1 + F.col("_c") * F.col("_own")) >= F.col("_line"))
        is_deep = F.coalesce((F.col("kind") == "v4") & (F.col("_c") * F.col("impact") <= deep), F.lit(False))
        below = F.coalesce(F.col("low_other") < 2 * drain * F.col("_raw"), F.lit(False))
        later = (F.col("ts") > F.col("_ets")) | ((F.col("ts") == F.col("_ets")) & (F.col("blk") > F.col("_eblk")))
        return later & (F.col("ts") <= F.col("_end")) & F.when(F.col("_what") == 0, up).otherwise((F.col("px") < drain * F.col("_raw")) & (is_deep | below))

    hits = ladder.first(want, [*row_id, "_what", "_line"], may, hit, columns, asks="_asks").groupBy(*row_id).agg(
        F.max(F.when(F.col("_what") == 1, F.col("hit"))).alias("_dr"),
        F.collect_list(F.when(F.col("_what") == 0, F.struct("_line", "hit"))).alias("_tps"))  # as many as targets
    got = base.drop("_clip", "_raw").join(hits, list(row_id), "left").withColumn("_dr", F.when(F.col("_dr.ts") <= data_end, F.col("_dr")))

    def reached(r: Column) -> Column:
        tp = F.get(F.filter("_tps", lambda t: t["_line"] == r["tp_line"]), F.lit(0))["hit"]
        return F.struct(r.alias("r"), F.when((tp["ts"] < r["deadline"]) & (tp["ts"] <= data_end), tp).alias("tp"))

    def upto(x: Column) -> Column:
        return F.least(F.when(x["tp"].isNotNull(), x["tp"]["ts"] + tp_lat).otherwise(x["r"]["deadline"] - 1), F.lit(data_end))

    got = got.withColumn("_due", F.transform("_each", reached)).drop("_each", "_tps")
    got = got.withColumn("_upto", F.explode(F.array_distinct(F.transform("_due", upto)))).withColumn("_due", F.filter("_due", lambda x: upto(x) == F.col("_upto")))
    states = prints.select(*by, *ORDER, "px", priceable(min_usd).alias("_ok"), F.struct("nx.ts", "nx.blk", "nx.px").alias("nx"))
    got = cut_lineage(J.asof_backward(got, states, by, "_l", left_ts="_upto", tie=("blk",), columns=("ts", "px", "_ok", "nx"), slice_width=slice_width))
    got = got.withColumn("_x", F.explode("_due")).drop("_due").select("*", "_x.r.*", F.col("_x.tp").alias("_tp")).drop("_x")
    is_tp = F.col("_tp").isNotNull()
    got = got.withColumn("_plan", F.when(is_tp, F.col("_tp.ts") + tp_lat).otherwise(F.col("deadline"))).withColumn("_cut", F.when(is_tp, data_end <= F.col("_plan")).otherwise(data_end < F.col("_plan"))).withColumn(
        "_till", F.least(F.col("_plan") + wait, F.lit(data_end)))
    met = F.coalesce(F.col("_l.nx.ts") <= F.col("_till"), F.lit(False))
    # nothing to price in the wait: the last print of the wait, for the few positions that need it
    open_end = F.coalesce(~F.col("_cut") & ~F.col("_l._ok") & ~met, F.lit(False))
    lost = J.asof_backward(got.filter(open_end), states, by, "_f", left_ts="_till", tie=("blk",), columns=("ts", "px"), slice_width=slice_width)
    got = got.filter(~open_end).withColumn("_fpx", F.lit(None).cast("double")).unionByName(lost.withColumn("_fpx", F.col("_f.px").cast("double")).drop("_f"))
    why = F.when(is_tp, "tp").otherwise("time")
    now = F.col("_l._ok") | F.col("_cut")
    ended = F.when(F.col("_cut") | (F.col("_plan") + wait >= data_end), "end").otherwise("fb")
    reason = F.when(F.col("_l._ok") & ~F.col("_cut"), why).when(F.col("_cut"), "end").when(met, why).otherwise(ended)
    px = F.when(now, F.col("_l.px")).when(met, F.col("_l.nx.px")).otherwise(F.col("_fpx"))
    at = F.when(F.col("_cut"), F.lit(data_end)).when(F.col("_l._ok"), F.col("_plan")).when(met, F.col("_l.nx.ts")).otherwise(F.col("_till"))
    # a drain counts if its print comes before the booking; in the wait up to and with the print that would be booked
    open_ = F.when(now, F.col("_dr.ts") <= F.col("_upto")).when(met, F.struct("_dr.ts", "_dr.blk") <= F.struct("_l.nx.ts", "_l.nx.blk")).otherwise(F.col("_dr.ts") <= F.col("_till"))
    drained = F.col("_dr").isNotNull() & open_
    return got.withColumn("reason", F.when(drained, "drain").otherwise(reason)).withColumn("exit_px", F.when(drained, F.col("_dr.px")).otherwise(px)).withColumn(
        "exit_ts", F.when(drained, F.col("_dr.ts")).otherwise(at)).withColumn("trigger_px", F.col("_tp.px")).drop(
        "_tp", "_dr", "_plan", "_upto", "_l", "_cut", "_till", "_fpx")


def trigger_book(pos: DataFrame) -> DataFrame:
    """TRD-12: return at the price of the print that triggered the target, beside the booked one."""
    return pos.withColumn("ret_trigger", 100 * (F.try_divide(F.coalesce("trigger_px", "exit_px"), F.col("entry_px")) - 1)).withColumn(
        "ret_booked", 100 * (F.try_divide("exit_px", "entry_px") - 1))


def greedy_nonoverlap(cands: DataFrame, by: Sequence[str], order: Sequence[str], start: str, end: str, gap: int = 0, once: str | None = None, **fold) -> DataFrame:
    """TRD-8: take a candidate only if none of its key is open and the cool-down since the last exit is over.

    ``once`` names a column (the hour of the signal) of which each value is spent by the first candidate taken: later ones of it are not taken, even
    if the position is closed by then. A candidate that was not taken spends nothing. Candidates without start or end are not taken.
    """
    def kernel(state, rows):
        free, spent = (state["free"], state["spent"]) if state else (None, None)
        out = []
        for s, e, h in zip(rows[start].tolist(), rows[end].tolist(), rows[once].tolist() if once else [None] * len(rows), strict=True):
            ok = s is not None and e is not None and (free is None or s >= free) and (once is None or h != spent)
            if ok:
                free, spent = int(e) + gap, h
            out.append(ok)
        return {"free": free, "spent": spent}, {"taken": out}
    return ordered_fold(cands, by, order, kernel, [("taken", "boolean")], reads=[c for c in (start, end, once) if c], **fold)


def capacity_select(cands: DataFrame, cell: str, order: Sequence[str], tok: str, start: str, end: str, cap: int, gap: int = 0,
                    **fold) -> DataFrame:
    """TRD-9 with TRD-8: at most ``cap`` open positions per cell, one per coin with its cool-down.

    The state holds the open exits and the coins still held or cooling, both pruned as time passes.
    """
    def kernel(state, rows):
        open_, busy = list((state or {}).get("open", [])), dict((state or {}).get("busy", {}))
        out = []
        for k, s, e in zip(rows[tok].astype(str).tolist(), rows[start].tolist(), rows[end].tolist()):
            while s is not None and open_ and open_[0] <= s:
                heapq.heappop(open_)
            if s is None or e is None:
                out.append("undated")
            elif busy.get(k, s) > s:
                out.append("held")
            elif len(open_) >= cap:
                out.append("cap")
            else:
                out.append("taken")
                heapq.heappush(open_, int(e))
                busy[k] = int(e) + gap
        now = max((int(s) for s in rows[start] if s is not None), default=0)
        return {"open": sorted(open_), "busy": {k: v for k, v in sorted(busy.items()) if v > now}}, {"status": out}
    return ordered_fold(cands, [cell], order, kernel, [("status", "string")], reads=[tok, start, end], **fold)


def cluster_fixed_origin(events: DataFrame, key: Sequence[str], ts: str = "ts", order: Sequence[str] = ("ts", "id"), gap: int = 180, **fold) -> DataFrame:
    """TRD-20: an event within ``gap`` of the first event of its cluster is a mirror; the first one after that opens the next."""
    return thin(events, key, order, ts, gap + 1, "origin", **fold).withColumn("mirror", ~F.col("origin")).drop("origin")


def marks(pos: DataFrame, prints: DataFrame, by: Sequence[str], row_id: str, holds: Sequence[int], tp: float, end: int,
          rug: float = 0.05, hi: float = 20.0, sale: int = 60, fine: int = HOUR, coarse: int = DAY, slice_width: int | None = None) -> DataFrame:
    """TRD-10: one row per hold with the booked mark and how it came about (rug, tp, hold, noprint, oow).

    ``pos``: ets, epx. ``prints``: ``ok_hi`` says that a price far above any entry is believable; other prints above
    ``hi`` times the entry are ignored. The mark is the last print before the sale; only where that one is ignored, an earlier one is searched.
    """
    # holds that end out of the window have no mark, so nothing is searched behind the last one that does not
    last_end = F.coalesce(*[F.when(F.col("ets") + h + sale <= end, F.col("ets") + h) for h in sorted(holds, reverse=True)], F.col("ets"))
    prints = prints.withColumn("ok_hi", F.coalesce("ok_hi", F.lit(False)))
    base = (pos.withColumn("_lo", F.col("ets") + 1).withColumn("_hm", last_end).withColumn("_tpl", F.col("epx") * tp)
            .withColumn("_rug", -F.col("epx") * rug).withColumn("_cap", F.col("epx") * hi))
    sure, other = prints.filter("ok_hi"), prints.filter("not ok_hi")
    # target: first believable print at the line. Prints without ok_hi must also stay below the cap.
    base = cut_lineage(base)
    a = first_crossing(base, sure, by, [row_id], F.col("px"), "_tpl", "_lo", "_hm", ("ts", "blk", "px"), ORDER, fine, coarse, "_t1")
    # a print without ok_hi may reach the line yet pass the cap: those are found per fine price step below, up to the target found so far
    a = cut_lineage(a.withColumn("_till", F.coalesce("_t1.ts", "_hm")))
    b = a.join(_first_between(a.select(*by, row_id, "_tpl", "_cap", "_lo", "_till"), other, by, row_id, "_tpl", "_cap", "_lo", "_till", fine, coarse, "_t2"), row_id, "left")
    first = F.least(F.struct("_t1.ts", "_t1.blk"), F.struct("_t2.ts", "_t2.blk"))
    c = b.withColumn("_tp_ts", F.when(F.col("_t1").isNull(), F.col("_t2.ts")).when(F.col("_t2").isNull(), F.col("_t1.ts")).otherwise(first["ts"]))
    # a fall counts before the target only
    c = cut_lineage(c.withColumn("_fall", F.coalesce(F.col("_tp_ts") - 1, "_hm")))
    c = cut_lineage(first_crossing(c, prints, by, [row_id], -F.col("px"), "_rug", "_lo", "_fall", ("ts", "px"), ORDER, fine, coarse, "_r", above=True))
    h = c.withColumn("hold", F.explode(F.array(*[F.lit(x) for x in holds]))).withColumn("_end", F.col("ets") + F.col("hold"))
    is_tp = F.col("_tp_ts").isNotNull() & (F.col("_tp_ts") <= F.col("_end"))
    is_rug = F.col("_r").isNotNull() & (F.col("_r.ts") <= F.col("_end")) & (
        ~is_tp | (F.col("_tp_ts") > F.col("_r.ts")))
    h = h.withColumn("_how", F.when(F.col("_end") + sale > end, "oow").when(is_rug, "rug").when(is_tp, "tp").otherwise("hold"))
    h = h.withColumn("_at", F.when(F.col("_how") == "tp", F.col("_tp_ts") + sale).otherwise(F.col("_end"))).withColumn(
        "_mid", F.concat_ws(":", row_id, "hold"))
    h = J.asof_backward(h, prints, by, "_a", left_ts="_at", tie=("blk",), columns=("ts", "blk", "px", "ok_hi"), slice_width=slice_width)
    after = F.coalesce(F.col("_a.ts") > F.col("ets"), F.lit(False))
    good = F.coalesce(F.col("_a.ok_hi") | (F.col("_a.px") <= F.col("_cap")), F.lit(False))
    h = cut_lineage(h.withColumn("_open", after & ~good & F.col("_how").isin("tp", "hold")).withColumn(
        "_m", F.when(after & good, F.struct("_a.ts", "_a.blk", "_a.px"))).drop("_a"))
    rest = J.asof_backward(h.filter("_open").drop("_m"), sure, by, "_a", left_ts="_at", tie=("blk",), columns=("ts", "blk", "px"), slice_width=slice_width)
    rest = last_below(rest, other, by, ["_mid"], F.col("px"), "_cap", "_lo", "_at", ("ts", "blk", "px"), ORDER, fine, coarse, "_b")
    rest = rest.withColumn("_a", F.when(F.col("_a.ts") > F.col("ets"), F.col("_a")))
    later_b = F.col("_b").isNotNull() & (F.col("_a").isNull() | (F.struct("_b.ts", "_b.blk") > F.struct("_a.ts", "_a.blk")))
    rest = rest.withColumn("_m", F.when(later_b, F.col("_b")).otherwise(F.col("_a")))
    h = h.filter("not _open").unionByName(rest.select(*h.columns))
    how = F.when((F.col("_how") == "hold") & F.col("_m").isNull(), "noprint").otherwise(F.col("_how"))
    px = F.when(F.col("_how") == "oow", None).when(F.col("_how") == "rug", F.col("_r.px")).otherwise(F.coalesce("_m.px", "epx"))
    mts = F.when(F.col("_how") == "oow", None).when(F.col("_how") == "rug", F.col("_r.ts")).otherwise(F.coalesce("_m.ts", "ets"))
    keep = pos.columns
    return h.select(*keep, "hold", how.alias("how"), px.alias("mpx"), mts.alias("mts"), (100 * (F.try_divide(px, F.col("epx")) - 1)).alias("g"))


def _first_between(pos, prints, by, row_id, lo_line, hi_line, lo, hi, fine, coarse, name):
    """First print whose price lies in [lo_line, hi_line].

    Both lines scale with the entry, so prices are cut into levels one log step wide: inside the levels that lie fully
    between the lines every print counts, and the two edge levels are checked print by print. A level that no print of the key reaches
    in the range is left out before the range is cut into buckets, and the range ends with the level's first and last print.
    """
    step = 0.25
    level = lambda c: F.floor(F.log2(F.greatest(c, F.lit(1e-300))) / step).cast("long")
    p = prints.withColumn("_lvl", level(F.col("px"))).withColumn("_one", F.lit(1.0))
    lv = pos.withColumn("_lvl", F.explode(F.sequence(level(F.col(lo_line)), level(F.col(hi_line)))))
    inner = (F.col("_lvl") > level(F.col(lo_line))) & (F.col("_lvl") < level(F.col(hi_line)))
    seen = p.groupBy(*by, "_lvl").agg(F.min("ts").alias("_s0"), F.max("ts").alias("_s1"))
    lv = lv.withColumnsRenamed({lo: "_from", hi: "_to"}).join(seen, [*by, "_lvl"]).withColumn(
        lo, F.greatest("_from", "_s0")).withColumn(hi, F.least("_to", "_s1")).filter(F.col(lo) <= F.col(hi)).drop("_from", "_to", "_s0", "_s1")
    ids = lv.withColumn("_rid", F.concat_ws(":", F.col(row_id), F.col("_lvl"))).withColumn("_neg", -F.col(hi_line)).withColumn(
        "_zero", F.lit(0.0))
    mid = first_crossing(ids.filter(inner), p, [*by, "_lvl"], ["_rid"], F.col("_one"), "_zero", lo, hi, ("ts", "blk", "px"), ORDER, fine, coarse, "_c")
    low = first_crossing(ids.filter(F.col("_lvl") == level(F.col(lo_line))), p, [*by, "_lvl"], ["_rid"], F.col("px"), lo_line, lo, hi,
                         ("ts", "blk", "px"), ORDER, fine, coarse, "_c")
    top = first_crossing(ids.filter((F.col("_lvl") == level(F.col(hi_line))) & (level(F.col(hi_line)) > level(F.col(lo_line)))), p,
                         [*by, "_lvl"], ["_rid"], -F.col("px"), "_neg", lo, hi, ("ts", "blk", "px"), ORDER, fine, coarse, "_c")
    hits = mid.select(row_id, "_c").unionByName(low.select(row_id, "_c")).unionByName(top.select(row_id, "_c"))
    return hits.filter(F.col("_c").isNotNull()).groupBy(row_id).agg(F.min_by("_c", F.struct("_c.ts", "_c.blk")).alias(name))


def price_sanity(exits: DataFrame, x: float = 20.0) -> DataFrame:
    """TRD-11: an exit above ``x`` times the entry is believed if the pool is deep or another transaction of the last half
    hour came within half of it; else the other's price, else the last believable one.

    ``exits``: entry_px, exit_px, deep, high_other, last_ok_px.
    """
    p, o = F.col("exit_px"), F.col("high_other")
    big = p > x * F.col("entry_px")
    kind = F.when(~big, None).when(F.col("deep"), "depthok").when(o >= p / 2, "corroborated").when(o.isNotNull(), "c2").otherwise("lastok")
    out = exits.withColumn("g5", kind)
    return out.withColumn("sane_px", F.when(F.col("g5") == "c2", F.least(p, o)).when(F.col("g5") == "lastok", F.col("last_ok_px")).otherwise(p))


def twin_levels(signals: DataFrame, members: DataFrame, hour: Sequence[str], bands: Sequence[Sequence[str]], seed: str, k: int,
                signal_id: Sequence[str], own: str = "tok", member: str = "tok", min_pool: int = 2) -> DataFrame:
    """TRD-13 / TRD-14: draw twins at the first match level whose group holds at least ``min_pool`` members.

    ``bands`` lists the grouping columns from strict to loose; group sizes come from counts, never from pairs. The
    loosest level takes any signal left over.
    """
    sig = signals
    for i, b in enumerate(bands):
        g = [*hour, *b]
        size = members.select(*g, member).distinct().groupBy(*g).agg(F.count("*").alias(f"_n{i}"))
        sig = sig.join(size, g, "left")
    lvl = F.lit(len(bands) - 1)
    for i in range(len(bands) - 2, -1, -1):
        lvl = F.when(F.coalesce(F.col(f"_n{i}"), F.lit(0)) >= min_pool, F.lit(i)).otherwise(lvl)
    sig = sig.withColumn("level", lvl).drop(*[f"_n{i}" for i in range(len(bands))])
    out = None
    for i, b in enumerate(bands):
        g = [*hour, *b]
        d = J.ring_draw(sig.filter(F.col("level") == i).select(*signal_id, *[c for c in (own, *g) if c not in signal_id], "level"),
                        members.select(*g, member).distinct(), g, member, k, f"{seed}{i}", signal_id, own)
        d = d.select(*signal_id, "level", "twin", "draw", "n_pool")
        out = d if out is None else out.unionByName(d)
    return out


def draw(pool: DataFrame, group: Sequence[str], member: str, k: int, seed: str) -> DataFrame:
    """TRD-15: min(k, n) members per group by hash order. Spark keeps only k rows per group before it shuffles."""
    h = hash_u32(seed, *[F.col(c) for c in group], F.col(member))
    w = Window.partitionBy(*group).orderBy("_h", member)
    return pool.withColumn("_h", h).withColumn("draw", F.row_number().over(w)).filter(F.col("draw") <= k).drop("_h")


def exit_overlays(pos: DataFrame, rules: Sequence[dict], name: str = "rules", when: Callable[[Column], Column] | None = None) -> DataFrame:
    """TRD-16: every entry under every exit rule: the array ``name`` for ``exit_first_hit``, with deadline, tp_line and the rule's own fields.

    ``when`` says whether a rule holds for an entry; entries without a rule drop out. ``rules`` is a fixed parameter list.
    """
    cells = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in r.items()]) for r in rules])
    if when is not None:
        cells = F.filter(cells, when)
    out = pos.withColumn(name, F.transform(cells, lambda r: F.struct(
        *[r[n].alias(n) for n in rules[0] if n not in ("tp", "hold")], (F.col("entry_ts") + r["hold"]).alias("deadline"), (F.col("entry_px") * r["tp"]).alias("tp_line"))))
    return out if when is None else out.filter(F.size(name) > 0)


def clip_shadows(pos: DataFrame, clips: Sequence[float], depth: str, s1: float = 1.01 ** 0.5 - 1, limit: float = 0.10) -> DataFrame:
    """TRD-17: the same entries at other sizes; own impact above ``limit`` does not scale."""
    out = pos.withColumn("clip", F.explode(F.array(*[F.lit(float(c)) for c in clips])))
    u = F.try_divide(F.col("clip") * s1, F.col(depth))
    return out.withColumn("impact", u).withColumn("noscale", u > limit).withColumn(
        "ret_clip", 100 * ((1 + F.col("ret") / 100) / ((1 + u) * (1 + u)) - 1))


def latency_probes(pos: DataFrame, prints: DataFrame, by: Sequence[str], tags: dict[str, int], slice_width: int | None = None) -> DataFrame:
    """TRD-18: state of the pool at the signal plus each measured latency."""
    arr = F.array(*[F.struct(F.lit(t).alias("tag"), F.lit(s).alias("lat")) for t, s in tags.items()])
    p = pos.withColumn("_t", F.explode(arr)).withColumn("tag", F.col("_t.tag")).withColumn("at", F.col("ts") + F.col("_t.lat")).drop("_t")
    return J.asof_backward(p, prints, by, "probe", left_ts="at", tie=("blk",), columns=("ts", "px"), slice_width=slice_width)


def unsellable(df: DataFrame, ret: str = "ret") -> DataFrame:
    """TRD-19: three readings of "nobody could sell"; such a trade loses everything.

    a: no large sell in the hour, or sells at half the price of buys; b: no sell at all; c: both a and b.
    """
    a = F.coalesce(F.col("sell_big") == 0, F.lit(True)) | F.coalesce(F.col("sell_buy_ratio") < 0.5, F.lit(False))
    b = F.coalesce(F.col("n_sells") == 0, F.lit(True))
    lose = lambda c: F.when(c, F.lit(-100.0)).otherwise(F.col(ret))
    return df.withColumn("ret_a", lose(a)).withColumn("ret_b", lose(b)).withColumn("ret_c", lose(a & b))


def peak_concurrency(pos: DataFrame, cell: Sequence[str], start: str, end: str, slice_width: int | None = None) -> DataFrame:
    """TRD-21: largest number of positions open at once; one that ends when another starts does not overlap it.

    Open counts only change at event times, so +1 / -1 are summed per time first.
    """
    ev = pos.select(*cell, F.explode(F.array(
        F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")))).alias("e")).groupBy(
        *cell, F.col("e.t").alias("t")).agg(F.sum("e.d").alias("d"))
    run = running(ev, cell, ["t"], {"open": ("sum", F.col("d"))}, bucket("t", width_or_layout(slice_width)))
    return run.groupBy(*cell).agg(F.max("open").alias("peak_open"))


def late_regime(calls: DataFrame, candles: DataFrame, key: Sequence[str], row_id: str, day7: int, last: int, fine: int, coarse: int,
                min_vol: float = 100.0) -> DataFrame:
    """TRD-22: after ``day7``: dead, a high above the first day's peak, and the same on sane candles only.

    A sane candle traded at least ``min_vol`` and closed at half its high or more.
    """
    early = calls.withColumn("_lo", F.col("ts") + 1).withColumn("_hi", F.col("ts") + DAY)
    e = range_extreme(early, candles, key, [row_id], F.col("high"), "_lo", "_hi", ("ts", "high"), ("ts",), fine, coarse, "_e")
    e = e.withColumn("_lo", F.col("ts") + day7 + 1).withColumn("_hi", F.col("ts") + last)
    e = range_extreme(e, candles, key, [row_id], F.col("high"), "_lo", "_hi", ("ts", "high"), ("ts",), fine, coarse, "_l")
    sane = candles.filter((F.col("vol") >= min_vol) & (F.col("close") >= F.col("high") / 2))
    e = range_extreme(e, sane, key, [row_id], F.col("high"), "_lo", "_hi", ("ts", "high"), ("ts",), fine, coarse, "_s")
    up = lambda c: F.coalesce(F.col(f"{c}.high") > F.col("_e.high"), F.lit(False))
    return e.withColumn("dead", F.col("_l").isNull()).withColumn("new_high", up("_l")).withColumn("new_high_sane", up("_s")).drop(
        "_lo", "_hi", "_e", "_l", "_s")
