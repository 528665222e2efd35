"""Cleaning (CLN): bad-print guard, consistency checks, stream holes, order audit, coverage flags."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import DAY, bucket
from tidemark.operators import joins as J
from tidemark.operators.slicing import ordered_fold, running

ORDER = ("ts", "blk", "li")


class BandFilter:
    """The bad-print rule over one key's valid prints: a reference window of kept prices and at most one pending outlier.

    Prints inside the band around the window's upper median are found a stretch at a time, by the medians of all windows that the stretch
    would pass through. Only prints outside are looked at one by one, against the pending outlier.
    """

    def __init__(self, band: float, size: int, min_n: int, confirm: float, absorbing: bool, state: dict | None = None):
        self.band, self.size, self.min_n, self.confirm, self.absorbing = band, size, min_n, confirm, absorbing
        state = state or {}
        self.kept, self.pending = list(state.get("kept", [])), state.get("pending")

    def state(self) -> dict:
        return {"kept": self.kept, "pending": self.pending}

    def flags(self, prices: Sequence[float]) -> np.ndarray:
        """Whether each of the next prices is kept."""
        p = np.asarray(prices, dtype=np.float64)
        out, at, reach = np.zeros(len(p), dtype=bool), 0, 16
        while at < len(p):
            full = len(self.kept) == self.size
            stretch = p[at:at + reach] if full else p[at:at + 1]
            refs = self._references(stretch) if full else np.array([self._reference()])
            with np.errstate(over="ignore"):
                side = np.where(stretch > refs * self.band, 1, 0) - np.where(stretch < refs / self.band, 1, 0)
            outside = np.flatnonzero(side)
            inside = int(outside[0]) if len(outside) else len(stretch)
            if inside:
                out[at:at + inside] = True
                self.kept = [*self.kept, *stretch[:inside].tolist()][-self.size:]
                self.pending = None
                reach = min(2 * reach, 4096)
            at += inside
            if inside < len(stretch):
                out[at] = self._outlier(int(side[inside]), float(stretch[inside]))
                at, reach = at + 1, 16
        return out

    def _reference(self) -> float:
        """Upper median of the window; a window that is too short puts no print outside."""
        return float(np.sort(self.kept)[len(self.kept) // 2]) if len(self.kept) >= self.min_n else np.nan

    def _references(self, stretch: np.ndarray) -> np.ndarray:
        """The reference before each print of a stretch, if all prints before it are kept."""
        windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([self.kept, stretch[:-1]]), self.size)
        return np.partition(windows, self.size // 2, axis=1)[:, self.size // 2]

    def _outlier(self, side: int, px: float) -> bool:
        """A print on ``side`` of the band restarts the window if it confirms the pending one, else it becomes the pending one."""
        if self.absorbing:
            return False
        agrees = self.pending is not None and self.pending[0] == side and 1 / self.confirm <= px / self.pending[1] <= self.confirm
        self.pending = None if agrees else [side, px]
        if agrees:
            self.kept = [px] * self.min_n
        return agrees


def valid_prints(px: Sequence, usd: Sequence, quote: Sequence | None, first_quote):
    """(mask of prints with a price, at least 1 USD and the key's first quote, that quote)."""
    p, u = pd.to_numeric(pd.Series(px), errors="coerce"), pd.to_numeric(pd.Series(usd), errors="coerce").fillna(0.0)
    ok = (p > 0) & (u >= 1)
    if quote is not None:
        q = pd.Series(quote)
        if first_quote is None and q.notna().any():
            first_quote = q[q.notna()].iloc[0]
            first_quote = first_quote.item() if hasattr(first_quote, "item") else first_quote
        ok &= (q == first_quote) if first_quote is not None else q.isna()
    return ok.to_numpy(), first_quote


def bad_print_guard(
    df: DataFrame, key: Sequence[str], order: Sequence[str] = ORDER, band: float = 20.0, window: int = 15, min_n: int = 5,
    confirm: float = 2.0, quote: str | None = None, absorbing: bool = False, **fold,
) -> DataFrame:
    """CLN-1: adds ``accepted``. Sequential over the accepted prints of a key, so it runs as an ordered fold.

    Prints without price, below 1 USD or in another quote than the key's first are rejected and leave no trace. With
    ``absorbing`` (CLN-2) out-of-band prints are always rejected.
    """
    def kernel(state, rows):
        state = state or {}
        g = BandFilter(band, window, min_n, confirm, absorbing, state.get("guard"))
        flags, first = valid_prints(rows["px"].tolist(), rows["usd"].tolist(), rows[quote].tolist() if quote else None, state.get("quote"))
        flags = np.array(flags)
        flags[flags] = g.flags(rows["px"].to_numpy(dtype=float)[flags])
        return {"guard": g.state(), "quote": first}, {"accepted": flags.tolist()}
    return ordered_fold(df, key, order, kernel, [("accepted", "boolean")], reads=["px", "usd", *([quote] if quote else [])], **fold)


def bad_print_guard_absorbing(df: DataFrame, key: Sequence[str], **kw) -> DataFrame:
    """CLN-2: the older rule, in which a rejected print never enters the reference."""
    return bad_print_guard(df, key, absorbing=True, **kw)


def guard_with_main_pool(
    df: DataFrame, key: Sequence[str] = ("tok",), order: Sequence[str] = ORDER, pool: str = "pool", ratio: float = 2.0,
    ref_age: int = 3600, half_life: int = 6 * 3600, band: float = 20.0, window: int = 15, min_n: int = 5, confirm: float = 2.0,
    **fold,
) -> DataFrame:
    """CLN-3: main-pool consistency and guard in one fold, because each decides what the other sees.

    A print on a side pool is dropped, before the guard sees it, when the main pool printed within ``ref_age`` at a
    price more than ``ratio`` away. The state holds one (volume, time, price) triple per pool of the key.
    """
    def kernel(state, rows):
        pools = dict((state or {}).get("pools", {}))
        g = BandFilter(band, window, min_n, confirm, False, (state or {}).get("guard"))
        usable, _ = valid_prints(rows["px"].tolist(), rows["usd"].tolist(), None, None)
        acc, chk = [], []
        for ts, pk, px, usd, fine in zip(rows["ts"].tolist(), rows[pool].tolist(), rows["px"].tolist(), rows["usd"].tolist(), usable.tolist()):
            checked, fits = None, True
            main = max(pools, key=lambda k: pools[k][0] * 2.0 ** (-(ts - pools[k][1]) / half_life)) if pools else pk
            if main != pk:
                _, t0, ref = pools[main]
                checked = bool(ts - t0 <= ref_age)
                fits = not checked or 1 / ratio <= px / ref <= ratio
            ok = fits and fine and bool(g.flags([px])[0])
            if ok:
                v, t0, _ = pools.get(pk, (0.0, ts, 0.0))
                pools[pk] = [v * 2.0 ** (-(ts - t0) / half_life) + (usd or 0.0), int(ts), float(px)]
            acc.append(bool(ok))
            chk.append(checked)
        return {"pools": pools, "guard": g.state()}, {"accepted": acc, "checked": chk}
    return ordered_fold(df, key, order, kernel, [("accepted", "boolean"), ("checked", "boolean")], **fold)


def main_pool_consistency(df: DataFrame, main: str = "main", ratio: float = 2.0, ref_age: int = 3600,
                          slice_width: int | None = None) -> DataFrame:
    """CLN-3, feed-forward: compare side-pool prints with the main pool's last print. ``main`` names the main pool.

    A last price of zero gives no ratio: the print is not checked and stays.
    """
    ref = df.select("tok", F.col("pool").alias(main), "ts", "blk", "px")
    got = J.asof_backward(df, ref, ["tok", main], "_m", ref_age, left_ts="ts", tie=("blk",), columns=("ts", "px"),
                          slice_width=slice_width)
    side = F.col(main).isNotNull() & (F.col(main) != F.col("pool"))
    q = F.try_divide("px", "_m.px")
    return (got.withColumn("checked", side & F.coalesce(F.col("_m.px") > 0, F.lit(False)))
            .withColumn("keep", F.when(F.col("checked"), q.between(1 / ratio, ratio)).otherwise(F.lit(True))).drop("_m"))


def mislabelled_pools(rows: DataFrame, prints: DataFrame, row_id: str, liq: str, truth: str, max_age: int,
                      slice_width: int | None = None) -> DataFrame:
    """CLN-4: per row, whether the liquidity it shows belongs to another pool of the token, against the truth.

    Suspect when the labelled pool's last liquidity differs and a sibling pool last showed exactly this value;
    unjudgeable when the labelled pool has no state.
    """
    st = J.state_by_pool_at(rows.withColumnRenamed("pool", "_lab"), prints, max_age=max_age, tie=("blk",),
                            columns=("ts", liq), strict=True, slice_width=slice_width)
    same = F.col(f"state.{liq}") == F.col(liq)
    own = F.col("pool") == F.col("_lab")
    seen = st.groupBy(row_id).agg(F.max(own.cast("int")).alias("_own"), F.max((own & same).cast("int")).alias("_own_same"),
                                  F.max((~own & same).cast("int")).alias("_sib"))
    out = rows.join(seen, row_id, "left")
    has = F.coalesce("_own", F.lit(0)) == 1
    sus = (F.col("_own_same") == 0) & (F.col("_sib") == 1)
    t = F.col(truth)
    return out.withColumn("judgement", F.when(~has, "unjudgeable").when(sus & t, "tp").when(sus, "fp").when(t, "miss").otherwise("tn")).drop(
        "_own", "_own_same", "_sib")


def quote_ref_jump(calls: DataFrame, prints: DataFrame, key: Sequence[str], row_id: str, px_a: str, px_b: str, within: int,
                   limit: float = 3.0, fine: int = 3600, coarse: int = DAY) -> DataFrame:
    """CLN-5: peak multiple in one currency against that in the other; a ratio beyond ``limit`` flags a reference jump."""
    from tidemark.operators.ranges import range_extreme
    pos = calls.withColumn("_lo", F.col("ts") + 1).withColumn("_hi", F.col("ts") + within)
    for c, n in ((px_a, "a"), (px_b, "b")):
        pos = range_extreme(pos, prints, key, [row_id], F.col(c), "_lo", "_hi", ("ts", c), ("ts", "blk"), fine, coarse, f"_{n}")
    a, b = F.try_divide(f"_a.{px_a}", "base_a"), F.try_divide(f"_b.{px_b}", "base_b")
    r = F.greatest(F.try_divide(a, b), F.try_divide(b, a))
    return pos.withColumn("mult_a", a).withColumn("mult_b", b).withColumn("jump", r > limit).drop("_a", "_b", "_lo", "_hi")


def stream_holes(df: DataFrame, gap: int, width: int = 3600, slice_len: int = 24 * 365) -> DataFrame:
    """CLN-6: gaps of the merged stream of at least ``gap``, found on one row per time bucket."""
    b = df.groupBy(bucket("ts", width).alias("b")).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    inner = df.select("ts", bucket("ts", width).alias("b")).distinct().withColumn(
        "p", F.lag("ts").over(Window.partitionBy("b").orderBy("ts"))).select(F.col("p").alias("from_ts"), F.col("ts").alias("to_ts"))
    cross = running(b.withColumn("_k", F.lit(0)), ["_k"], ["b"], {"p": ("last", F.col("hi"))},
                    F.floor(F.col("b") / slice_len), False).select(F.col("p").alias("from_ts"), F.col("lo").alias("to_ts"))
    holes = cross if gap >= width else cross.unionByName(inner)
    return holes.filter(F.col("to_ts") - F.col("from_ts") >= gap)


SHARES = 64


def truncate_at_holes(pos: DataFrame, holes: DataFrame, entry: str, exit_: str, slice_width: int | None = None) -> DataFrame:
    """CLN-6: positions that a hole begins inside of get status ``trunc`` and end where the hole begins."""
    # holes are few; each is copied to every share of the positions, so that no task holds all positions of a time
    h = holes.select(F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("_k"), F.col("from_ts"))
    share = F.pmod(F.xxhash64(*[F.col(c) for c in pos.columns]), F.lit(SHARES)).cast("int")
    got = J.asof_forward(pos.withColumn("_k", share), h, ["_k"], "_h", left_ts=entry, right_ts="from_ts", slice_width=slice_width)
    cut = F.col("_h.from_ts") < F.col(exit_)
    return got.withColumn("status", F.when(cut, "trunc").otherwise("ok")).withColumn(
        "end_ts", F.when(cut, F.col("_h.from_ts")).otherwise(F.col(exit_))).drop("_k", "_h")


def order_audit(df: DataFrame, file: str, seq: str, ts: str = "ts", slice_len: int = 1_000_000) -> DataFrame:
    """CLN-7: per file, rows out of time order, the largest lateness behind the running maximum, and its first / last time."""
    got = running(df, [file], [seq], {"_prev": ("last", F.col(ts)), "_max": ("max", F.col(ts))},
                  F.floor(F.col(seq) / slice_len), include_current=False)
    late = F.greatest(F.col("_max") - F.col(ts), F.lit(0))
    return got.groupBy(file).agg(
        F.count("*").alias("rows"), F.sum(F.coalesce((F.col(ts) < F.col("_prev")).cast("int"), F.lit(0))).alias("inversions"),
        F.max(F.coalesce(late, F.lit(0))).alias("max_late"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def coverage_flags(df: DataFrame, rules: dict[str, object], name: str = "flags") -> DataFrame:
    """CLN-8: array of the names of the rules a row meets, in the order given."""
    return df.withColumn(name, F.array_compact(F.array(*[F.when(cond, F.lit(n)) for n, cond in rules.items()])))
