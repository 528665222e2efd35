"""Rolling features (WIN) and the bucket aggregates below them (AGG-1..10).

Bucket aggregates come first; windows then run over buckets, or inside one (key, bucket). No window holds all
prints of a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import DAY, HOUR, bucket, float32
from tidemark.operators import joins as J
from tidemark.operators.ranges import first_crossing, range_extreme
from tidemark.operators.slicing import last_n, ordered_fold, quantiles_linear, running, trailing, width_or_layout
from tidemark.session import cut_lineage

ORDER = ("ts", "blk", "li")


#: Half-lives after which decayed sums start from a new base.
ERA = 256


def bucket_ohlcv(df: DataFrame, key: Sequence[str], width: int) -> DataFrame:
    """AGG-1: open, high, low, close in tape order, volume and count per key and bucket."""
    pos = F.struct(*ORDER)
    return df.groupBy(*key, bucket("ts", width).alias("b")).agg(
        F.min_by("px", pos).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"),
        F.max_by("px", pos).alias("close"), F.sum("usd").alias("vol"), F.count("*").alias("n"))


def pool_lifecycle(df: DataFrame, end: int, liq: str, silent: int = 24 * HOUR, low_share: float = 0.01,
                   slice_width: int | None = None) -> DataFrame:
    """AGG-2: life record of each pool, with the start of its current low-liquidity run.

    A run is low while liquidity is at most ``low_share`` of the running peak; the current run starts after the
    last print that was not low.
    """
    key, pos = ["tok", "pool"], F.struct(*ORDER)
    peak = running(df, key, ORDER, {"peak_so_far": ("max", F.col(liq))}, bucket("ts", width_or_layout(slice_width)))
    low = F.col(liq) <= F.col("peak_so_far") * low_share
    flagged = peak.withColumn("_low", low)
    life = flagged.groupBy(*key).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n_swaps"),
        F.sum((F.col("side") == "buy").cast("int")).alias("n_buys"),
        F.max("px").alias("peak_price"), F.min(F.struct((-F.col("px")).alias("x"), "ts")).alias("_pk"),
        F.max_by("px", pos).alias("last_price"), F.max_by(liq, pos).alias("last_liq"), F.max(liq).alias("peak_liq"),
        F.max(F.when(~F.col("_low"), pos)).alias("_last_ok"))
    runs = (flagged.filter("_low").join(life.select(*key, "_last_ok"), key)
            .filter(F.col("_last_ok").isNull() | (pos > F.col("_last_ok")))
            .groupBy(*key).agg(F.min("ts").alias("drain_ts")))
    out = life.join(runs, key, "left")
    quiet = F.lit(end) - F.col("last_ts")
    return out.select(
        *key, "first_ts", "last_ts", "n_swaps", "n_buys", "peak_price", F.col("_pk.ts").alias("peak_ts"), "last_price",
        "last_liq", "peak_liq", "drain_ts", F.floor(quiet / HOUR).cast("long").alias("silent_h"),
        (quiet >= silent).alias("dead"), F.col("drain_ts").isNotNull().alias("drained"),
        F.when(F.col("drain_ts").isNotNull(), 0.0).otherwise(F.col("last_price")).alias("book_price"))


def pool_counts(df: DataFrame) -> DataFrame:
    """AGG-3: prints and volume per pool."""
    return df.groupBy("tok", "pool").agg(F.count("*").alias("n"), F.sum("usd").alias("vol"))


def unknown_pools(df: DataFrame, known: DataFrame, key: str, ks: Sequence[int] = (10, 200)) -> DataFrame:
    """AGG-4: ids missing from the table with counts and first / last block, and the share the biggest ``ks`` hold."""
    miss = df.join(known.select(key).distinct(), key, "left_anti").groupBy(key).agg(
        F.count("*").alias("n"), F.min("blk").alias("first_blk"), F.max("blk").alias("last_blk"))
    # slices are ranges of (n, id), so the long tail of ids seen once is many of them
    parts = cut_lineage(miss.withColumn("_neg", -F.col("n")).repartitionByRange("_neg", key).withColumn("_s", F.spark_partition_id().cast("long")))
    ranked = running(parts, [], ["_neg", key], {"_rk": ("count", F.col("n"))}, F.col("_s")).drop("_s")
    share = ranked.agg(*[F.try_divide(F.sum(F.when(F.col("_rk") <= k, F.col("n"))), F.sum("n")).alias(f"s{k}") for k in ks])
    return ranked.drop("_neg").withColumnRenamed("_rk", "rank").select(
        key, "n", "first_blk", "last_blk", "rank", *[share.select(f"s{k}").scalar().alias(f"top{k}_share") for k in ks])


def launch_volume(df: DataFrame, label: str, width: int = HOUR) -> DataFrame:
    """AGG-5: volume per label and hour."""
    return df.groupBy(label, bucket("ts", width).alias("hour")).agg(F.sum("usd").alias("vol"), F.count("*").alias("n"))


def log_bands(df: DataFrame, x: str, ps: Sequence[float] = (0.2, 0.4, 0.6, 0.8)) -> DataFrame:
    """AGG-9: percentiles moved to the nearest value, in log space, of the series 1, 2, 2.5, 5 times powers of ten."""
    q = quantiles_linear(df, [], x, {f"q{i}": p for i, p in enumerate(ps)})
    one = q.select(F.explode(F.array(*[
        F.struct(F.lit(p).alias("p"), F.col(f"q{i}").alias("q")) for i, p in enumerate(ps)])).alias("s")).select("s.p", "s.q")
    k = F.floor(F.log10("q"))
    series = F.array(*[F.lit(m) * F.pow(F.lit(10.0), k + d) for d in (0, 1) for m in (1.0, 2.0, 2.5, 5.0)])
    best = F.array_min(F.transform(series, lambda s: F.struct(F.abs(F.log(s) - F.log("q")).alias("d"), s.alias("s"))))
    return one.withColumn("edge", best["s"])


def hour_returns(df: DataFrame, key: Sequence[str], width: int, slice_len: int = 240) -> DataFrame:
    """Close and volume per key and bucket, with the log return against the key's previous bucket and ``none``, the buckets since then that have no return.

    A return needs two positive closes: a bucket that closes at zero has none, nor has any bucket after it up to the next close.
    """
    h = bucket_ohlcv(df, key, width).select(*key, "b", "close", "vol", "n")
    prev = running(h, key, ["b"], {"p": ("last", F.struct("b", "close"))}, F.floor(F.col("b") / slice_len), False)
    p, both = F.col("p.close"), (F.col("close") > 0) & (F.col("p.close") > 0)
    return prev.withColumn("r", F.when(both, F.log(F.try_divide("close", p)))).withColumn(
        "none", F.when(~(p > 0), F.col("b") - F.col("p.b")).when(~(F.col("close") > 0), 1).otherwise(0)).drop("p")


def coin_stats(df: DataFrame, key: Sequence[str], width: int = HOUR, vol_n: int = 24, ret_n: int = 49,
               min_ret: int = 24) -> DataFrame:
    """WIN-7 / AGG-10 at T = end of each bucket with prints: volume of the last ``vol_n`` complete buckets and the
    sample deviation of bucket log returns over ``ret_n`` buckets.

    A bucket without prints repeats the last close seen inside the window, so its return is 0: it adds to the count
    and not to the sums. The first bucket of the window has no return, nor has one whose close or the close before it is zero.
    """
    h = hour_returns(df, key, width)
    span = max(vol_n, ret_n)
    w = lambda n: Window.partitionBy(*key, "_slice").orderBy("b").rangeBetween(-(n - 1), 0)
    from tidemark.operators.slicing import with_halo
    wide = with_halo(h, "b", max(240, span), span)
    got = wide.select(
        *key, "b", "_own", "r", F.sum("vol").over(w(vol_n)).alias("vol_prior"),
        F.first("b").over(w(ret_n)).alias("_b0"), F.first(F.coalesce("r", F.lit(0.0))).over(w(ret_n)).alias("_r0"),
        (F.sum("none").over(w(ret_n)) - F.first("none").over(w(ret_n))).alias("_none"),
        F.sum("r").over(w(ret_n)).alias("_s"), F.sum(F.col("r") * F.col("r")).over(w(ret_n)).alias("_q")).filter("_own")
    n = F.col("b") - F.col("_b0") - F.col("_none")
    s, q = F.coalesce("_s", F.lit(0.0)) - F.col("_r0"), F.coalesce("_q", F.lit(0.0)) - F.col("_r0") * F.col("_r0")
    sd = F.sqrt(F.greatest(q - s * s / n, F.lit(0.0)) / (n - 1))
    return got.select(*key, (F.col("b") + 1).alias("t_bucket"), "vol_prior", n.alias("n_ret"),
                      F.when(n >= min_ret, sd).alias("sd"))


def hot(df: DataFrame, key: Sequence[str], width: int = HOUR, short: int = 6, long: int = 24) -> DataFrame:
    """WIN-8: mean volume of the last ``short`` complete buckets against that of the ``long`` buckets before them."""
    v = df.groupBy(*key, bucket("ts", width).alias("b")).agg(F.sum("usd").alias("vol"))
    from tidemark.operators.slicing import with_halo
    w = lambda lo, hi: Window.partitionBy(*key, "_slice").orderBy("b").rangeBetween(lo, hi)
    wide = with_halo(v, "b", 240, short + long)
    got = wide.select(*key, "b", "_own", F.sum("vol").over(w(-(short - 1), 0)).alias("a"),
                      F.coalesce(F.sum("vol").over(w(-(short + long - 1), -short)), F.lit(0.0)).alias("z")).filter("_own")
    return got.select(*key, (F.col("b") + 1).alias("t_bucket"), (F.col("a") / short > F.col("z") / long).cast("int").alias("hot"))


def decayed_volume(df: DataFrame, key: Sequence[str], half_life: int = 6 * HOUR, slice_width: int | None = None,
                   name: str = "dvol") -> DataFrame:
    """WIN-1: volume with a half-life, including the current print.

    Sums run inside eras of ``ERA`` half-lives, undecayed from the era's start, so they only grow and stay inside a double. An era
    takes over the earlier eras' sums decayed to its start; beyond the last few of them nothing is left that a double can hold.
    ``{name}_log`` orders the undecayed scores of all eras: log2 of the score plus the era's start in half-lives.
    """
    era = bucket("ts", ERA * half_life)
    start = F.col("_era") * (ERA * half_life)
    up = F.col("usd") * F.pow(F.lit(2.0), (F.col("ts") - start) / half_life)
    d = df.withColumn("_era", era)
    part = [*key, "_era"]
    per_era = d.groupBy(*part).agg(F.sum(up).alias("t"), F.min(F.struct(*ORDER)).alias("f"))
    w = Window.partitionBy(*key).orderBy("_era")
    before = F.collect_list(F.struct("_era", "t")).over(w.rangeBetween(-(1100 // ERA + 1), -1))  # a handful of eras
    carry = per_era.select(*part, F.aggregate(before, F.lit(0.0), lambda a, x: a + F.coalesce(x["t"], F.lit(0.0)) * F.pow(
        F.lit(2.0), (x["_era"] - F.col("_era")) * float(ERA))).alias("_c"), F.min("f").over(w.rowsBetween(Window.unboundedPreceding, 0))["blk"].alias("_seen"))
    out = running(d, part, ORDER, {"_s": ("sum", up)}, bucket("ts", width_or_layout(slice_width))).join(carry, part)
    score = F.coalesce("_s", F.lit(0.0)) + F.col("_c")
    return out.withColumn(name, score * F.pow(F.lit(2.0), -(F.col("ts") - start) / half_life)).withColumn(
        f"{name}_log", F.coalesce(F.log2(score), F.lit(-1e9)) + F.col("_era") * float(ERA)).drop("_s", "_c", "_era")


def main_pool(df: DataFrame, half_life: int = 6 * HOUR, slice_width: int | None = None) -> DataFrame:
    """WIN-2: the coin's pool with the largest decayed volume before the current print; first seen wins ties.

    Decay scales all pools alike, so the running maximum of the undecayed score decides; scores within 1e-9 of each other are ties.
    """
    s = decayed_volume(df, ["tok", "pool"], half_life, slice_width)
    best = F.struct(F.round("dvol_log", 9), (-F.col("_seen")).alias("first"), F.col("pool"))
    out = running(s, ["tok"], ORDER, {"_m": ("max", best)}, bucket("ts", width_or_layout(slice_width)), include_current=False)
    return out.withColumn("main", F.col("_m.pool")).drop("_m", "_seen", "dvol", "dvol_log")


def highs(df: DataFrame, key: Sequence[str], minute: int = 60, ks: Sequence[int] = (5, 15, 60), hour: int = HOUR,
          day_hours: int = 24, with_maker: bool = False) -> DataFrame:
    """WIN-3 / WIN-4: highs including the current print over the last k minute buckets, and the day high.

    Complete buckets come from bucket maxima, the current one from a running maximum inside it, so no later print
    of the same minute is seen. The day high adds the hourly maxima from the hour that holds t - day. Prices compare
    in single precision. ``with_maker`` adds the pool that made the widest minute high (the first to reach it).
    """
    from tidemark.operators.slicing import SLICE, with_halo
    px = float32(F.col("px"))
    val = F.struct(px.alias("x"), (-F.col("blk")).alias("o"), F.col("pool")) if with_maker else F.struct(px.alias("x"))
    df = df.withColumn("_mi", bucket("ts", minute)).withColumn("_hi", bucket("ts", hour)).withColumn("_v", val)
    inside = lambda b: Window.partitionBy(*key, b).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_m0", F.max("_v").over(inside("_mi")))
    mins = df.groupBy(*key, "_mi").agg(F.max("_v").alias("_v"))
    kmax = max(ks)
    wm = lambda k: Window.partitionBy(*key, SLICE).orderBy("_mi").rangeBetween(-(k - 1), -1)
    prev = with_halo(mins, "_mi", max(1440, kmax), kmax).select(
        *key, "_mi", "_own", *[F.max("_v").over(wm(k)).alias(f"_p{k}") for k in ks]).filter("_own").drop("_own")
    hrs = df.groupBy(*key, "_hi").agg(F.max("_v").alias("_v"))
    wh = Window.partitionBy(*key, SLICE).orderBy("_hi").rangeBetween(-day_hours, -1)
    prevh = with_halo(hrs, "_hi", max(240, day_hours), day_hours).select(
        *key, "_hi", "_own", F.max("_v").over(wh).alias("_pd")).filter("_own").drop("_own")
    rows = rows.join(prev, [*key, "_mi"], "left").withColumn("_h0", F.max("_v").over(inside("_hi"))).join(
        prevh, [*key, "_hi"], "left")
    out = rows
    for k in ks:
        out = out.withColumn(f"_g{k}", F.greatest("_m0", f"_p{k}")).withColumn(f"high_{k}", F.col(f"_g{k}.x"))
    out = out.withColumn("high_day", F.greatest(F.col(f"_g{kmax}"), F.col("_h0"), F.col("_pd"))["x"])
    if with_maker:
        out = out.withColumn("maker", F.col(f"_g{kmax}.pool"))
    drop = ["_mi", "_hi", "_v", "_m0", "_h0", "_pd", *[f"_p{k}" for k in ks], *[f"_g{k}" for k in ks]]
    return out.drop(*drop)


def dip(px: Column, high: Column) -> Column:
    """WIN-5: share lost from the high; null below a high of zero."""
    return F.lit(1.0) - F.try_divide(px, high)


def history_hours(df: DataFrame, key: Sequence[str], min_usd: float = 10.0, hours: int = 72, width: int = HOUR,
                  coverage: int | None = None) -> DataFrame:
    """WIN-6 at T = end of each bucket with prints: buckets of the prior ``hours`` with a print of ``min_usd``.

    -1 when the window reaches back before the coverage start although the key is older than that.
    """
    from tidemark.operators.slicing import SLICE, with_halo
    h = df.groupBy(*key, bucket("ts", width).alias("b")).agg(
        F.max((F.col("usd") >= min_usd).cast("int")).alias("_ok"), F.min("ts").alias("_t"))
    birth = df.groupBy(*key).agg(F.min("ts").alias("_birth"))
    w = Window.partitionBy(*key, SLICE).orderBy("b").rangeBetween(-(hours - 1), 0)
    got = with_halo(h, "b", max(240, hours), hours).select(*key, "b", "_own", F.sum("_ok").over(w).alias("h_n")).filter("_own")
    t = F.col("b") + 1
    out = got.select(*key, t.alias("t_bucket"), F.col("h_n"))
    if coverage is not None:
        start = (F.col("t_bucket") - hours) * width
        out = out.join(birth, list(key)).withColumn(
            "h_n", F.when((start < coverage) & (start < F.col("_birth")), F.lit(-1)).otherwise(F.col("h_n"))).drop("_birth")
    return out.withColumn("h_n", F.col("h_n").cast("long"))


def recent_prints(df: DataFrame, key: Sequence[str], lookback: int = HOUR, min_usd: float = 10.0,
                  slice_width: int | None = None, name: str = "n10") -> DataFrame:
    """WIN-9: prints of at least ``min_usd`` in (t - lookback, t]."""
    return trailing(df, key, "ts", lookback, {name: F.count(F.when(F.col("usd") >= min_usd, 1))}, slice_width)


def distinct_buyers(df: DataFrame, key: Sequence[str], buyer: str, min_usd: float = 10.0, width: int = HOUR) -> DataFrame:
    """WIN-10: distinct buyers in (T - width, T] at every whole T."""
    t = F.ceil(F.col("ts") / width).cast("long")
    return df.filter((F.col("side") == "buy") & (F.col("usd") >= min_usd)).groupBy(*key, t.alias("t_bucket")).agg(
        F.count_distinct(buyer).alias("buyers"))


def trend(df: DataFrame, prints: DataFrame, key: Sequence[str], w: int, day: int, rings, up: float = -0.09,
          away: float = -0.30) -> DataFrame:
    """WIN-11: change over the day that ends ``w`` before now, from two multi-resolution look-ups; both prices
    have to be above zero."""
    a = J.asof_multires(df.withColumn("_t1", F.col("ts") - w), prints, key, "_t1", "ts", rings, name="p_w")
    b = J.asof_multires(a.withColumn("_t2", F.col("ts") - w - day), prints, key, "_t2", "ts", rings, name="p_wd")
    chg = F.when((F.col("p_w") > 0) & (F.col("p_wd") > 0), F.col("p_w") / F.col("p_wd") - 1)
    return b.withColumn("chg", chg).withColumn(
        "trend", F.when(chg >= up, "up").when(chg <= away, "away").when(chg.isNotNull(), "flat")).drop("_t1", "_t2")


def lookback_return(df: DataFrame, prints: DataFrame, key: Sequence[str], back: int, rings) -> DataFrame:
    """WIN-12: return of the current price against the price ``back`` ago."""
    got = J.asof_multires(df.withColumn("_t1", F.col("ts") - back), prints, key, "_t1", "ts", rings, name="p_back")
    return got.withColumn("ret_back", F.when(F.col("p_back") > 0, F.col("px") / F.col("p_back") - 1)).drop("_t1")


def thin(df: DataFrame, key: Sequence[str], order: Sequence[str], ts: str, gap: int, name: str = "kept", **kw) -> DataFrame:
    """Mark rows that come at least ``gap`` after the last kept row of the key (TRD-8, fixed gap)."""
    def kernel(state, rows):
        last = state["t"] if state else None
        flags = []
        for t in rows[ts].tolist():
            ok = t is not None and (last is None or t >= last + gap)
            if ok:
                last = int(t)
            flags.append(ok)
        return {"t": last}, {name: flags}
    return ordered_fold(df, key, order, kernel, [(name, "boolean")], reads=[ts], **kw)


def dip_episodes(prints: DataFrame, dips: DataFrame, gap: int = 6 * HOUR, recover: float = 1.2, within: int = DAY,
                 fine: int = HOUR, coarse: int = DAY, **kw) -> DataFrame:
    """WIN-13: dips on the main pool thinned to one per ``gap``, each with its first recovery on the same pool."""
    kept = thin(dips, ["tok"], list(ORDER), "ts", gap, "_kept", cut=True, **kw).filter("_kept").drop("_kept")
    pos = (kept.withColumn("_lo", F.col("ts") + 1).withColumn("_hi", F.col("ts") + within)
           .withColumn("_line", F.col("px") * recover))
    got = first_crossing(pos, prints, ["tok", "pool"], ["blk"], F.col("px"), "_line", "_lo", "_hi", ("ts", "px"),
                         fine=fine, coarse=coarse, name="rec")
    return got.withColumn("rec_ts", F.col("rec.ts")).drop("_lo", "_hi", "_line", "rec")


def recovered_before(signals: DataFrame, episodes: DataFrame, look: int = 7 * DAY, slice_width: int | None = None,
                     row_id: Sequence[str] = ("blk",)) -> DataFrame:
    """WIN-13, count: episodes that began in [t - look, t) and had recovered by t.

    An episode counts from its recovery to ``look`` after its start, so it is one +1 and one -1 event.
    """
    ok = episodes.filter(F.col("rec_ts").isNotNull() & (F.col("rec_ts") <= F.col("ts") + look))
    ev = ok.select("tok", F.explode(F.array(
        F.struct(F.col("rec_ts").alias("at"), F.lit(1).alias("d")),
        F.struct((F.col("ts") + look + 1).alias("at"), F.lit(-1).alias("d")))).alias("e")).select("tok", "e.at", "e.d")
    out = J.prefix_at(signals, ev, ["tok"], {"nrec": ("sum", F.col("d"))}, "ts", "at", slice_width=slice_width)
    return out.withColumn("nrec", F.coalesce("nrec", F.lit(0)))


def sell_flags(df: DataFrame, key: Sequence[str], lookback: int = HOUR, last: int = 80, min_usd: float = 10.0,
               slice_width: int | None = None) -> DataFrame:
    """WIN-14: over the last ``last`` prints within the look-back: sells, and the ratio of upper medians; a large sell in all of the look-back.

    Later prints of the same second have no part in a row.
    """
    from tidemark.operators.slicing import SLICE, with_halo
    w = Window.partitionBy(*key, SLICE).orderBy(*ORDER).rowsBetween(-(last - 1), 0)
    rng = Window.partitionBy(*key, SLICE).orderBy("ts").rangeBetween(-lookback + 1, -1)
    sec = Window.partitionBy(*key, SLICE, "ts").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    sold = F.max(F.when((F.col("side") == "sell") & (F.col("usd") >= min_usd), 1).otherwise(0))
    big = F.greatest(sold.over(rng), sold.over(sec))
    wide = with_halo(df, "ts", max(width_or_layout(slice_width), lookback), lookback)
    got = wide.select("*", F.collect_list(F.struct("ts", "side", "px")).over(w).alias("_a"), big.alias("sell_big")).filter("_own")
    recent = F.filter("_a", lambda s: s["ts"] > F.col("ts") - lookback)
    got = got.withColumn("_r", recent)
    pick = lambda side: F.sort_array(F.transform(F.filter("_r", lambda s: s["side"] == side), lambda s: s["px"]))
    med = lambda a: F.get(a, F.floor(F.size(a) / 2).cast("int"))
    got = got.withColumn("_s", pick("sell")).withColumn("_b", pick("buy"))
    return got.withColumn("n_sells", F.size("_s")).withColumn(
        "sell_buy_ratio", F.when((F.size("_s") > 0) & (F.size("_b") > 0), F.try_divide(med(F.col("_s")), med(F.col("_b"))))).drop(
        "_a", "_r", "_s", "_b", SLICE, "_own")


def fee_estimate(df: DataFrame, key: Sequence[str], price: str, amount_token: str, amount_quote: str,
                 slice_width: int | None = None) -> DataFrame:
    """WIN-15: fee implied by each swap against the geometric mean of its price and the previous one, and the upper
    median of the last five valid estimates."""
    prev = running(df, key, ORDER, {"_lp": ("last", F.col(price))}, bucket("ts", width_or_layout(slice_width)), include_current=False)
    mid = F.sqrt(F.col(price) * F.col("_lp"))
    ratio = F.try_divide(F.col(amount_quote), F.col(amount_token) * mid)
    f = F.when(F.col("side") == "buy", ratio - 1).otherwise(1 - ratio)
    ok = (F.col("_lp") > 0) & (F.col(price) > 0) & (F.col(amount_token) > 0) & (F.col(amount_quote) > 0)
    est = prev.withColumn("fee", F.when(ok & (f > -0.001) & (f < 0.99), F.greatest(f, F.lit(0.0)))).drop("_lp")
    out = last_n(est, key, ORDER, F.col("fee"), 5, bucket("ts", width_or_layout(slice_width)), "_fees")
    a = F.sort_array("_fees")
    return out.withColumn("fee_est", F.get(a, F.floor(F.size("_fees") / 2).cast("int"))).drop("_fees")


def signal_features(signals: DataFrame, prints: DataFrame, key: Sequence[str], row_id: str, lookback: int = HOUR,
                    fine: int = HOUR, coarse: int = DAY, slice_width: int | None = None) -> DataFrame:
    """WIN-16: earliest and latest print at the maximum of [t - lookback, t], their number, and sells since each."""
    pos = signals.withColumn("_lo", F.col("ts") - lookback).withColumn("_hi", F.col("ts"))
    top = range_extreme(pos, prints, key, [row_id], float32(F.col("px")), "_lo", "_hi", ("ts", "px"), fine=fine,
                        coarse=coarse, name="_top").withColumn("_line", float32(F.col("_top.px")))
    ids = [c for c in key if c != row_id] + [row_id]
    # prints exactly at the maximum: counted by an equi-join on (key, price), never by a range of prints
    level = prints.withColumn("_line", float32(F.col("px"))).select(*key, "_line", F.col("ts").alias("_pt"))
    at = (top.select(*ids, "_line", "_lo", "_hi").join(level, [*key, "_line"])
          .filter((F.col("_pt") >= F.col("_lo")) & (F.col("_pt") <= F.col("_hi"))).groupBy(row_id)
          .agg(F.min("_pt").alias("max_first"), F.max("_pt").alias("max_last"), F.count("*").alias("max_ties")))
    out = signals.join(at, row_id, "left")
    probes = out.select(row_id, *[c for c in key if c != row_id], F.explode(F.array(
        F.struct(F.lit("now").alias("tag"), F.col("ts").alias("at")),
        F.struct(F.lit("first").alias("tag"), F.col("max_first").alias("at")),
        F.struct(F.lit("last").alias("tag"), F.col("max_last").alias("at")))).alias("e")).select(
        row_id, *[c for c in key if c != row_id], "e.tag", "e.at")
    n = J.prefix_at(probes, prints.filter("side = 'sell'"), key, {"n": ("count", F.col("px"))}, "at", "ts",
                    slice_width=slice_width)
    pick = lambda tag: F.max(F.when(F.col("tag") == tag, F.col("n")))
    since = n.groupBy(row_id).agg((pick("now") - pick("first")).alias("sells_since_first"),
                                  (pick("now") - pick("last")).alias("sells_since_last"))
    return out.join(since, row_id, "left")


def activity_count(df: DataFrame, key: Sequence[str], width: int = 600, back: int = 6, min_usd: float = 10.0) -> DataFrame:
    """WIN-17: prints of at least ``min_usd`` in the current bucket and the ``back`` before it."""
    from tidemark.operators.slicing import SLICE, with_halo
    b = df.filter(F.col("usd") >= min_usd).groupBy(*key, bucket("ts", width).alias("b")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*key, SLICE).orderBy("b").rangeBetween(-back, 0)
    return with_halo(b, "b", max(240, back), back).select(*key, "b", "_own", F.sum("n").over(w).alias("activity")).filter(
        "_own").drop("_own")


def age_at(signals: DataFrame, births: DataFrame, first_seen: DataFrame, ts: str = "ts") -> DataFrame:
    """WIN-18: seconds since the earlier of birth and first accepted print, never negative."""
    got = signals.join(births, "tok", "left").join(first_seen, "tok", "left")
    return got.withColumn("age", F.greatest(F.col(ts) - F.least("birth_ts", "first_ts"), F.lit(0)))


def rank_on_key(df: DataFrame, key: str, name: str, row_id: str = "id", slice_width: int | None = None) -> DataFrame:
    """WIN-19: position of the row among the rows of its key."""
    return running(df, [key], ["ts", row_id], {name: ("count", F.col(row_id))}, bucket("ts", width_or_layout(slice_width)))


def follower_lag(df: DataFrame, key: str, edges: Sequence[int], row_id: str = "id", slice_width: int | None = None) -> DataFrame:
    """WIN-20: lag to the key's first call as a band; the first call is ``first``."""
    got = running(df, [key], ["ts", row_id], {"_f": ("first", F.struct("ts", row_id)), "rank": ("count", F.col(row_id))},
                  bucket("ts", width_or_layout(slice_width)))
    lag = F.col("ts") - F.col("_f.ts")
    out = F.lit(f">{edges[-1]}")
    for e in reversed(edges):
        out = F.when(lag <= e, F.lit(f"<={e}")).otherwise(out)
    return got.withColumn("lag_s", lag).withColumn("lag_band", F.when(F.col("rank") == 1, "first").otherwise(out)).drop("_f")


def runup(signals: DataFrame, prints: DataFrame, key: Sequence[str], back: int = HOUR, after: int = 360,
          slice_width: int | None = None) -> DataFrame:
    """WIN-21: move from the last print before t - back (else the first inside the window) to the last before t, and
    the price at the call (else the first within ``after``)."""
    s = signals.withColumn("_t0", F.col("ts") - back)
    s = J.asof_backward(s, prints, key, "_now", strict=True, tie=("blk",), columns=("ts", "px"), slice_width=slice_width)
    s = J.asof_backward(s, prints, key, "_old", strict=True, left_ts="_t0", tie=("blk",), columns=("ts", "px"),
                        slice_width=slice_width)
    s = J.asof_forward(s, prints, key, "_in", left_ts="_t0", tie=("blk",), columns=("ts", "px"), slice_width=slice_width)
    s = J.asof_forward(s, prints, key, "_aft", tol=after, tie=("blk",), columns=("ts", "px"), slice_width=slice_width)
    base = F.coalesce(F.col("_old.px"), F.when(F.col("_in.ts") < F.col("ts"), F.col("_in.px")))
    return s.withColumn("runup_pct", 100 * (F.try_divide(F.col("_now.px"), base) - 1)).withColumn(
        "px_at_call", F.coalesce(F.col("_now.px"), F.col("_aft.px"))).drop("_t0", "_now", "_old", "_in", "_aft")


def race(calls: DataFrame, candles: DataFrame, key: Sequence[str], row_id: str, steps: Sequence[tuple[int, int]],
         base_px: str, max_age: int, slice_width: int | None = None) -> DataFrame:
    """WIN-22: percent path at growing steps, one row per point; (step, until) pairs give the grid.

    ``candles`` has a close and the time it became known (``ts``).
    """
    spans, lo = [], 0
    for step, until in steps:
        spans.append(F.sequence(F.lit(lo + step), F.lit(until), F.lit(step)))
        lo = until
    grid = calls.withColumn("off", F.explode(F.concat(*spans))).withColumn("at", F.col("ts") + F.col("off"))
    got = J.asof_backward(grid, candles, key, "_c", max_age, left_ts="at", columns=("ts", "close"), slice_width=slice_width)
    return got.filter(F.col("_c").isNotNull() & (F.col("_c.ts") > F.col("ts"))).select(
        row_id, *[c for c in key if c != row_id], "off", (100 * (F.try_divide("_c.close", base_px) - 1)).alias("pct"))


def peak_after(calls: DataFrame, candles: DataFrame, key: Sequence[str], row_id: str, lo: int, hi: int, base_px: str,
               fine: int = HOUR, coarse: int = DAY, name: str = "peak") -> DataFrame:
    """WIN-23: highest candle strictly after the call's ``lo`` and within ``hi``, its multiple and its delay."""
    pos = calls.withColumn("_lo", F.col("ts") + lo + 1).withColumn("_hi", F.col("ts") + hi)
    got = range_extreme(pos, candles, key, [row_id], F.col("high"), "_lo", "_hi", ("ts", "high"), order=("ts",),
                        fine=fine, coarse=coarse, name="_p")
    return got.withColumn(f"{name}_x", F.try_divide("_p.high", base_px)).withColumn(
        f"{name}_s", F.col("_p.ts") - F.col("ts")).drop("_p", "_lo", "_hi")


def first_multiple(calls: DataFrame, candles: DataFrame, key: Sequence[str], row_id: str, x: float, base_px: str,
                   within: int, fine: int = HOUR, coarse: int = DAY) -> DataFrame:
    """WIN-24: first candle whose high reaches ``x`` times the base price."""
    pos = (calls.withColumn("_lo", F.col("ts") + 1).withColumn("_hi", F.col("ts") + within)
           .withColumn("_line", F.col(base_px) * x))
    got = first_crossing(pos, candles, key, [row_id], F.col("high"), "_line", "_lo", "_hi", ("ts", "high"), ("ts",),
                         fine, coarse, "_h")
    return got.withColumn("hit_s", F.col("_h.ts") - F.col("ts")).drop("_h", "_lo", "_hi", "_line")


def at_call_features(calls: DataFrame, prints: DataFrame, key: Sequence[str], row_id: str, back: int = HOUR,
                     depth_age: int = DAY, slice_width: int | None = None) -> DataFrame:
    """WIN-25: move and volume over the look-back before the call, and the last depth if fresh."""
    s = calls.withColumn("_t0", F.col("ts") - back)
    s = J.prefix_at(s, prints, key, {"_n": ("last", F.struct("ts", "px", "usd")), "_v1": ("sum", F.col("usd"))},
                    "ts", "ts", ("blk",), strict=True, slice_width=slice_width)
    s = J.prefix_at(s, prints, key, {"_o": ("last", F.struct("ts", "px")), "_v0": ("sum", F.col("usd"))},
                    "_t0", "ts", ("blk",), strict=True, slice_width=slice_width)
    return s.withColumn("move_pct", 100 * (F.try_divide("_n.px", "_o.px") - 1)).withColumn(
        "vol_back", F.coalesce("_v1", F.lit(0.0)) - F.coalesce("_v0", F.lit(0.0))).withColumn(
        "depth", F.when(F.col("ts") - F.col("_n.ts") <= depth_age, F.col("_n.usd"))).drop("_t0", "_n", "_o", "_v1", "_v0")


def track_record(closed: DataFrame, min_n: int = 5, clip: float = 50.0, shrink: int = 8,
                 tiers: Sequence[tuple[float, str]] = ((0.0, "B"), (10.0, "A"))) -> DataFrame:
    """WIN-26: score from a key's closed outcomes (columns of ``joins.closed_before`` over growth factors).

    From ``min_n`` outcomes on the geometric mean, clipped; below that the mean without the best one; both shrunk by
    n / (n + ``shrink``).
    """
    n = F.col("n_closed")
    geo = 100 * (F.exp(F.try_divide("logsum_closed", n)) - 1)
    small = F.when(n > 1, 100 * ((F.col("sum_closed") - F.col("best_closed")) / (n - 1) - 1)).otherwise(F.lit(0.0))
    raw = F.when(n >= min_n, F.least(F.greatest(geo, F.lit(-clip)), F.lit(clip))).otherwise(small)
    score = raw * n / (n + shrink)
    tier = F.lit("C")
    for edge, label in sorted(tiers):
        tier = F.when(F.col("score") > edge, F.lit(label)).otherwise(tier)
    return closed.withColumn("score", F.when(n > 0, score)).withColumn("tier", F.when(n > 0, tier).otherwise("new"))


def life_of_window(calls: DataFrame, prints: DataFrame, key: Sequence[str], row_id: str, day7: int = 7 * DAY,
                   width: int = DAY) -> DataFrame:
    """WIN-27: data days after the call, last print, prints after day 7 and death by then."""
    days = prints.groupBy(*key, bucket("ts", width).alias("d")).agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    facts = days.select(*key, (F.col("d") * width).alias("ts"), F.lit(1).alias("one"), "last")
    s = calls.withColumn("_d", (bucket("ts", width) + 1) * width)
    s = J.prefix_at(s, facts, key, {"data_days": ("count", F.col("one")), "last_print": ("max", F.col("last"))},
                    "_d", "ts", forward=True)
    s = s.withColumn("_a", F.col("ts") + day7 + 1)
    s = J.prefix_at(s, prints, key, {"after_d7": ("count", F.col("px"))}, "_a", "ts", forward=True)
    return s.withColumn("dead_by_d7", F.col("after_d7") == 0).drop("_d", "_a")
