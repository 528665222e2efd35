"""Cost and return views (CST). Column expressions on trade rows; lookups are left joins by priority."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import DAY, static_fee
from tidemark.operators import joins as J
from tidemark.operators.slicing import multiplied, quantiles_linear

S1 = 1.01 ** 0.5 - 1  # share of the 1 % depth that a unit trade moves
SLIP = 0.004  # V2/V3 slippage per side

# fixed values: measured latency, failure and gas figures of the published cost model
LATENCY = {
    "buy_sec": 43.8, "buy_sec_p90": 187.8, "copy_buy_sec": 84.8, "copy_buy_sec_p90": 137.6, "sell_sec": 3.3, "sell_sec_p90": 9.8,
    "sell_sec_recent": 9.7, "sell_sec_recent_p90": 15.1, "buy_fail_rate": 0.0941, "sell_fail_gas_rate": 0.1908,
    "gas_eth_per_swap": 8.97e-06, "gas_eth_per_failed": 7.509e-06,
}


def classify_pool(pools: DataFrame, receipts: DataFrame, table: DataFrame, hooks: DataFrame, venues: DataFrame) -> DataFrame:
    """CST-1: type and take of a pool from its receipts, else the cost table, else its hook, else its venue, else unknown."""
    out = (pools.join(receipts.select("pool", F.col("type").alias("_t0"), F.col("take").alias("_k0")), "pool", "left")
           .join(table.select("pool", F.col("type").alias("_t1"), F.col("take").alias("_k1")), "pool", "left")
           .join(hooks.select("hook", F.col("type").alias("_t2"), F.col("take").alias("_k2")), "hook", "left")
           .join(venues.select("venue", F.col("type").alias("_t3"), F.col("take").alias("_k3")), "venue", "left"))
    src = F.lit("unknown")
    for i, name in reversed(list(enumerate(("receipt", "table", "hook", "venue")))):
        src = F.when(F.col(f"_t{i}").isNotNull(), F.lit(name)).otherwise(src)
    return out.withColumn("cost_src", src).withColumn("type", F.coalesce(*[F.col(f"_t{i}") for i in range(4)], F.lit("unknown"))).withColumn(
        "take", F.when(F.col("_t0").isNotNull(), F.col("_k0")).when(F.col("_t1").isNotNull(), F.col("_k1"))
        .when(F.col("_t2").isNotNull(), F.col("_k2")).otherwise(F.col("_k3"))).drop(*[f"_{c}{i}" for c in "tk" for i in range(4)])


def ex_ante_take(df: DataFrame, kind: str, terms: str, is_launch: str, pips: str, est: str, low: float = 0.01) -> DataFrame:
    """CST-2: the take known before buying: LOW (up to 1 %), HIGH, UNK or V23.

    Launchpad pools use their terms, other V4 pools their key fee, dynamic fees the estimate from earlier swaps.
    """
    static = static_fee(F.col(pips))
    take = F.when(F.col(is_launch), F.col(terms)).when(F.col(pips).isNull(), None).when(static.isNotNull(), static).otherwise(F.col(est))
    return df.withColumn("ex_take", F.when(F.col(kind) == "v4", take)).withColumn(
        "take_band", F.when(F.col(kind) != "v4", "V23").when(F.col("ex_take").isNull(), "UNK")
        .when(F.col("ex_take") <= low + 1e-9, "LOW").otherwise("HIGH"))


def tax(df: DataFrame, table: DataFrame) -> DataFrame:
    """CST-3: token tax per side; an unknown status takes the family's expected value, an absent token pays none."""
    t = table.select("tok", F.col("status").alias("_st"), F.col("buy").alias("_b"), F.col("sell").alias("_s"), F.col("expected_tax").alias("_e"))
    pick = lambda c: F.when(F.col("_st").isNull(), 0.0).when(F.col("_st") == "unknown", F.coalesce("_e", F.lit(0.0))).otherwise(F.coalesce(c, F.lit(0.0)))
    return df.join(t, "tok", "left").withColumn("tax_buy", pick("_b")).withColumn("tax_sell", pick("_s")).drop("_st", "_b", "_s", "_e")


def cost_per_side(kind: Column, lp: Column, take: Column, impact: Column, impact_per_eth: Column, clip_eth: Column, tax_: Column) -> Column:
    """CST-4: lp + take + impact + tax; V2/V3 takes no hook fee and the larger of measured and modelled impact."""
    imp = F.when(kind == "v4", F.greatest(F.coalesce(impact, F.lit(0.0)), F.lit(0.0))).otherwise(
        F.greatest(F.coalesce(impact_per_eth, F.lit(0.0)) * clip_eth, F.coalesce(impact, F.lit(0.0))))
    return lp + F.when(kind == "v4", F.coalesce(take, F.lit(0.0))).otherwise(F.lit(0.0)) + imp + tax_


def buy_price(kind: Column, px: Column, side: Column, clip_eth: Column, depth1: Column, fee: Column) -> Column:
    """CST-5, buy: V4 pays impact and fee; V2/V3 crosses the spread after a sell and slips 0.4 %."""
    u = F.try_divide(clip_eth * S1, depth1)
    flip = F.when(side == "sell", (1 + fee) / (1 - fee)).otherwise(1.0)
    return px * F.when(kind == "v4", (1 + u) * (1 + fee)).otherwise(flip * (1 + SLIP))


def sell_price(kind: Column, px: Column, side: Column, tokens_eth: Column, depth1: Column, fee: Column) -> Column:
    """CST-5, sell: the mirror image, on the value of the tokens held."""
    w = F.try_divide(tokens_eth * S1, depth1)
    flip = F.when(side == "buy", (1 - fee) / (1 + fee)).otherwise(1.0)
    return px * F.when(kind == "v4", (1 - fee) / (1 + w)).otherwise(flip * (1 - SLIP))


def constant_product(clip: Column, fee_in: Column, px_in: Column, d_in: Column, fee_out: Column, px_out: Column, d_out: Column) -> Column:
    """CST-6: proceeds of a clip bought and sold along x*y=k curves of the given depths, relative to the clip."""
    c = clip * (1 - fee_in)
    n = F.try_divide(c, px_in * (1 + F.try_divide(c, d_in)))
    v = n * (1 - fee_out) * px_out
    return F.try_divide(v, (1 + F.try_divide(v, d_out)) * clip)


def leg_rate(fee: Column, depth: Column, size: Column, side: str) -> Column:
    u = F.try_divide(size * S1, depth)
    return (1 + fee) * (1 + u) if side == "buy" else (1 - fee) / (1 + u)


def hop_route(states: DataFrame, row_id: Sequence[str], side: str, size: str, band: float = 0.10,
              allow_usdg: bool = False) -> DataFrame:
    """CST-7: best direct leg per row among the pool states at its time, or with ``allow_usdg`` the product of two legs over the stable coin.

    ``states``: row id, leg (direct / first / second), fee, depth, px. Only pools with a known fee and a price within
    10 % of the deepest pool's of the same leg take part.
    """
    g = [*row_id, "leg"]
    ref = states.groupBy(*g).agg(F.max_by("px", F.struct("depth", "px")).alias("_ref"))
    m = leg_rate(F.col("fee"), F.col("depth"), F.col(size), side)
    ok = states.join(ref, g).filter(F.col("fee").isNotNull() & (F.col("depth") > 0) & (F.abs(F.try_divide("px", "_ref") - 1) <= band)).withColumn("_m", m)
    best = ok.groupBy(*g).agg((F.min if side == "buy" else F.max)("_m").alias("_m"))
    leg = lambda n: F.max(F.when(F.col("leg") == n, F.col("_m")))
    via = leg("first") * leg("second") if allow_usdg else F.max(F.lit(None).cast("double"))
    out = best.groupBy(*row_id).agg(leg("direct").alias("direct"), via.alias("via"))
    pick = F.least("direct", "via") if side == "buy" else F.greatest("direct", "via")
    return out.withColumn("mult", pick).withColumn("route", F.when(F.col("direct") == F.col("mult"), "direct").when(
        F.col("mult").isNotNull(), "via_usdg"))


def hop_apply(net: Column, clip_eth: Column, buy_mult: Column, sell_mult: Column) -> Column:
    """CST-8: a net return with both conversion legs and half a swap's gas on each; null legs give null."""
    g = gas_pts(clip_eth)
    return F.try_divide((net + g + 100) * sell_mult, buy_mult) - 100 - g - 100 * LATENCY["gas_eth_per_swap"] / clip_eth


def hop_exit_mult(sell_mult: Column, entry_fee: Column, entry_impact: Column, size_ratio: Column) -> Column:
    """CST-8: exit leg, falling back to the entry leg's pool at the exit size."""
    return F.coalesce(sell_mult, (1 - entry_fee) / (1 + entry_impact * size_ratio))


def static_hop(df: DataFrame, table: DataFrame, quote: str, fallback: Column) -> DataFrame:
    """CST-9: per-quote median cost of both legs, with a common fallback for quotes without one."""
    t = table.select(quote, F.col("buy").alias("_b"), F.col("sell").alias("_s"))
    return df.join(t, quote, "left").withColumn("hop_src", F.when(F.col("_b").isNotNull(), "token").otherwise("fallback")).withColumn(
        "hop_buy", F.coalesce("_b", fallback)).withColumn("hop_sell", F.coalesce("_s", fallback)).drop("_b", "_s")


def gas_pts(clip_eth: Column, round_trip: bool = True) -> Column:
    """CST-10: gas of a trade in percent of the clip, with the expected gas of failed attempts."""
    L = LATENCY
    g = L["gas_eth_per_swap"] * (2 if round_trip else 1) + L["buy_fail_rate"] * L["gas_eth_per_failed"]
    if round_trip:
        g += L["sell_fail_gas_rate"] * L["gas_eth_per_failed"]
    return F.lit(100 * g) / clip_eth


def eth_booking(df: DataFrame, series: DataFrame, entry_ts: str, exit_ts: str, entry_px: str, exit_px: str) -> DataFrame:
    """CST-11: gross multiple in ETH from USD prices: their ratio times ETHUSD(entry) / ETHUSD(exit)."""
    a = J.interp_linear(df, series, (), entry_ts, name="eth_entry")
    b = J.interp_linear(a, series, (), exit_ts, name="eth_exit")
    return b.withColumn("gross_eth", F.try_divide(F.col(exit_px) * F.col("eth_entry"), F.col(entry_px) * F.col("eth_exit")))


def real_net(gross: Column, cost_buy: Column, impact_buy: Column, cost_sell: Column, impact_sell: Column, clip_eth: Column) -> Column:
    """Net return in percent: on each side the costs other than price impact come off first, the impact then compounds."""
    paid = (1 + (cost_buy - impact_buy)) * (1 + impact_buy)
    got = F.try_divide(1 - (cost_sell - impact_sell), 1 + impact_sell)
    return 100 * (F.try_divide(gross * got, paid) - 1) - gas_pts(clip_eth)


def heavy(basis: Column, entry: Column, cost_buy: Column, cost_sell: Column, hook_buy: Column, hook_sell: Column) -> Column:
    """CST-13: at least 1.4 % per side, 1 % more on hook pools, 0.2 points of gas."""
    side = lambda c, h: F.greatest(c, F.lit(0.014)) + F.when(h, 0.01).otherwise(0.0)
    return 100 * (F.try_divide(basis * (1 - side(cost_sell, hook_sell)), entry * (1 + side(cost_buy, hook_buy))) - 1) - 0.2


def views(df: DataFrame) -> DataFrame:
    """CST-12: the return of each trade under every cost view, as (view, ret) rows.

    Columns: gross, gross_trig, gross_lat, gross_lat90 (ETH multiples of the booked exit, the trigger print and the two latency probes),
    cost_buy, impact_buy, cost_sell, impact_sell (totals and the impact in them), model_buy, model_sell, hook_buy, hook_sell, clip_eth,
    fallback, quoted (the pool's quote has to be converted), and for the conversion hop_buy, hop_fee, hop_impact (entry leg), hop_sell_60,
    hop_sell_trig, hop_sell_lat, hop_sell_lat90 (exit legs at each view's own time and size), hop_buy_u, hop_fee_u, hop_impact_u, hop_sell_u
    (the same over the stable coin). An exit leg that is null falls back to the entry leg's pool at the exit's size. A fallback exit is capped
    at 0 in every view; a quoted trade without an entry leg has null hop views, one without a quote to convert the plain views.
    """
    C = F.col
    cap = lambda x: F.when(C("fallback") & (x > 0), F.lit(0.0)).otherwise(x)  # null stays null
    model = lambda g: 100 * (C(g) * (1 - C("model_sell")) / (1 + C("model_buy")) - 1) - 0.2

    def hop(net: str, sell: str, tail: str = "") -> Column:
        left = F.greatest(F.lit(0.01), (C(net) + 100) / 100)  # the exit's size in clips
        leg = hop_exit_mult(C(sell), C(f"hop_fee{tail}"), C(f"hop_impact{tail}"), left)
        return F.when(C("quoted"), hop_apply(C(net), C("clip_eth"), C(f"hop_buy{tail}"), leg)).otherwise(C(net))

    real = lambda g: real_net(C(g), C("cost_buy"), C("impact_buy"), C("cost_sell"), C("impact_sell"), C("clip_eth"))
    nets = {"_60": real("gross"), "_trig": real("gross_trig"), "_lat": real("gross_lat"), "_lat90": real("gross_lat90")}
    wide = df.withColumns(nets)
    late = lambda n: F.when(C("fallback"), F.least(C("_trig"), F.lit(0.0))).otherwise(C(n))
    wide = wide.withColumns({"_lat": late("_lat"), "_lat90": late("_lat90")})
    out = {
        "meas": model("gross"), "meas_trig": model("gross_trig"),
        "heavy": heavy(C("gross"), F.lit(1.0), C("model_buy"), C("model_sell"), C("hook_buy"), C("hook_sell")),
        "real60": C("_60"), "realtrig": C("_trig"), "lat": C("_lat"), "lat90": C("_lat90"),
        "real60h": hop("_60", "hop_sell_60"), "realtrigh": hop("_trig", "hop_sell_trig"), "lath": hop("_lat", "hop_sell_lat"),
        "lat90h": hop("_lat90", "hop_sell_lat90"), "real60u": hop("_60", "hop_sell_u", "_u"),
    }
    flat = wide.select(*df.columns, *[cap(x).cast("double").alias(n) for n, x in out.items()])
    return flat.unpivot(df.columns, list(out), "view", "ret")


def real_vs_old(df: DataFrame, booked: str, recomputed: Column, tol: float = 2e-4) -> DataFrame:
    """CST-14: recompute the engine's booked value and count the rows that miss it by more than ``tol``."""
    return df.withColumn("recomputed", recomputed).withColumn("reproduced", F.abs(F.col(booked) - F.col("recomputed")) <= tol)


def rederive_check(df: DataFrame, checks: dict[str, tuple[Column, Column]], key: Sequence[str], rel: float = 1e-6) -> DataFrame:
    """CST-15: mismatches per field between a stored value and its derivation from the row, and duplicate keys."""
    bad = lambda a, b: F.count_if(F.coalesce(F.abs(a - b) > rel * F.greatest(F.lit(1.0), F.abs(a), F.abs(b)), a.isNotNull() | b.isNotNull()))
    flat = df.agg(F.count("*").alias("rows"), *[bad(a, b).alias(f"bad_{n}") for n, (a, b) in checks.items()])
    dup = df.groupBy(*key).agg(F.count("*").alias("c")).agg(F.sum((F.col("c") > 1).cast("int")).alias("dup_keys"))
    return flat.withColumn("dup_keys", dup.scalar())


def cost_source_counts(df: DataFrame, group: Sequence[str], sources: dict[str, str], fallback: str) -> DataFrame:
    """CST-16: which source priced each side, and the share that used a fallback."""
    arr = F.array(*[F.struct(F.lit(n).alias("side"), F.col(c).alias("src")) for n, c in sources.items()])
    return df.withColumn("_s", F.explode(arr)).groupBy(*group, F.col("_s.side").alias("side"), F.col("_s.src").alias("src")).agg(
        F.count("*").alias("n"), F.avg(F.col(fallback).cast("int")).alias("fallback_share"))


def static_route_medians(tokens: DataFrame, states: DataFrame, step: int, lo: int, hi: int, fee: Column, depth: str, size: float, max_age: int,
                         slice_width: int | None = None) -> DataFrame:
    """CST-17: per token the median, over moments ``step`` apart, of its cheapest fresh route; the fallback is the median over tokens."""
    spine = tokens.select("tok", F.explode(F.sequence(F.lit(lo), F.lit(hi), F.lit(step))).alias("ts")).withColumn("ts", F.col("ts").cast("long"))
    st = J.state_by_pool_at(multiplied(spine), states, max_age=max_age, tie=("blk",), slice_width=slice_width)
    m = st.withColumn("_m", leg_rate(fee, F.col(f"state.{depth}"), F.lit(size), "buy")).groupBy("tok", "ts").agg(F.min("_m").alias("_m"))
    per = quantiles_linear(m, ["tok"], "_m", {"buy": 0.5}).withColumnRenamed("n", "moments")
    fb = quantiles_linear(per, [], "buy", {"fallback": 0.5}).select("fallback")
    return tokens.join(per, "tok", "left").withColumn("fallback", fb.scalar()).withColumn("hop_src", F.when(F.col("buy").isNull(), "fallback").otherwise("token")).withColumn(
        "buy", F.coalesce("buy", "fallback")).drop("fallback")


def median_with_fallback(pools: DataFrame, receipts: DataFrame, value: str, constant: float) -> DataFrame:
    """CST-18: median of a pool's receipts, else of its type's receipts, else a constant."""
    per = quantiles_linear(receipts, ["pool"], value, {"_p": 0.5}).drop("n")
    typ = quantiles_linear(receipts, ["type"], value, {"_t": 0.5}).drop("n")
    return pools.join(per, "pool", "left").join(typ, "type", "left").withColumn(
        "value", F.coalesce("_p", "_t", F.lit(constant))).withColumn(
        "value_src", F.when(F.col("_p").isNotNull(), "pool").when(F.col("_t").isNotNull(), "type").otherwise("constant")).drop("_p", "_t")
