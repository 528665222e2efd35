"""Projections, filters and conversions (PRJ). Column arithmetic and joins with dimension tables only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import signif

# fixed values: quote classes, in order of preference as the base currency
BASE_QUOTES = ("ETH", "WETH", "USDG")


def usable_v4(df: DataFrame, liquidity: str = "liquidity", depth: str = "depth1_eth", price: str = "price_eth",
              quote: str = "quote") -> DataFrame:
    """PRJ-1: drop rows without liquidity, depth or an ETH price; the native coin is booked as its wrapped form.

    Liquidity is text, and the test is on the text "0".
    """
    ok = (F.col(liquidity) != "0") & (F.col(depth) > 0) & (F.col(price) > 0)
    return df.filter(ok).withColumn(quote, F.when(F.col(quote) == "ETH", F.lit("WETH")).otherwise(F.col(quote)))


def size_floor(df: DataFrame, rail: str = "kind", v23: float = 10.0, v4: float = 1.0) -> DataFrame:
    """PRJ-2: minimum size per rail."""
    return df.filter(F.col("usd") >= F.when(F.col(rail) == "v4", F.lit(v4)).otherwise(F.lit(v23)))


def universe(df: DataFrame, labels: DataFrame, fallback: DataFrame | None = None, unknown: Sequence[str] = ("unknown",)) -> DataFrame:
    """PRJ-3: rows of labelled coins only; ``fallback`` (tok, pad) fills coins the first table leaves open."""
    named = labels.select("tok", "pad")
    if fallback is not None:
        named = named.join(fallback.select("tok", F.col("pad").alias("_p")), "tok", "full").select(
            "tok", F.coalesce("pad", "_p").alias("pad"))
    named = named.filter(F.col("pad").isNotNull() & ~F.col("pad").isin(*unknown))
    return df.join(named, "tok")


def label_pool(df: DataFrame, by_hook: DataFrame, by_venue: DataFrame) -> DataFrame:
    """PRJ-4: launchpad label of a pool from its hook, else from its venue."""
    out = df.join(by_hook.select("hook", F.col("pad").alias("_h")), "hook", "left").join(
        by_venue.select("venue", F.col("pad").alias("_v")), "venue", "left")
    return out.withColumn("pad", F.coalesce("_h", "_v")).drop("_h", "_v")


def orient(pools: DataFrame, named: DataFrame, pins: DataFrame | None = None, base: Sequence[str] = BASE_QUOTES) -> DataFrame:
    """PRJ-5: which of the two currencies is the token and which the quote.

    A pin decides first, then the currency that is a named token, then the rank of the base currencies, then the more
    frequent currency is the quote; a tie makes the first one the quote.
    """
    freq = pools.select(F.explode(F.array("c0", "c1")).alias("c")).groupBy("c").agg(F.count("*").alias("f"))
    toks = named.select(F.col("tok").alias("c"), F.lit(True).alias("n")).distinct()
    side = lambda d, c, s: d.join(
        freq.withColumnRenamed("c", c).withColumnRenamed("f", f"_f{s}"), c, "left").join(
        toks.withColumnRenamed("c", c).withColumnRenamed("n", f"_n{s}"), c, "left")
    out = side(side(pools, "c0", 0), "c1", 1)
    rank = lambda c: F.coalesce(*[F.when(F.col(c) == b, F.lit(i)) for i, b in enumerate(base)], F.lit(len(base)))
    n0, n1 = F.coalesce("_n0", F.lit(False)), F.coalesce("_n1", F.lit(False))
    quote = (F.when(n0 & ~n1, F.col("c1")).when(n1 & ~n0, F.col("c0"))
             .when(rank("c0") < rank("c1"), F.col("c0")).when(rank("c1") < rank("c0"), F.col("c1"))
             .when(F.col("_f0") >= F.col("_f1"), F.col("c0")).otherwise(F.col("c1")))
    if pins is not None:
        out = out.join(pins.select("pool", F.col("quote").alias("_pin")), "pool", "left")
        quote = F.coalesce(F.when(F.col("_pin").isin(F.col("c0"), F.col("c1")), F.col("_pin")), quote)
    out = out.withColumn("quote", quote)
    return out.withColumn("token", F.when(F.col("quote") == F.col("c0"), F.col("c1")).otherwise(F.col("c0"))).drop(
        "_f0", "_f1", "_n0", "_n1", "_pin")


def price_from_sqrt(df: DataFrame, sqrt_price: str, liquidity: str, dec_token: str, dec_quote: str, token_is_c0: Column,
                    amount_token: str, amount_quote: str) -> DataFrame:
    """PRJ-6: price in quote terms, depth for 1 % and 5 %, side and amounts from the raw swap fields (text integers)."""
    sp, lq = F.col(sqrt_price).try_cast("double") / F.pow(F.lit(2.0), F.lit(96)), F.col(liquidity).try_cast("double")
    raw = sp * sp
    price = F.when(token_is_c0, raw).otherwise(F.try_divide(F.lit(1.0), raw)) * F.pow(F.lit(10.0), F.col(dec_token) - F.col(dec_quote))
    # quote-side depth: L * sqrt(P) in the direction of the quote
    root = F.when(token_is_c0, sp).otherwise(F.try_divide(F.lit(1.0), sp))
    unit = F.pow(F.lit(10.0), F.col(dec_quote))
    depth = lambda pct: lq * root * (F.sqrt(F.lit(1 + pct)) - 1) / unit
    at = F.col(amount_token).try_cast("double")
    return df.select(
        "*", price.alias("price_quote"), depth(0.01).alias("depth1"), depth(0.05).alias("depth5"),
        F.when(at < 0, "buy").when(at > 0, "sell").otherwise("none").alias("side"),
        (F.abs(at) / F.pow(F.lit(10.0), F.col(dec_token))).alias("amount_token"),
        (F.abs(F.col(amount_quote).try_cast("double")) / unit).alias("amount_quote"))


def usd_and_eth(df: DataFrame, digits: int = 7) -> DataFrame:
    """PRJ-7: ETH price and USD size, to 7 significant digits; null where the quote has no price."""
    return df.withColumn("price_eth", signif(F.col("price_quote") * F.col("quote_eth"), digits)).withColumn(
        "usd", signif(F.col("amount_quote") * F.col("quote_eth") * F.col("eth_usd"), digits))


def person_creators(tokens: DataFrame, limit: int = 50) -> DataFrame:
    """PRJ-12: tokens whose creator made at most ``limit`` of them."""
    few = tokens.filter(F.col("creator").isNotNull()).groupBy("creator").agg(F.count("*").alias("made")).filter(F.col("made") <= limit)
    return tokens.join(few, "creator")


def quote_class_filter(df: DataFrame, mode: str, quote: str = "eQ") -> DataFrame:
    """PRJ-13: view ``eq`` keeps trades bought against a base currency (or an unknown one); ``full`` keeps all."""
    if mode == "full":
        return df
    return df.filter(F.col(quote).isin(*BASE_QUOTES) | F.col(quote).isNull())


def with_cells(df: DataFrame, cells: Sequence[dict]) -> DataFrame:
    """Attach every parameter cell to every row: one scan serves all cells, and no join is planned.

    ``cells`` is a fixed parameter list, so the expansion is its length.
    """
    names = list(cells[0])
    lit = F.array(*[F.struct(*[F.lit(c[n]).alias(n) for n in names]) for c in cells])
    return df.withColumn("_c", F.explode(lit)).select(*df.columns, *[F.col(f"_c.{n}").alias(n) for n in names])


def cell_filter(df: DataFrame) -> DataFrame:
    """PRJ-14: conjunction of the cell's tier, first, age and market-cap conditions; a null condition is open.

    The market cap may only be used when its price was known before the entry (``mcap_ts <= ts + delay``).
    """
    ok = lambda want, cond: F.col(want).isNull() | F.coalesce(cond, F.lit(False))
    return df.filter(
        ok("want_tier", F.col("tier") == F.col("want_tier")) & ok("want_first", F.col("first") == F.col("want_first"))
        & ok("want_age", F.col("age_band") == F.col("want_age"))
        & ok("want_mcap", F.array_contains(F.split("want_mcap", ","), F.col("mcap_band"))
             & (F.col("mcap_ts") <= F.col("ts") + F.col("delay"))))


def split_cells(trades: DataFrame, filters: DataFrame) -> DataFrame:
    """PRJ-15: derived cells as subsets of a base cell (minimum dip age, minimum sells); nulls fail."""
    got = trades.withColumnRenamed("cell", "base").join(filters, "base")
    ok = lambda lim, x: F.col(lim).isNull() | F.coalesce(F.col(x) >= F.col(lim), F.lit(False))
    return got.filter(ok("min_dip_sec", "dip_sec") & ok("min_sells", "n_sells"))


def depth_band(df: DataFrame, depth: str, half: str, fit: str = "FIT", ps: Sequence[float] = (1 / 3, 2 / 3)) -> DataFrame:
    """PRJ-18: low / mid / high by cut points fitted on one half; rows without depth are ``v23``."""
    from tidemark.operators.slicing import quantiles_linear
    cuts = quantiles_linear(df.filter(F.col(half) == fit), [], depth, {"c1": ps[0], "c2": ps[1]}).select("c1", "c2")
    d = F.col(depth)
    return df.withColumn("c1", cuts.select("c1").scalar()).withColumn("c2", cuts.select("c2").scalar()).withColumn(
        "depth_band", F.when(d.isNull(), "v23").when(d < F.col("c1"), "low").when(d < F.col("c2"), "mid").otherwise("high")
    ).drop("c1", "c2")
