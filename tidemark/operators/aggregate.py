"""Aggregations over trades, calls and grids (AGG-11..30)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import DAY, bucket
from tidemark.operators.slicing import quantiles_linear, running, upper_median, width_or_layout


def concentration(df: DataFrame, group: Sequence[str], coin: str, day: str, value: str, hit: float = 50.0) -> DataFrame:
    """AGG-11: top coin and day with their share of a positive total, and coins with a trade of at least ``hit``."""
    g = list(group)
    part = lambda c: df.groupBy(*g, c).agg(F.sum(value).alias("s"), F.max(value).alias("m"))
    coins = part(coin).groupBy(*g).agg(
        F.sum("s").alias("total"), F.min_by(F.struct(coin, "s"), F.struct((-F.col("s")).alias("a"), coin)).alias("_c"),
        F.count("*").alias("coins"), F.count_if(F.col("m") >= hit).alias("hit_coins"))
    days = part(day).groupBy(*g).agg(F.min_by(F.struct(day, "s"), F.struct((-F.col("s")).alias("a"), day)).alias("_d"))
    out = coins.join(days, g)
    share = lambda c: F.when(F.col("total") > 0, F.col(f"{c}.s") / F.col("total"))
    return out.select(*g, "total", "coins", "hit_coins", F.col(f"_c.{coin}").alias("top_coin"), share("_c").alias("top_coin_share"),
                      F.col(f"_d.{day}").alias("best_day"), share("_d").alias("best_day_share"))


def shares(df: DataFrame, group: Sequence[str], preds: dict[str, Column]) -> DataFrame:
    """AGG-12: share of rows per predicate; a null predicate counts as no."""
    return df.groupBy(*group).agg(F.count("*").alias("n"), *[
        F.avg(F.coalesce(p, F.lit(False)).cast("int")).alias(n) for n, p in preds.items()])


def reason_counts(df: DataFrame, group: Sequence[str], reason: str) -> DataFrame:
    """AGG-13: counter map of a column; counts are formed before the map, which has one entry per distinct value."""
    c = df.groupBy(*group, reason).agg(F.count("*").alias("n"))
    return c.groupBy(*group).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(reason, "n")))).alias("counts"))


def coverage(df: DataFrame, dims: Sequence[str], filled: Column, priced: Column, rail: str, outage: Column | None = None) -> DataFrame:
    """AGG-14: filled and priced shares per dimension, for all rows, and for all rows outside the outage."""
    d = df.withColumn("_f", filled.cast("int")).withColumn("_p", priced.cast("int"))
    body = [F.count("*").alias("n"), F.sum("_f").alias("filled"), F.sum("_p").alias("priced"),
            F.sum(F.when(F.col(rail) == "v4", F.col("_p")).otherwise(0)).alias("priced_v4"), F.avg("_p").alias("priced_share")]
    sets = d.groupingSets([[c] for c in dims] + [[]], *dims).agg(*body)
    name = F.lit("ALL")
    for c in dims:
        name = F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c))).otherwise(name)
    out = sets.select(name.alias("scope"), "n", "filled", "priced", "priced_v4", "priced_share")
    if outage is not None:
        out = out.unionByName(d.filter(~outage).agg(F.lit("ex-outage").alias("scope"), *body))
    return out


def unpriced_reason(df: DataFrame, group: Sequence[str], rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """AGG-15: rows without a price by the first rule that explains them."""
    why = F.lit("unexplained")
    for name, cond in reversed(list(rules)):
        why = F.when(cond, F.lit(name)).otherwise(why)
    return df.groupBy(*group, why.alias("why")).agg(F.count("*").alias("n"))


def data_gate(df: DataFrame, group: Sequence[str], role: str, strategy: str = "S") -> DataFrame:
    """AGG-16: per cell, counts per role and the gates G1 (priced share), G4 (small prints), G5 (unbelievable prices),
    G10 (G1 and G4 for every twin role that drew).

    Columns: status (booked / nofill / trunc / skip), fallback, small (0..2 small prints), g5_fail.
    """
    g = list(group)
    st = lambda s: F.sum((F.col("status") == s).cast("int"))
    per = df.groupBy(*g, role).agg(
        st("booked").alias("booked"), st("nofill").alias("nofill"), st("trunc").alias("trunc"), st("skip").alias("skipped"),
        F.sum(F.when(F.col("status") == "booked", F.col("fallback").cast("int")).otherwise(0)).alias("fallback"),
        F.sum(F.when(F.col("status") == "booked", F.col("small")).otherwise(0)).alias("small"), F.sum("g5_fail").alias("g5_fail"))
    draws = F.col("booked") + F.col("nofill") + F.col("trunc")
    per = per.withColumn("draws", draws).withColumn(
        "priced_share", F.when(draws > 0, (F.col("booked") - F.col("fallback")) / draws)).withColumn(
        "small_share", F.when(F.col("booked") > 0, F.col("small") / (2 * F.col("booked"))))
    g1, g4 = F.coalesce(F.col("priced_share"), F.lit(0.0)) >= 0.60, F.coalesce(F.col("small_share"), F.lit(0.0)) < 0.20
    is_s, mark = F.col(role) == strategy, lambda ok: F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("FAIL")
    return per.groupBy(*g).agg(
        F.sum("draws").alias("draws"), F.sum("booked").alias("booked"), F.max(F.when(is_s, F.col("priced_share"))).alias("priced_share"),
        mark(F.max(F.when(is_s, g1.cast("int"))) == 1).alias("G1"), mark(F.max(F.when(is_s, g4.cast("int"))) == 1).alias("G4"),
        mark(F.sum("g5_fail") == 0).alias("G5"),
        F.when(F.coalesce(F.min(F.when(~is_s & (F.col("draws") > 0), (g1 & g4).cast("int"))), F.lit(1)) == 1, "PASS").otherwise("FAIL").alias("G10"))


def gate_meta(audit: DataFrame, holes: DataFrame, days: DataFrame, cut: int) -> DataFrame:
    """AGG-17: gate G2: no hole, no disorder, no empty day, and data up to the last hour before the cut."""
    a = audit.agg(F.sum("inversions").alias("inversions"), F.max("last_ts").alias("last_ts"))
    h = holes.agg(F.count("*").alias("holes"))
    d = days.agg(F.count("*").alias("days"), (F.max("day") - F.min("day") + 1).alias("span"))
    one = (a.withColumn("holes", h.scalar()).withColumn("days", d.select("days").scalar())
           .withColumn("span", d.select("span").scalar()))
    ok = (F.col("inversions") == 0) & (F.col("holes") == 0) & (F.col("days") == F.col("span")) & (F.col("last_ts") >= cut - 3600)
    return one.withColumn("empty_days", F.col("span") - F.col("days")).withColumn("G2", F.when(ok, "PASS").otherwise("FAIL")).drop("span")


def slices(df: DataFrame, dims: Sequence[str], value: str) -> DataFrame:
    """AGG-18: the block for every level of each dial and every pair of dials, in one pass."""
    pairs = [[a, b] for i, a in enumerate(dims) for b in dims[i + 1:]]
    out = df.groupingSets([[d] for d in dims] + pairs + [[]], *dims).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return out


def top_k_drop(df: DataFrame, group: Sequence[str], value: str, k: int, coin: str, row_id: str) -> DataFrame:
    """AGG-19: mean without the k best trades (null up to k trades), and without the k coins with the largest sum or mean.

    The k best are found by a per-group limit that Spark applies before the shuffle; sums are then corrected.
    """
    g = list(group)
    tot = df.groupBy(*g).agg(F.count(value).alias("n"), F.sum(value).alias("s"))
    best = lambda d, order: d.withColumn("_rk", F.row_number().over(Window.partitionBy(*g).orderBy(*order))).filter(F.col("_rk") <= k)
    t = best(df, [F.desc(value), row_id]).groupBy(*g).agg(F.sum(value).alias("ts"), F.count("*").alias("tn"))
    coins = df.groupBy(*g, coin).agg(F.sum(value).alias("cs"), F.count(value).alias("cn"))
    bysum = best(coins, [F.desc("cs"), coin]).groupBy(*g).agg(F.sum("cs").alias("ss"), F.sum("cn").alias("sn"))
    bymean = best(coins, [F.desc(F.col("cs") / F.col("cn")), coin]).groupBy(*g).agg(F.sum("cs").alias("ms"), F.sum("cn").alias("mn"))
    out = tot.join(t, g).join(bysum, g).join(bymean, g)
    rest = lambda s, n: F.when(F.col("n") > F.col(n), (F.col("s") - F.col(s)) / (F.col("n") - F.col(n)))
    return out.select(*g, "n", F.when(F.col("n") > k, rest("ts", "tn")).alias("drop_trades"), rest("ss", "sn").alias("drop_coins_sum"),
                      rest("ms", "mn").alias("drop_coins_mean"))


def no_repeats(df: DataFrame, group: Sequence[str], coin: str, ts: str, row_id: str) -> DataFrame:
    """AGG-20: first trade of each coin; one aggregate, so repeated coins combine before the shuffle."""
    rest = [c for c in df.columns if c not in (*group, coin)]
    pick = df.groupBy(*group, coin).agg(F.min_by(F.struct(*rest), F.struct(ts, row_id)).alias("_r"))
    return pick.select(*group, coin, "_r.*")


def eq_view(df: DataFrame, group: Sequence[str], value: str, quote: str, coin: str, base: Sequence[str]) -> DataFrame:
    """AGG-21: count, coins, mean and median, for all trades and for those bought against a base currency."""
    both = df.withColumn("view", F.explode(F.when(F.col(quote).isin(*base) | F.col(quote).isNull(), F.array(F.lit("full"), F.lit("eq")))
                                           .otherwise(F.array(F.lit("full")))))
    g = [*group, "view"]
    med = quantiles_linear(both, g, value, {"median": 0.5}).drop("n")
    return both.groupBy(*g).agg(F.count(value).alias("n"), F.count_distinct(coin).alias("coins"), F.avg(value).alias("mean")).join(med, g)


def distincts(df: DataFrame, group: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """AGG-22: exact distinct counts."""
    return df.groupBy(*group).agg(F.count("*").alias("n"), *[F.count_distinct(c).alias(f"n_{c}") for c in cols])


def outliers(df: DataFrame, group: Sequence[str], value: str, row_id: str, k: int) -> DataFrame:
    """AGG-23: the k best and k worst rows of each group."""
    def side(order, name):
        w = Window.partitionBy(*group).orderBy(order, row_id)
        return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumn("side", F.lit(name))
    return side(F.desc(value), "best").unionByName(side(F.asc(value), "worst"))


def overlap_share(df: DataFrame, group: Sequence[str], coin: str, start: str, end: str, row_id: str, slice_width: int | None = None) -> DataFrame:
    """AGG-24: share of trades still open when the coin's next entry begins."""
    neg = df.withColumn("_ns", -F.col(start)).withColumn("_ni", -F.col(row_id))
    nxt = running(neg, [*group, coin], ["_ns", "_ni"], {"_next": ("last", F.col(start))}, bucket("_ns", width_or_layout(slice_width)), False)
    return nxt.groupBy(*group).agg(F.count("*").alias("n"), F.avg(F.coalesce(F.col("_next") < F.col(end), F.lit(False)).cast("int")).alias("overlap"))


def funnel(df: DataFrame, group: Sequence[str], status: str, stages: Sequence[str]) -> DataFrame:
    """AGG-25: how many candidates each stage took or dropped, one column per stage."""
    return df.groupBy(*group).pivot(status, list(stages)).agg(F.count(F.lit(1))).na.fill(0, list(stages))


def prepass_histograms(df: DataFrame, classes: dict[str, Column]) -> DataFrame:
    """AGG-26: distribution of each class over the grid, no outcomes involved."""
    arr = F.array(*[F.struct(F.lit(n).alias("feature"), c.cast("string").alias("class")) for n, c in classes.items()])
    return df.select(F.explode(arr).alias("e")).groupBy("e.feature", "e.class").agg(F.count("*").alias("n"))


def lag_cdf(df: DataFrame, group: Sequence[str], lag: str, edges: Sequence[int]) -> DataFrame:
    """AGG-27: share of rows with the lag within each edge, and share without any."""
    return df.groupBy(*group).agg(F.count("*").alias("n"), *[
        F.avg(F.coalesce(F.col(lag) <= e, F.lit(False)).cast("int")).alias(f"within_{e}") for e in edges],
        F.avg(F.col(lag).isNull().cast("int")).alias("never"))


def median_series(df: DataFrame, ts: str, value: str, width: int) -> DataFrame:
    """AGG-28: median per time bucket."""
    d = df.withColumn("b", bucket(ts, width))
    return quantiles_linear(d, ["b"], value, {"median": 0.5})


def holdout_error(df: DataFrame, estimate: str, truth: str, group: Sequence[str] = ()) -> DataFrame:
    """AGG-29: median, 90th percentile and maximum of the absolute error."""
    e = df.withColumn("_e", F.abs(F.col(estimate) - F.col(truth)).cast("double"))
    return quantiles_linear(e, group, "_e", {"err_p50": 0.5, "err_p90": 0.9, "err_max": 1.0})


def drift(df: DataFrame, era: str, coin: str, size: str, level: str) -> DataFrame:
    """AGG-30: rows, coins, upper median of the twin universe and mean match level per era."""
    med = upper_median(df, [era], size, "twin_median").drop("n")
    return df.groupBy(era).agg(F.count("*").alias("n"), F.count_distinct(coin).alias("coins"), F.avg(level).alias("mean_level")).join(med, era)


