"""Inference over groups of trades (STA).

Resampling works on sums per (group, day), (group, coin) or (group, coin, day), never on single trades (``resample``). Random draws
are md5-derived, so any engine can repeat them. The numbers of resamples are the rule's own: 10,000 for day blocks, 4,000 for coins
times days and for blocks of trades, 5,000 for coins and for the maximum over cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import DAY, bucket, hash_u32, normal_sf
from tidemark.operators.resample import circular_blocks, numbered, poisson_sums, resampled_sums, with_replacement
from tidemark.operators.slicing import quantiles_linear, running, width_or_layout
from tidemark.session import cut_lineage


def mean_se(df: DataFrame, group: Sequence[str], x: str) -> DataFrame:
    """STA-1: mean and standard error under independence."""
    return df.groupBy(*group).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.try_divide(F.stddev_samp(x), F.sqrt(F.count(x))).alias("se_iid"))


def cluster_se(df: DataFrame, group: Sequence[str], x: str, key: str, name: str = "se_cluster") -> DataFrame:
    """STA-2: cluster-robust standard error of the mean; null below two clusters."""
    g = list(group)
    c = df.groupBy(*g, key).agg(F.sum(x).alias("_s"), F.count(x).alias("_c"))
    tot = c.groupBy(*g).agg(F.sum("_s").alias("_all"), F.sum("_c").alias("_rows"), F.count("*").alias("_keys"))
    dev = F.col("_s") - F.col("_c") * F.col("_all") / F.col("_rows")
    out = c.join(tot, g).groupBy(*g).agg(F.sum(dev * dev).alias("_q"), F.first("_rows").alias("_rows"), F.first("_keys").alias("_keys"))
    return out.select(*g, F.when(
        F.col("_keys") >= 2, F.sqrt(F.col("_q") * F.col("_keys") / (F.col("_keys") - 1)) / F.col("_rows")).alias(name))


def unit_sums(df: DataFrame, group: Sequence[str], unit: str, x: str) -> DataFrame:
    """Sum, count and 0-based index of every unit (day, month, coin) of a group, with the number of units ``D``."""
    u = df.groupBy(*group, unit).agg(F.sum(x).alias("s"), F.count(x).alias("c"))
    return u.join(numbered(u, group, unit), [*group, unit])


def block_bootstrap(df: DataFrame, group: Sequence[str], x: str, unit: str, b: int = 10_000, length: int = 2, seed: str = "bb") -> DataFrame:
    """STA-3: circular block bootstrap of the mean over time units: se, 2.5 % and 97.5 % points, units."""
    g = list(group)
    u = cut_lineage(unit_sums(df, g, unit, x).withColumn("_one", F.lit(0)))
    bm = resampled_sums(u, g, "_one", b, circular_blocks(seed, length)).withColumn("m", F.col("s") / F.greatest(F.col("c"), F.lit(1)))
    out = bm.groupBy(*g).agg(F.stddev_samp("m").alias("se_boot"), F.percentile("m", 0.025).alias("boot_lo"), F.percentile("m", 0.975).alias("boot_hi"))
    return out.join(u.groupBy(*g).agg(F.first("D").alias("units")), g)


def moving_block_se(df: DataFrame, group: Sequence[str], x: str, order: Sequence[str], b: int = 4000, seed: str = "mb",
                    slice_width: int | None = None) -> DataFrame:
    """STA-4: non-circular blocks of ceil(sqrt(n)) trades in time order; block sums are prefix-sum differences."""
    g = list(group)
    p = running(df, g, order, {"i": ("count", F.col(x)), "pre": ("sum", F.col(x))}, bucket(order[0], width_or_layout(slice_width))).select(*g, "i", "pre")
    n = df.groupBy(*g).agg(F.count(x).alias("n"))
    size = F.ceil(F.sqrt(F.col("n"))).cast("long")
    d = n.withColumn("L", size).withColumn("nb", F.ceil(F.col("n") / F.col("L"))).withColumn(
        "b", F.explode(F.sequence(F.lit(0), F.lit(b - 1)))).withColumn("k", F.explode(F.sequence(F.lit(0), (F.col("nb") - 1).cast("int"))))
    start = hash_u32(seed, F.col("b"), F.col("k")) % (F.col("n") - F.col("L") + 1)
    length = F.least(F.col("L"), F.col("n") - F.col("k") * F.col("L"))
    ends = d.withColumn("st", start).withColumn("len", length).select(*g, "n", "b", F.explode(F.array(
        F.struct((F.col("st") + F.col("len")).alias("i"), F.lit(1).alias("sg")), F.struct(F.col("st").alias("i"), F.lit(-1).alias("sg")))).alias("e"))
    got = ends.select(*g, "n", "b", F.col("e.i").alias("i"), F.col("e.sg").alias("sg")).join(p, [*g, "i"], "left")
    bm = got.groupBy(*g, "b").agg((F.sum(F.coalesce("pre", F.lit(0.0)) * F.col("sg")) / F.first("n")).alias("m"))
    return bm.groupBy(*g).agg(F.stddev_samp("m").alias("se_block"))


def pigeonhole_se(df: DataFrame, group: Sequence[str], x: str, coin: str, day: str, b: int = 4000, seed: str = "pg") -> DataFrame:
    """STA-5: Poisson(1) weights per coin times per day, drawn once for all groups."""
    g = list(group)
    u = df.groupBy(F.struct(*g).alias("_g"), coin, day).agg(F.sum(x).alias("s"), F.count(x).alias("c"))
    ids = u.select("_g").distinct().withColumn("_cell", F.to_json("_g"))
    bm = poisson_sums(u.withColumn("_cell", F.to_json("_g")), "_cell", coin, day, b, seed).filter("c > 0")
    out = bm.groupBy("_cell").agg(F.stddev_samp(F.col("s") / F.col("c")).alias("se_pigeon"))
    return out.join(ids, "_cell").select("_g.*", "se_pigeon")


def coin_bootstrap(df: DataFrame, group: Sequence[str], x: str, coin: str, b: int = 5000, seed: str = "cb") -> DataFrame:
    """STA-6: coins drawn with replacement, each with all its trades; 2.5 % and 97.5 % points."""
    g = list(group)
    u = cut_lineage(unit_sums(df, g, coin, x).withColumn("_one", F.lit(0)))
    bm = resampled_sums(u, g, "_one", b, with_replacement(seed)).withColumn("m", F.col("s") / F.greatest(F.col("c"), F.lit(1)))
    return bm.groupBy(*g).agg(F.percentile("m", 0.025).alias("coin_lo"), F.percentile("m", 0.975).alias("coin_hi"))


def inference(df: DataFrame, group: Sequence[str], x: str, coin: str, day: str, b: int = 10_000, seed: str = "bb") -> DataFrame:
    """STA-7: conservative standard error, the interval that starts lower, one-sided p, MDE and upper bound."""
    g = list(group)
    out = (mean_se(df, g, x).join(cluster_se(df, g, x, coin, "se_coin"), g).join(cluster_se(df, g, x, day, "se_day"), g)
           .join(block_bootstrap(df, g, x, day, b, 2, seed), g))
    se, m = F.greatest("se_iid", "se_coin", "se_day", "se_boot"), F.col("mean")
    lo = m - 1.96 * F.col("se")
    normal = lo <= F.col("boot_lo")
    return out.withColumn("se", se).withColumn("ci_lo", F.when(normal, lo).otherwise(F.col("boot_lo"))).withColumn(
        "ci_hi", F.when(normal, m + 1.96 * F.col("se")).otherwise(F.col("boot_hi"))).withColumn(
        "p", F.when(F.col("se") > 0, normal_sf(m / F.col("se")))).withColumn("mde80", 2.487 * F.col("se")).withColumn(
        "upper95", m + 1.645 * F.col("se"))


def summarize_calls(df: DataFrame, group: Sequence[str], x: str, caller: str, coin: str, day: str, order: Sequence[str], b: int = 4000) -> DataFrame:
    """STA-8: the largest of six standard errors and which one it was; below three rows only the mean."""
    g = list(group)
    out = (mean_se(df, g, x).join(cluster_se(df, g, x, caller, "se_caller"), g).join(cluster_se(df, g, x, coin, "se_coin"), g)
           .join(cluster_se(df, g, x, day, "se_day"), g).join(pigeonhole_se(df, g, x, coin, day, b), g).join(moving_block_se(df, g, x, order, b), g))
    return widest_error(out)


def widest_error(parts: DataFrame, min_n: int = 3) -> DataFrame:
    """Largest of the standard errors in ``parts`` and its name; null errors do not compete, the first of equals wins."""
    names = ["iid", "caller", "coin", "day", "pigeon", "block"]
    best = F.array_max(F.array(*[F.struct(F.coalesce(F.col(f"se_{n}"), F.lit(-1.0)).alias("se"), F.lit(-i).alias("o"), F.lit(n).alias("n"))
                                 for i, n in enumerate(names)]))
    ok = F.col("n") >= min_n
    return parts.withColumn("se", F.when(ok, best["se"])).withColumn("se_winner", F.when(ok, best["n"])).withColumn(
        "ci_lo", F.col("mean") - 1.96 * F.col("se")).withColumn("ci_hi", F.col("mean") + 1.96 * F.col("se"))


def paired_delta(pairs: DataFrame, group: Sequence[str], ret: str, twin: str, coin: str) -> DataFrame:
    """STA-9: d = trade minus the mean of its twins, over trades that have twins."""
    d = pairs.filter(F.col(twin).isNotNull()).withColumn("d", F.col(ret) - F.col(twin))
    se = cluster_se(d, group, "d", coin, "se_coin")
    med = quantiles_linear(d, group, "d", {"d_median": 0.5}).drop("n")
    return d.groupBy(*group).agg(F.count("*").alias("n"), F.count_distinct(coin).alias("coins"), F.avg("d").alias("d_mean"),
                                 F.avg(twin).alias("twin_mean"), F.avg((F.col(twin) <= -50).cast("int")).alias("twin_crash")
                                 ).join(med, list(group)).join(se, list(group))


def reality_check(df: DataFrame, cell: str, x: str, coin: str, day: str, b: int = 5000, seed: str = "rc") -> DataFrame:
    """STA-10: adjusted p per cell from the maximum over all cells, resampling day blocks and coins.

    One set of weights per resample serves every cell. A cell without trades in the drawn units has mean 0.
    """
    stat = cut_lineage(mean_se(df, [cell], x).withColumn("t", F.try_divide("mean", "se_iid")))
    out = stat
    for name, unit, weights in (("day", day, circular_blocks(seed, 2)), ("coin", coin, with_replacement(f"{seed}|c"))):
        sums = cut_lineage(df.groupBy(cell, unit).agg(F.sum(x).alias("s"), F.count(x).alias("c")).join(numbered(df, [], unit), unit).withColumn("_all", F.lit(0)))
        bm = resampled_sums(sums, ["_all"], cell, b, weights).join(stat.select(cell, "mean", "se_iid"), cell)
        peak = cut_lineage(bm.groupBy("b").agg(F.max(F.try_divide(F.col("s") / F.greatest(F.col("c"), F.lit(1)) - F.col("mean"), F.col("se_iid"))).alias("mx")))
        tests = stat.select(cell, "t").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(b - 1)))).join(peak, "b")
        tests = tests.groupBy(cell).agg(F.avg((F.col("mx") >= F.col("t")).cast("int")).alias("p"))
        out = out.join(tests.withColumnRenamed("p", f"p_{name}"), cell)
    return out


def holm(df: DataFrame, p: str, alpha: float, group: Sequence[str] = (), tie: str = "cell") -> DataFrame:
    """STA-11: step-down test; strict, and the first failure fails all after it. A missing p comes last and fails.

    One row per cell, so a family fits one window.
    """
    keys = list(group) or [F.lit(0)]
    w = Window.partitionBy(*keys)
    rank = F.row_number().over(w.orderBy(F.col(p).isNull(), F.col(p), F.col(tie)))
    ok = F.coalesce(F.col(p) < alpha / (F.col("_m") - F.col("_r") + 1), F.lit(False))
    d = df.withColumn("_m", F.count("*").over(w)).withColumn("_r", rank).withColumn("_ok", ok.cast("int"))
    run = F.min("_ok").over(w.orderBy("_r").rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("holm_pass", run == 1).withColumn("bonferroni_pass", F.coalesce(F.col(p) < alpha / F.col("_m"), F.lit(False))).drop("_m", "_r", "_ok")


def verdict(df: DataFrame, rules: Sequence[tuple[Column, str]], default: str, name: str = "verdict") -> DataFrame:
    """STA-12: label of the first condition that holds."""
    out = F.lit(default)
    for cond, label in reversed(list(rules)):
        out = F.when(cond, F.lit(label)).otherwise(out)
    return df.withColumn(name, out)


def seed_agreement(runs: DataFrame, rule: str, conds: dict[str, Column], stats: Sequence[str]) -> DataFrame:
    """STA-13: share of seeds that pass each condition and all of them, and min / p5 / p50 / p95 / max of the statistics."""
    every = F.lit(True)
    for c in conds.values():
        every = every & F.coalesce(c, F.lit(False))
    out = runs.groupBy(rule).agg(F.count("*").alias("seeds"), F.avg(every.cast("int")).alias("all_pass"), *[
        F.avg(F.coalesce(c, F.lit(False)).cast("int")).alias(f"share_{n}") for n, c in conds.items()])
    for s in stats:
        q = quantiles_linear(runs, [rule], s, {f"{s}_min": 0.0, f"{s}_p5": 0.05, f"{s}_p50": 0.5, f"{s}_p95": 0.95, f"{s}_max": 1.0}).drop("n")
        out = out.join(q, rule)
    return out


def smoothness(grid: DataFrame, line: Sequence[str], axis: str, n: str, value: str, se: str, rise: float = 0.05) -> DataFrame:
    """STA-14: along an ordered dial, counts that rise by more than 5 % and values more than 2 se off their neighbours' mean."""
    w = Window.partitionBy(*line).orderBy(axis)
    d = grid.withColumn("_n0", F.lag(n).over(w)).withColumn("_v0", F.lag(value).over(w)).withColumn("_v1", F.lead(value).over(w))
    kink = F.abs(F.col(value) - (F.col("_v0") + F.col("_v1")) / 2) > 2 * F.col(se)
    return d.withColumn("count_rise", F.coalesce(F.col(n) > (1 + rise) * F.col("_n0"), F.lit(False))).withColumn(
        "kink", F.coalesce(kink, F.lit(False))).drop("_n0", "_v0", "_v1")


def crash_decomposition(df: DataFrame, group: Sequence[str], ret: str, d: str, crash: float = -50.0) -> DataFrame:
    """STA-15: the mean difference split into the part from crashed trades and the rest."""
    c = F.col(ret) <= crash
    n = F.count(d)
    return df.groupBy(*group).agg(n.alias("n"), F.count_if(c & F.col(d).isNotNull()).alias("n_crash"), F.avg(d).alias("d_mean"),
                                  (F.sum(F.when(c, F.col(d)).otherwise(0.0)) / F.nullif(n, F.lit(0))).alias("d_from_crash"),
                                  (F.sum(F.when(~c, F.col(d)).otherwise(0.0)) / F.nullif(n, F.lit(0))).alias("d_from_rest"))


def neighbour_check(points: DataFrame, dials: Sequence[str], cost: str, test: str, mean: str, row_id: str, min_n: int = 1,
                    min_share: float = 0.5) -> DataFrame:
    """STA-16: points one level away on one dial, same cost class; those of the same test when there are any.

    Each point sends itself to its 2 x dials neighbouring positions; the match is an equi-join on the position.
    """
    moved = [F.struct(*[(F.col(d) + (s if d == m else 0)).cast("long").alias(d) for d in dials]) for m in dials for s in (-1, 1)]
    sent = points.select(F.col(row_id).alias("_id"), F.col(test).alias("_test"), cost, F.explode(F.array(*moved)).alias("k")).select(
        "_id", "_test", cost, *[F.col(f"k.{d}").alias(d) for d in dials])
    near = sent.join(points.filter(F.col(mean).isNotNull()).select(
        cost, F.col(test).alias("_t2"), F.col(mean).alias("_m"), *[F.col(d).cast("long").alias(d) for d in dials]), [cost, *dials])
    same = F.col("_test") == F.col("_t2")
    agg = near.groupBy("_id").agg(F.count_if(same).alias("_ns"), F.count_if(same & (F.col("_m") > 0)).alias("_ps"),
                                  F.count_if(~same).alias("_na"), F.count_if(~same & (F.col("_m") > 0)).alias("_pa"))
    out = points.join(agg.withColumnRenamed("_id", row_id), row_id, "left").na.fill(0, ["_ns", "_ps", "_na", "_pa"])
    use = F.col("_ns") > 0
    n, pos = F.when(use, F.col("_ns")).otherwise(F.col("_na")), F.when(use, F.col("_ps")).otherwise(F.col("_pa"))
    return out.withColumn("neighbours", n).withColumn("positive", pos).withColumn(
        "scope", F.when(use, "same test").when(F.col("_na") > 0, "any test")).withColumn(
        "a3_pass", (F.col("neighbours") >= min_n) & (F.try_divide("positive", "neighbours") >= min_share)).drop("_ns", "_ps", "_na", "_pa")


def screen(points: DataFrame, min_n: int, min_coins: int, min_days: int) -> DataFrame:
    """STA-17: gates S1 (size, lower bound, no post-hoc), A1 (coin bootstrap), A2 (coins, days), A3 (neighbours) with reasons."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    s1n, s1l, s1p = yes(F.col("n") >= min_n), yes(F.col("lower") > 0), ~yes(F.col("posthoc"))
    a1, a2, a3 = yes(F.col("coin_lo") > 0), yes((F.col("coins") >= min_coins) & (F.col("days") >= min_days)), yes(F.col("a3_pass"))
    why = F.array_compact(F.array(*[F.when(~c, F.lit(n)) for n, c in (("n", s1n), ("lower", s1l), ("posthoc", s1p), ("A1", a1), ("A2", a2), ("A3", a3))]))
    return points.withColumn("S1", s1n & s1l & s1p).withColumn("A1", a1).withColumn("A2", a2).withColumn("A3", a3).withColumn(
        "fails", F.array_join(why, ",")).withColumn("all_pass", F.size(why) == 0)


def robust_score(df: DataFrame, min_n: int = 40, min_coins: int = 8) -> DataFrame:
    """STA-18: the lower of the lower bound and the mean without the five best coins, for large enough cells."""
    ok = (F.col("n") >= min_n) & (F.col("coins") >= min_coins) & F.col("lower").isNotNull() & F.col("drop_coins_sum").isNotNull()
    return df.withColumn("J", F.when(ok, F.least("lower", "drop_coins_sum")))


def tp_gap(df: DataFrame, group: Sequence[str], booked: str, line: str) -> DataFrame:
    """STA-19: how far the booked target sale lies from its line: share below, mean, median and worst gap in percent."""
    d = df.withColumn("_g", 100 * (F.try_divide(booked, line) - 1))
    med = quantiles_linear(d, group, "_g", {"gap_median": 0.5}).drop("n")
    return d.groupBy(*group).agg(F.count("_g").alias("n"), F.avg((F.col("_g") < 0).cast("int")).alias("below"), F.avg("_g").alias("gap_mean"),
                                 F.min("_g").alias("gap_worst")).join(med, list(group))


def subset_views(df: DataFrame, flags: dict[str, Column], x: str, group: Sequence[str] = ()) -> DataFrame:
    """STA-20: the same block on several subsets in one pass; a row joins every subset whose flag holds."""
    names = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in flags.items()]))
    d = df.withColumn("view", F.explode(names))
    return mean_se(d, [*group, "view"], x)


def per_day_mean(df: DataFrame, group: Sequence[str], day: str, x: str, split: int | None = None) -> DataFrame:
    """STA-21: daily means, and which side of an instant the day lies on."""
    out = df.groupBy(*group, day).agg(F.count(x).alias("n"), F.avg(x).alias("mean"))
    if split is not None:
        out = out.withColumn("part", F.when(F.col(day) * DAY < split, "early").otherwise("late"))
    return out


def reconcile(published: DataFrame, rows: DataFrame, key: Sequence[str], x: str, coin: str, rel: float = 1e-6, tol: float = 0.006) -> DataFrame:
    """STA-22: counts, coins and mean recomputed from the rows against the published record."""
    got = rows.groupBy(*key).agg(F.count(x).alias("_n"), F.count_distinct(coin).alias("_c"), F.avg(x).alias("_m"))
    j = published.join(got, list(key), "full")
    close = F.abs(F.col("mean") - F.col("_m")) <= F.greatest(F.lit(tol), rel * F.abs(F.col("_m")))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return j.select(*key, yes(F.col("n") == F.col("_n")).alias("n_ok"), yes(F.col("coins") == F.col("_c")).alias("coins_ok"), yes(close).alias("mean_ok"))
