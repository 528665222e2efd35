"""Searches over long time ranges without forming the pairs (first crossing, range extreme).

A range is covered by whole coarse buckets, whole fine buckets at its edges and two partial fine buckets. Bucket
extremes answer the whole ones; single prints are only read for the partial ones and for the one fine bucket that
holds the first crossing. A row meets at most three fine buckets of prints whatever the length of its range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import DAY, HOUR, bucket
from tidemark.operators.slicing import multiplied


def _units(lo: str, hi: str, fine: int, coarse: int | None) -> Column:
    """Array of (level, b): coarse buckets strictly inside, fine buckets at both edges; all fine without ``coarse``."""
    if coarse is None:
        return F.when(F.col(lo) <= F.col(hi), F.transform(
            F.sequence(bucket(lo, fine), bucket(hi, fine)), lambda b: F.struct(F.lit(1).alias("level"), b.alias("b"))))
    r = coarse // fine
    fl, fh, cl, ch = bucket(lo, fine), bucket(hi, fine), bucket(lo, coarse), bucket(hi, coarse)
    unit = lambda lv: (lambda b: F.struct(F.lit(lv).alias("level"), b.alias("b")))
    none = F.array().cast("array<struct<level:int,b:bigint>>")
    head = F.transform(F.sequence(fl, F.least(fh, (cl + 1) * r - 1)), unit(1))
    mid = F.when(ch - cl >= 2, F.transform(F.sequence(cl + 1, F.greatest(ch - 1, cl + 1)), unit(2))).otherwise(none)
    tail = F.when(ch > cl, F.transform(F.sequence(ch * r, F.greatest(fh, ch * r)), unit(1))).otherwise(none)
    return F.when(F.col(lo) <= F.col(hi), F.concat(head, mid, tail)).otherwise(none)


def first_crossing(
    pos: DataFrame, prints: DataFrame, by: Sequence[str], row_id: Sequence[str], x: Column, line: str,
    lo: str = "lo", hi: str = "hi", columns: Sequence[str] = ("ts", "blk", "px"), order: Sequence[str] = ("ts", "blk", "li"),
    fine: int = HOUR, coarse: int | None = DAY, name: str = "hit", above: bool = False,
) -> DataFrame:
    """JON-5 / TRD-7: the first print with lo <= ts <= hi and x >= line, as struct ``name`` (null when none).

    ``above`` asks for x > line. Without ``coarse`` the range is covered by fine buckets only, which saves two joins
    where it spans few of them. Pass a negated expression and line to search for a fall instead.
    """
    by, row_id = list(by), list(row_id)
    reach = (lambda v: v > F.col("_line")) if above else (lambda v: v >= F.col("_line"))
    p = prints.withColumn("_x", x).filter(F.col("_x").isNotNull())
    p = p.select(*by, bucket("ts", fine).alias("_b"), "_x", F.struct(*columns).alias("_p"),
                 F.struct(*order).alias("_o"), F.col("ts").alias("_ts"))
    h1 = p.groupBy(*by, "_b").agg(F.max("_x").alias("_m"))
    highs = h1.withColumn("_lv", F.lit(1))
    if coarse is not None:
        h2 = h1.groupBy(*by, F.floor(F.col("_b") * fine / coarse).cast("long").alias("_b")).agg(F.max("_m").alias("_m"))
        highs = highs.unionByName(h2.withColumn("_lv", F.lit(2)))
    rid = list(dict.fromkeys(by + row_id))
    at = [*rid, "_lo", "_hi", "_line"]
    want = pos.select(*rid, F.col(lo).alias("_lo"), F.col(hi).alias("_hi"), F.col(line).alias("_line"))
    units = want.withColumn("_u", F.explode(_units("_lo", "_hi", fine, coarse))).select(
        *at, F.col("_u.level").alias("_lv"), F.col("_u.b").alias("_b"))
    alive = multiplied(units).join(highs, [*by, "_lv", "_b"]).filter(reach(F.col("_m")))
    head = (F.col("_lv") == 1) & (F.col("_b") == bucket("_lo", fine))
    tail = (F.col("_lv") == 1) & (F.col("_b") == bucket("_hi", fine))
    start = F.when(F.col("_lv") == 1, F.col("_b") * fine).otherwise(F.col("_b") * (coarse or fine))
    whole = F.when(~(head | tail), F.struct(start.alias("s"), F.col("_lv").alias("lv"), F.col("_b").alias("b")))
    found = alive.groupBy(*at).agg(
        F.max(F.when(head, F.col("_b"))).alias("_head"), F.max(F.when(tail, F.col("_b"))).alias("_tail"),
        F.min(whole).alias("_w"))
    if coarse is None:
        cand = found.select(*at, F.explode(F.array_distinct(F.array_compact(F.array("_head", "_tail", F.col("_w.b"))))).alias("_b"))
    else:
        cand = _drill(found, h1, by, at, fine, coarse // fine, reach)
    hits = (cand.join(p, [*by, "_b"])
            .filter(reach(F.col("_x")) & (F.col("_ts") >= F.col("_lo")) & (F.col("_ts") <= F.col("_hi")))
            .groupBy(*row_id).agg(F.min_by("_p", "_o").alias(name)))
    return pos.join(hits, row_id, "left")


def _drill(found, h1, by, at, fine, r, reach):
    """Open up the first whole unit (itself, or the fine buckets of a coarse one) and keep the buckets to read."""
    inner = F.when(F.col("_w.lv") == 1, F.array(F.col("_w.b"))).when(
        F.col("_w.lv") == 2, F.sequence(F.col("_w.b") * r, F.col("_w.b") * r + (r - 1))).otherwise(F.array().cast("array<bigint>"))
    opened = found.withColumn("_b", F.explode(F.array_distinct(F.concat(F.array_compact(F.array("_head", "_tail")), inner))))
    kept = multiplied(opened).join(h1, [*by, "_b"]).filter(reach(F.col("_m")))
    edge = (F.col("_b") == bucket("_lo", fine)) | (F.col("_b") == bucket("_hi", fine))
    few = kept.groupBy(*at).agg(
        F.collect_set(F.when(edge, F.col("_b"))).alias("_e"), F.min(F.when(~edge, F.col("_b"))).alias("_f"))  # two edges at most
    return few.select(*at, F.explode(F.array_compact(F.concat("_e", F.array("_f")))).alias("_b"))


def range_extreme(
    pos: DataFrame, prints: DataFrame, by: Sequence[str], row_id: Sequence[str], x: Column,
    lo: str = "lo", hi: str = "hi", columns: Sequence[str] = ("ts", "px"), order: Sequence[str] = ("ts", "blk", "li"),
    fine: int = HOUR, coarse: int = DAY, name: str = "top",
) -> DataFrame:
    """The print with the largest x in lo <= ts <= hi, the earliest of equals, as struct ``name``."""
    by, row_id = list(by), list(row_id)
    rank = F.struct(x.alias("x"), *[(-F.col(c)).alias(f"o{i}") for i, c in enumerate(order)], F.struct(*columns).alias("p"))
    p = prints.filter(x.isNotNull()).select(*by, bucket("ts", fine).alias("_b"), F.col("ts").alias("_ts"), rank.alias("_k"))
    h1 = p.groupBy(*by, "_b").agg(F.max("_k").alias("_k"))
    h2 = h1.groupBy(*by, F.floor(F.col("_b") * fine / coarse).cast("long").alias("_b")).agg(F.max("_k").alias("_k"))
    none = F.lit(None).cast("long")
    table = (p.withColumn("_lv", F.lit(0)).unionByName(h1.withColumn("_lv", F.lit(1)).withColumn("_ts", none))
             .unionByName(h2.withColumn("_lv", F.lit(2)).withColumn("_ts", none)))
    rid = list(dict.fromkeys(by + row_id))
    want = pos.select(*rid, F.col(lo).alias("_lo"), F.col(hi).alias("_hi"))
    units = want.withColumn("_u", F.explode(_units("_lo", "_hi", fine, coarse))).select(
        *rid, "_lo", "_hi", F.col("_u.level").alias("_lv"), F.col("_u.b").alias("_b"))
    edge = (F.col("_lv") == 1) & ((F.col("_b") == bucket("_lo", fine)) | (F.col("_b") == bucket("_hi", fine)))
    units = units.withColumn("_lv", F.when(edge, F.lit(0)).otherwise(F.col("_lv")))  # edge buckets read prints
    best = (multiplied(units).join(table, [*by, "_lv", "_b"])
            .filter(F.col("_ts").isNull() | ((F.col("_ts") >= F.col("_lo")) & (F.col("_ts") <= F.col("_hi"))))
            .groupBy(*row_id).agg(F.max("_k").alias("_k")))
    return pos.join(best, row_id, "left").withColumn(name, F.col("_k.p")).drop("_k")


def last_below(
    pos: DataFrame, prints: DataFrame, by: Sequence[str], row_id: Sequence[str], x: Column, line: str,
    lo: str = "lo", hi: str = "hi", columns: Sequence[str] = ("ts", "px"), order: Sequence[str] = ("ts", "blk", "li"),
    fine: int = HOUR, coarse: int | None = DAY, name: str = "hit",
) -> DataFrame:
    """The last print with lo <= ts <= hi and x <= line: the first crossing on the reversed time axis."""
    back = prints.withColumn("_x0", x).select(
        *by, (-F.col("ts")).alias("ts"), "_x0", *[(-F.col(c)).alias(f"_r{i}") for i, c in enumerate(order)],
        F.struct(*columns).alias("_p0"))
    want = pos.withColumn("_l2", -F.col(hi)).withColumn("_h2", -F.col(lo)).withColumn("_n2", -F.col(line))
    got = first_crossing(want, back, by, row_id, -F.col("_x0"), "_n2", "_l2", "_h2", ("_p0",),
                         [f"_r{i}" for i in range(len(order))], fine, coarse, "_h0")
    return got.withColumn(name, F.col("_h0._p0")).drop("_l2", "_h2", "_n2", "_h0")
