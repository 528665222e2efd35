"""Comparing runs and tables, top-k and families (SET)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage


def top_k_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """SET-2: first k rows per group. Spark limits each group on the map side before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def multiset_compare(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    """SET-3: rows of two runs as multisets: totals and the counts found only on one side."""
    count = lambda d, n: d.select(F.to_json(F.struct(*cols)).alias("row")).groupBy("row").agg(F.count("*").alias(n))
    j = count(a, "na").join(count(b, "nb"), "row", "full").na.fill(0, ["na", "nb"])
    z = F.lit(0)
    return j.agg(F.sum("na").alias("rows_a"), F.sum("nb").alias("rows_b"), F.sum(F.greatest(F.col("na") - F.col("nb"), z)).alias("only_a"),
                 F.sum(F.greatest(F.col("nb") - F.col("na"), z)).alias("only_b"))


def keyed_diff(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """SET-4: per key: same, differ, only_a or only_b, with the list of differing fields."""
    left = a.select(*keys, F.struct(*cols).alias("_a"))
    right = b.select(*keys, F.struct(*cols).alias("_b"))
    j = left.join(right, list(keys), "full")
    fields = F.array_compact(F.array(*[F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in cols]))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return j.withColumn("fields", F.when(both, fields).otherwise(F.array().cast("array<string>"))).withColumn(
        "status", F.when(F.col("_a").isNull(), "only_b").when(F.col("_b").isNull(), "only_a").when(F.size("fields") == 0, "same").otherwise("differ"))


def diff_summary(diff: DataFrame) -> DataFrame:
    """Counts per status, and per field under ``field:<name>``."""
    marks = F.concat(F.array(F.col("status")), F.transform("fields", lambda f: F.concat(F.lit("field:"), f)))
    return diff.select(F.explode(marks).alias("what")).groupBy("what").agg(F.count("*").alias("n"))


def carry_forward_table(full: DataFrame, old: DataFrame, key: str, birth: str, cutoff: int) -> DataFrame:
    """SET-5: old rows verbatim; a new row only if its birth is unknown or before the cutoff."""
    fresh = full.join(old.select(key), key, "left_anti").filter(F.col(birth).isNull() | (F.col(birth) < cutoff))
    return old.withColumn("origin", F.lit("old")).unionByName(fresh.withColumn("origin", F.lit("new")))


def table_changes(full: DataFrame, old: DataFrame, key: str, value: str) -> DataFrame:
    """SET-5: kinds of difference between the kept row and the full table: unknown->known, changed, absent."""
    j = old.select(key, F.col(value).alias("_o")).join(full.select(key, F.col(value).alias("_n"), F.lit(1).alias("_in")), key, "left")
    kind = (F.when(F.col("_in").isNull(), "absent").when(F.col("_o").isNull() & F.col("_n").isNotNull(), "unknown->known")
            .when(~F.col("_o").eqNullSafe(F.col("_n")), "changed").otherwise("same"))
    return j.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


COMMON_ITEMS = 200_000  # items at most that are ranked by how common they are; the others count as equally rare


def overlap_pairs(sets: DataFrame, point: str, item: str, share: float, of: str = "larger") -> DataFrame:
    """SET-6: pairs of points that share at least ``share`` of the larger (or smaller) one's items, without forming
    every pair of an item's points.

    Items are ranked from rare to common. Two sets of which the larger has n items can only share ceil(share * n) of
    them if they meet within the first n - ceil(share * n) + 1 of each, so only that prefix is matched, of sets whose size allows
    a partner at all. Sets with the same items form one class first and meet others once. Each row of a prefix carries a 64-bit sketch of
    its set: a bit of one that the other lacks is an item that they do not share, so most pairs end where they meet. The pairs kept are then
    counted exactly on their items. The sets are shuffled once, by point, and written with their ranks.
    """
    f = sets.groupBy(item).agg(F.count("*").alias("f"))
    common_items = cut_lineage(f.filter(F.col("f") > sets.count() // COMMON_ITEMS))
    whole, order = Window.partitionBy(point), Window.partitionBy(point).orderBy(F.coalesce("f", F.lit(0)), item)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(item), F.lit(64)).cast("int"))
    # order-independent 128-bit signature, in a point's first row only
    h1, h2 = F.sum(F.xxhash64(item).cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit("b"), F.col(item)))
    ranked = sets.select(point, item).repartition(point).distinct().join(common_items, item, "left").select(
        point, item, F.row_number().over(order).alias("pos"), F.count("*").over(whole).alias("n"), F.bit_or(bit).over(whole).alias("sketch"),
        h1.over(whole).alias("h1"), h2.over(whole).alias("h2"))
    first = F.col("pos") == 1
    ranked = cut_lineage(ranked.withColumns({h: F.when(first, F.col(h)) for h in ("h1", "h2")}))
    # identical sets: one representative each
    sig = ranked.filter(first).select(point, "n", "h1", "h2")
    cls = cut_lineage(sig.groupBy("n", "h1", "h2").agg(F.min(point).alias("rep"), F.count("*").alias("_m")).filter("_m > 1").drop("_m"))
    same = cut_lineage(sig.join(cls, ["n", "h1", "h2"]).filter(F.col(point) != F.col("rep")).select(F.col("rep").alias("a"), F.col(point).alias("b")))
    reps = ranked.select(point, item, "pos", "n", "sketch").join(same.select(F.col("b").alias(point)), point, "left_anti")
    prefix = reps.filter(F.col("pos") <= F.col("n") - F.ceil(share * F.col("n") - 1e-9) + 1)
    if of == "larger":
        prefix = prefix.filter(F.col("n") / (F.col("n") + 1) >= share)
    side = lambda d, x: d.select(item, F.col(point).alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"k{x}"))
    a = side(prefix, "a")
    # the smaller set must meet the other within its own prefix; for the stricter share both must
    b = side(prefix if of == "larger" else reps, "b")
    lo, hi = F.least("na", "nb"), F.greatest("na", "nb")
    smaller_first = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    base = hi if of == "larger" else lo
    lacks = lambda x, y: F.bit_count(F.col(f"k{x}").bitwiseAND(F.bitwise_not(F.col(f"k{y}"))))
    most = F.least(F.col("na") - lacks("a", "b"), F.col("nb") - lacks("b", "a"))
    cand = cut_lineage(a.join(b, item).filter(smaller_first & (most / base >= share)).select("a", "b", "na", "nb").distinct())
    ends = cand.select(F.explode(F.array("a", "b")).alias(point)).distinct()
    few = cut_lineage(ranked.select(point, item).join(cut_lineage(ends), point))
    common = (cand.join(few.select(F.col(point).alias("a"), item), "a").join(few.select(F.col(point).alias("b"), item), ["b", item])
              .groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c")))
    return common.filter(F.col("c") / base >= share).select("a", "b").unionByName(same)


def connected_components(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """SET-6: smallest node id of each component by label propagation with pointer jumping; a table is written per round.

    The edges are computed once, for both directions, and only nodes with an edge go through the rounds. Ends of edges are nodes.
    """
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut_lineage(edges.select(F.explode(ways).alias("_e")).select("_e.*"))
    lab = cut_lineage(both.select(F.col("a").alias("id")).distinct().withColumn("l", F.col("id")))
    while True:  # pointer jumping: rounds grow with the logarithm of the longest path
        best = both.join(lab.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("l").alias("m"))
        nxt = lab.join(best.withColumnRenamed("a", "id"), "id", "left").select("id", "l", F.least("l", F.coalesce("m", "l")).alias("n"))
        jump = nxt.join(nxt.select(F.col("id").alias("n"), F.col("n").alias("r")), "n", "left").select(
            "id", "l", F.least("n", F.coalesce("r", "n")).alias("n"))
        step = cut_lineage(jump)
        if step.filter(F.col("l") != F.col("n")).isEmpty():
            found = step.select(F.col("id").alias(node), F.col("n").alias("family"))
            return nodes.select(node).join(found, node, "left").select(node, F.coalesce("family", node).alias("family"))
        lab = step.select("id", F.col("n").alias("l"))


def overlap_families(sets: DataFrame, point: str, item: str, share: float = 0.8) -> DataFrame:
    """SET-6: families of points that share at least ``share`` of each other's items."""
    return connected_components(sets.select(point).distinct(), overlap_pairs(sets, point, item, share), point)


def merge_keys(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """SET-7: union in which the new row overrides the old one."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def split_known(wanted: DataFrame, known: DataFrame, key: str, weight: str) -> DataFrame:
    """SET-7: how many wanted keys, and how much weight, the known table resolves."""
    j = wanted.join(known.select(key).distinct().withColumn("_k", F.lit(True)), key, "left")
    return j.groupBy(F.coalesce("_k", F.lit(False)).alias("known")).agg(F.count("*").alias("keys"), F.sum(weight).alias("weight"))


def fingerprint(df: DataFrame, cols: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """SET-8: order-insensitive content hash: row count and the sum of 32-bit row hashes."""
    from tidemark.functions.scalar import hash_u32
    h = hash_u32(*[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in cols])
    return df.groupBy(*group).agg(F.count("*").alias("n"), F.sum(h).alias("hash"))


def attribute_diff(diff: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """SET-9: first rule that explains each difference; what no rule explains is ``unexplained``."""
    why = F.lit("unexplained")
    for n, c in reversed(list(rules)):
        why = F.when(F.coalesce(c, F.lit(False)), F.lit(n)).otherwise(why)
    return diff.filter("status <> 'same'").groupBy(why.alias("why")).agg(F.count("*").alias("n"))


def seam_check(diff: DataFrame, day: str, first_day: int, allowed: Sequence[str], bound: int) -> DataFrame:
    """SET-10: on the first joined day only allowed fields may differ, in at most ``bound`` rows; later days must be identical."""
    d = diff.filter("status <> 'same'")
    stray = F.size(F.array_except("fields", F.array(*[F.lit(a) for a in allowed]))) > 0
    first, later = F.col(day) <= first_day, F.col(day) > first_day
    got = d.agg(F.count_if(first).alias("first_diffs"), F.count_if(first & (stray | (F.col("status") != "differ"))).alias("first_stray"),
                F.count_if(later).alias("later_diffs"))
    return got.withColumn("verdict", F.when((F.col("first_diffs") <= bound) & (F.col("first_stray") == 0) & (F.col("later_diffs") == 0), "PASS").otherwise("REFUSE"))


def clock_offset(a: DataFrame, b: DataFrame, keys: Sequence[str], max_diff: int, width: int) -> DataFrame:
    """SET-11: the same candle at another time: most frequent offset per time bucket, ties to the smaller.

    Candles that occur once on each side are matched; repeated ones cannot be told apart and are counted away.
    """
    once = lambda d, t: d.groupBy(*keys).agg(F.count("*").alias("_c"), F.min("ts").alias(t)).filter("_c = 1").drop("_c")
    j = once(a, "ta").join(once(b, "tb"), list(keys)).withColumn("offset", F.col("tb") - F.col("ta")).filter(F.abs("offset") <= max_diff)
    c = j.groupBy(F.floor(F.col("ta") / width).alias("b"), "offset").agg(F.count("*").alias("n"))
    best = F.min_by(F.struct("offset", "n"), F.struct((-F.col("n")).alias("x"), "offset"))
    return c.groupBy("b").agg(F.sum("n").alias("matched"), best.alias("_m")).select("b", "matched", F.col("_m.offset").alias("offset"), F.col("_m.n").alias("votes"))


def warmup_diff(op: Callable[[DataFrame], DataFrame], full: DataFrame, start: int, ts: str, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """SET-12: run an operator with the full history and with the history cut at ``start``; compare the rows after it."""
    a = op(full).filter(F.col(ts) >= start)
    b = op(full.filter(F.col(ts) >= start))
    return keyed_diff(a, b, keys, cols)


