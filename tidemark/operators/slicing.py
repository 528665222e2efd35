"""Building blocks that keep ordered work on one key spread over many tasks.

A key may hold a third of all rows, so nothing here windows over a whole key:

* ``running``      prefix aggregates: a window inside (key, slice) plus a carry from the earlier slices,
                   where the carry comes from one summary row per (key, slice).
* ``with_halo``    bounded look-back: each row is also copied into the later slices it can reach.
* ``ordered_fold`` rules that really are sequential: the rows are range-partitioned by (key, order), every
                   partition is folded from a guessed start state, and partitions whose guess was wrong are
                   folded again until all start states agree with the end state before them.
* ``rank_select``  exact order statistics of groups of any size.

Slices are intervals of the time axis. ``pick_slice_width`` measures the fullest slice and returns the widest
interval that keeps it below a row target.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalar import bucket, monotone_bucket
from tidemark.session import cut_lineage, keep_partitions

SLICE = "_slice"
LADDER = (30 * 86400, 5 * 86400, 86400, 6 * 3600, 3600, 600, 60, 10, 1)


def pick_slice_width(df: DataFrame, key: Sequence[str], ts: str, max_rows: int = 2_000_000) -> int:
    """Widest step of ``LADDER`` whose fullest (key, slice) stays below ``max_rows`` (one bounded job)."""
    steps = F.array(*[F.struct(F.lit(w).alias("w"), F.floor(F.col("_b") * LADDER[-2] / w).alias("at")) for w in LADDER[:-1]])
    fine = df.groupBy(*key, bucket(ts, LADDER[-2]).alias("_b")).count().select(*key, "count", F.explode(steps).alias("_s"))
    full = fine.groupBy(*key, "_s").agg(F.sum("count").alias("n")).groupBy(F.col("_s.w").alias("w")).agg(F.max("n").alias("n"))
    rows = full.collect()  # a row a step
    return int(max((r["w"] for r in rows if r["n"] <= max_rows), default=LADDER[-1] if rows else LADDER[0]))


_measured: dict[int, int] = {}
_layout = {"width": LADDER[1]}


def use_layout(df: DataFrame, key: Sequence[str], ts: str, max_rows: int = 2_000_000) -> int:
    """Measure a tape once and make its slice width that of all operators that are not given one.

    The same tape (by its plan) is measured once a session. Results never depend on the width, only the size of the largest task does.
    """
    plan = df.semanticHash()
    if plan not in _measured:
        _measured[plan] = pick_slice_width(df, key, ts, max_rows)
    _layout["width"] = _measured[plan]
    return _layout["width"]


def width_or_layout(width: int | None) -> int:
    return width or _layout["width"]


def _local(kind: str, x: Column) -> Column:
    return {
        "sum": lambda: F.sum(x), "count": lambda: F.count(x), "max": lambda: F.max(x), "min": lambda: F.min(x),
        "last": lambda: F.last(x, ignorenulls=True), "first": lambda: F.first(x, ignorenulls=True),
    }[kind]()


def _summary(kind: str, x: Column, order: Sequence[str]) -> Column:
    pos = F.when(x.isNotNull(), F.struct(*[F.col(c) for c in order]))
    if kind == "last":
        return F.max_by(x, pos)
    if kind == "first":
        return F.min_by(x, pos)
    return _local(kind, x)


def _merge(kind: str, carry: Column, local: Column) -> Column:
    if kind == "sum":
        return F.when(carry.isNull(), local).when(local.isNull(), carry).otherwise(carry + local)
    if kind == "count":
        return F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0))
    if kind == "max":
        return F.greatest(carry, local)
    if kind == "min":
        return F.least(carry, local)
    if kind == "last":
        return F.coalesce(local, carry)
    return F.coalesce(carry, local)


def running(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    aggs: dict[str, tuple[str, Column]],
    slice_col: Column,
    include_current: bool = True,
) -> DataFrame:
    """Prefix aggregates per key in ``order``, for keys of any size.

    ``aggs`` maps an output name to (kind, expression), kind one of sum, count, max, min, last, first; ``last``
    and ``first`` skip nulls. ``slice_col`` must not decrease along ``order``. Rows are shuffled once, by
    (key, slice); the join with the carry reuses that partitioning.
    """
    key, order = list(key), list(order)
    part = key + [SLICE]
    df = df.withColumn(SLICE, slice_col)
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0 if include_current else -1)
    local = df.select("*", *[_local(k, x).over(w).alias(f"_l_{n}") for n, (k, x) in aggs.items()])
    per_slice = df.groupBy(*part).agg(*[_summary(k, x, order).alias(f"_s_{n}") for n, (k, x) in aggs.items()])
    wc = Window.partitionBy(*key).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = per_slice.select(*part, *[
        _local("sum" if k == "count" else k, F.col(f"_s_{n}")).over(wc).alias(f"_c_{n}")
        for n, (k, _) in aggs.items()])
    out = local.join(carry, part, "left")
    keep = [c for c in df.columns if c != SLICE and c not in aggs]
    return out.select(*keep, *[
        _merge(k, F.col(f"_c_{n}"), F.col(f"_l_{n}")).alias(n) for n, (k, _) in aggs.items()])


def multiplied(df: DataFrame) -> DataFrame:
    """Rows that an explode has multiplied, about to be joined: shuffled, never broadcast.

    Spark takes their size for that of the rows before the explode, so it would send them through the driver however many they are.
    """
    return df.hint("merge")


def with_halo(df: DataFrame, ts: str, width: int, lookback: int) -> DataFrame:
    """Copy each row into every later slice it can reach within ``lookback``; ``_own`` marks the original.

    A window over (key, ``_slice``) then sees everything within the look-back of the rows with ``_own``.
    """
    first, last = bucket(ts, width), bucket(F.col(ts) + F.lit(lookback), width)
    return (df.withColumn(SLICE, F.explode(F.sequence(first, last)))
            .withColumn("_own", F.col(SLICE) == bucket(ts, width)))


def trailing(
    df: DataFrame,
    key: Sequence[str],
    ts: str,
    lookback: int,
    aggs: dict[str, Column],
    slice_width: int,
    lo_open: bool = True,
    include_now: bool = True,
) -> DataFrame:
    """Aggregates over the trailing time range of each row: (t - lookback, t], or [.. when not ``lo_open``."""
    width = max(width_or_layout(slice_width), lookback)
    w = Window.partitionBy(*key, SLICE).orderBy(ts).rangeBetween(
        -lookback + (1 if lo_open else 0), 0 if include_now else -1)
    wide = with_halo(df, ts, width, lookback)
    out = wide.select("*", *[a.over(w).alias(n) for n, a in aggs.items()])
    return out.filter("_own").drop(SLICE, "_own")


# ---------------------------------------------------------------------------------------------------------
# sequential rules

Kernel = Callable[[dict | None, pd.DataFrame], tuple[dict, dict[str, list]]]
ARROW = {"boolean": pa.bool_(), "string": pa.string(), "double": pa.float64(), "long": pa.int64(), "int": pa.int32()}


def ordered_fold(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    kernel: Kernel,
    out_fields: Sequence[tuple[str, str]],
    partitions: int | None = None,
    rows_per_partition: int = 2_000_000,
    cut: bool = False,
    reads: Sequence[str] | None = None,
) -> DataFrame:
    """Fold each key's rows in order with a small carried state, for keys of any size.

    ``kernel(state, rows)`` gets the state left by the rows before (None at the start of a key) and a block of
    consecutive rows of one key; it returns the new state (a small JSON-able dict) and the output columns.
    Blocks are cut at Arrow batch boundaries, so no key is ever held whole. Only the columns in ``reads`` (all by default) are turned
    into pandas, integers beside nulls as Python integers; every column of ``df`` itself is carried as it is, in Arrow.

    The rows are range-partitioned by (key, order) and written to the checkpoint folder, so a key larger than a
    partition runs over several. Only keys that cross a partition boundary need a start state: one pass folds the last key of
    every partition from a guess, and partitions whose guess was wrong are folded again, until every start
    state equals the end state before it. The driver sees one (first key, last key, state) row per partition.
    ``cut`` writes the input first; use it when the input is costly, as it is read three times (count, range
    sample, shuffle).
    """
    key, order, names = list(key), list(order), df.columns
    need = list(reads) if reads is not None else names
    if cut:
        df = cut_lineage(df)
    spark = df.sparkSession
    if partitions is None:
        partitions = max(spark.sparkContext.defaultParallelism, -(-df.count() // rows_per_partition))
    rows = keep_partitions(
        df.repartitionByRange(partitions, *key, *order).sortWithinPartitions(*key, *order)
        .withColumn("_pid", F.spark_partition_id()))

    def blocks(batch: pa.RecordBatch) -> tuple[int, list[tuple], list[int]]:
        """Partition, key of every row, and the cuts between keys."""
        keys = list(zip(*[batch.column(names.index(c)).to_pylist() for c in key], strict=True))
        return batch.column(len(names))[0].as_py(), keys, [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]

    def frame(batch: pa.RecordBatch) -> pd.DataFrame:
        return pa.Table.from_batches([batch]).select(need).to_pandas(integer_object_nulls=True)

    def enter(carry: list, at: tuple, pid: int, starts: dict[int, str]) -> None:
        """``carry`` holds [key, state] between batches; a partition's first key may go on from the partition before."""
        if not carry:
            carry[:] = [at, json.loads(starts[pid]) if pid in starts else None]
        elif carry[0] != at:
            carry[:] = [at, None]

    def ends(starts: dict[int, str]):
        """First and last key of a partition and the state after its last key; keys that end inside a batch are passed over."""
        def run(batches):
            carry, first, pid, kinds = [], None, None, None
            for batch in batches:
                if not batch.num_rows:
                    continue
                pid, keys, cuts = blocks(batch)
                if first is None:
                    first, kinds = keys[0], [batch.schema.field(names.index(c)).type for c in key]
                if len(cuts) > 2 and not carry:
                    carry[:] = [keys[0], None]  # no longer the first key
                enter(carry, keys[-1], pid, starts)
                carry[1], _ = kernel(carry[1], frame(batch.slice(cuts[-2])))
            if first is not None:
                ids = [pa.array([v], t) for side in (first, carry[0]) for v, t in zip(side, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([pid], pa.int32()), *ids, pa.array([json.dumps(carry[1])])],
                                                 ["_pid", *[f"{s}{i}" for s in "az" for i in range(len(key))], "end"])
        return run

    def measure(pids: list[int] | None):
        part = rows if pids is None else rows.filter(F.col("_pid").isin(pids))
        kinds = [T.StructField(f"{s}{i}", df.schema[c].dataType) for s in "az" for i, c in enumerate(key)]
        schema = T.StructType([T.StructField("_pid", T.IntegerType()), *kinds, T.StructField("end", T.StringType())])
        return sorted(part.mapInArrow(ends(dict(starts)), schema).collect(), key=lambda r: r["_pid"])

    starts: dict[int, str] = {}
    n = len(key)
    spans = measure(None)
    first, last = {r["_pid"]: tuple(r)[1:1 + n] for r in spans}, {r["_pid"]: tuple(r)[1 + n:1 + 2 * n] for r in spans}
    order_of = [r["_pid"] for r in spans]
    crossing = [(p, q) for p, q in zip(order_of, order_of[1:]) if last[p] == first[q]]
    end_of = {r["_pid"]: r["end"] for r in spans}
    while True:
        stale = [q for p, q in crossing if starts.get(q) != end_of[p]]
        if not stale:
            break
        starts.update({q: end_of[p] for p, q in crossing})
        # a new start only changes the end of a partition that the key fills entirely
        redo = [p for p, _ in crossing if p in stale and first[p] == last[p]]
        if redo:
            end_of.update({r["_pid"]: r["end"] for r in measure(redo)})

    out_schema = T.StructType(list(df.schema.fields) + [
        T.StructField(n, T._parse_datatype_string(t)) for n, t in out_fields])

    def emit(batches):
        carry: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            pid, keys, cuts = blocks(batch)
            pdf = frame(batch)
            parts: dict[str, list] = {name: [] for name, _ in out_fields}
            for a, b in zip(cuts, cuts[1:]):
                enter(carry, keys[a], pid, starts)
                carry[1], out = kernel(carry[1], pdf.iloc[a:b])
                for name in parts:
                    parts[name].extend(out[name])
            added = [pa.array(parts[name], ARROW[kind]) for name, kind in out_fields]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(names)], *added], [*names, *parts])

    return rows.mapInArrow(emit, out_schema)


# ---------------------------------------------------------------------------------------------------------
# order statistics

def _narrow(vals: DataFrame, parent: list[str], part: str, targets: DataFrame) -> DataFrame:
    """Targets (parent, n, _lo, _name, _pos) moved down to the ``part`` of the parent that holds their position; ``_lo`` counts what lies before it.

    Also gives ``_mn`` and ``_mx`` of the part.
    """
    hist = vals.groupBy(*parent, part).agg(F.sum("_c").alias("_c"), F.min("_x").alias("_mn"), F.max("_x").alias("_mx"))
    upto = Window.partitionBy(*parent).orderBy(part).rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.select(*parent, part, "_mn", "_mx", (F.sum("_c").over(upto) - F.col("_c")).alias("_before"), "_c")
    got = hist.join(targets, parent) if parent else hist.crossJoin(F.broadcast(targets))  # as many rows as ranks are asked for
    at = F.col("_lo") + F.col("_before")
    return got.filter((F.col("_pos") >= at) & (F.col("_pos") < at + F.col("_c"))).select(*parent, part, "n", at.alias("_lo"), "_name", "_pos", "_mn", "_mx")


PARTS = 1 << 14  # parts that the bucket of a rank is cut into before anything is ordered


def rank_select(df: DataFrame, group: Sequence[str], x: str, ranks: dict[str, Column]) -> DataFrame:
    """Exact elements of each group's ascending order; ``ranks`` maps names to 0-based positions in terms of ``n``.

    Equal values are counted before anything is shuffled by group. A histogram of order-preserving buckets (about 1 % wide) finds the
    bucket of each position, a second one of ``PARTS`` parts between the bucket's least and largest value finds the part, and only those parts are
    ordered: a price pegged within one percent is not one window. No group is collected.
    """
    group = list(group)
    vals = df.filter(F.col(x).isNotNull()).groupBy(*group, F.col(x).alias("_x")).agg(F.count("*").alias("_c"))
    vals = vals.withColumn("_b", monotone_bucket(F.col("_x").cast("double")))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), r.cast("long").alias("pos")) for name, r in ranks.items()])
    sizes = vals.groupBy(*group).agg(F.sum("_c").alias("n")).withColumn("_t", F.explode(wanted))
    targets = sizes.select(*group, "n", F.lit(0).cast("long").alias("_lo"), F.col("_t.name").alias("_name"), F.col("_t.pos").alias("_pos"))
    first = _narrow(vals, group, "_b", targets)
    bounds = first.select(*group, "_b", "_mn", "_mx").distinct()  # at most as many as ranks a group
    span = F.col("_mx").cast("double") - F.col("_mn").cast("double")
    part = F.when(span > 0, F.floor((F.col("_x").cast("double") - F.col("_mn").cast("double")) / span * (PARTS - 1))).otherwise(0).cast("int")
    inside = vals.join(bounds, [*group, "_b"]).withColumn("_p", part).drop("_mn", "_mx")
    second = _narrow(inside, [*group, "_b"], "_p", first.drop("_mn", "_mx")).drop("_mn", "_mx")
    want = second.groupBy(*group, "_b", "_p", "n", "_lo").agg(F.collect_list(F.struct("_name", "_pos")).alias("_want"))  # at most len(ranks) entries
    cum = Window.partitionBy(*group, "_b", "_p").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    found = (inside.join(want, [*group, "_b", "_p"])
             .withColumn("_end", F.col("_lo") + F.sum("_c").over(cum))
             .withColumn("_w", F.explode("_want"))
             .filter((F.col("_w._pos") < F.col("_end")) & (F.col("_w._pos") >= F.col("_end") - F.col("_c"))))
    picks = [F.max(F.when(F.col("_w._name") == name, F.col("_x"))).alias(name) for name in ranks]
    if not group:
        return found.agg(F.max("n").alias("n"), *picks)
    return found.groupBy(*group).agg(F.max("n").alias("n"), *picks)


def quantiles_linear(df: DataFrame, group: Sequence[str], x: str, ps: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles (numpy's default) of groups of any size, with the count ``n``."""
    ranks: dict[str, Column] = {}
    for name, p in ps.items():
        pos = F.lit(p) * (F.col("n") - 1)
        ranks[f"{name}__lo"] = F.floor(pos)
        ranks[f"{name}__hi"] = F.ceil(pos)
    got = rank_select(df, group, x, ranks)
    cols = []
    for name, p in ps.items():
        pos = F.lit(p) * (F.col("n") - 1)
        lo, hi = F.col(f"{name}__lo"), F.col(f"{name}__hi")
        cols.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return got.select(*group, "n", *cols)


def upper_median(df: DataFrame, group: Sequence[str], x: str, name: str = "median") -> DataFrame:
    """Element floor(n / 2) of the ascending order, i.e. the upper of the middle two."""
    return rank_select(df, group, x, {name: F.floor(F.col("n") / 2)})


def last_n(
    df: DataFrame, key: Sequence[str], order: Sequence[str], value: Column, n: int, slice_col: Column, name: str,
) -> DataFrame:
    """Per row, the last ``n`` non-null values up to and including it, as an array in order.

    Values are numbered by a sliced running count; each is sent to the ``n`` positions that can see it, so the
    amplification is ``n`` and no key is collected.
    """
    key, order = list(key), list(order)
    numbered = running(df.withColumn("_v", value), key, order, {"_rk": ("count", F.col("_v"))}, slice_col)
    sent = (numbered.filter(F.col("_v").isNotNull())
            .select(*key, F.col("_rk").alias("_at"), F.col("_v"),
                    F.explode(F.sequence(F.col("_rk"), F.col("_rk") + F.lit(n - 1))).alias("_rk")))
    arrays = sent.groupBy(*key, "_rk").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_at", "_v"))), lambda s: s["_v"]).alias(name))
    return numbered.join(arrays, [*key, "_rk"], "left").drop("_rk", "_v")
