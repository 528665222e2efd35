"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree over word blocks.

Every source is a stream of words: its documents in hash order, one after another. The stream is cut into blocks of equal length, and
the blocks into passes (a source may be used up to ``cap`` times). The number of blocks a source gives is fixed by its target; a binary
tree over the output shards then splits those numbers exactly: at each node the left half gets a multivariate-hypergeometric draw. A
shard takes its next run of the source's permuted blocks, so blocks are disjoint within a pass, and orders its pieces by hash.

Defined results: null text has size 0; size 0 is never drawn; a null source is a source of its own, last in order; equal rows are
separate documents; an empty table gives no rows. Columns other than doc_id, text and source are carried along.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tidemark.llm.common import WORD, n_words, query, shielded, table
from tidemark.session import cut_lineage

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
SHARDS = 16
BLOCK = 256
MIN_BLOCKS = 64
SLICE_ROWS = 4096
SEED = 11


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per source with its target: weights cycle over the sources by code point (null last); what lies above ``cap`` times a
    source is dealt again by weight until nothing is. That is min(cap * size, level * weight) for one level, found from prefix sums.

    ``sizes``: (source, source_size), one row per source, so the windows here hold one row per source.
    """
    order = W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("_i", F.row_number().over(order) - 1)
    s = s.withColumn("weight", F.element_at(cycle, (F.col("_i") % len(weights) + 1).cast("int")))
    s = s.withColumn("_cap", cap * F.col("source_size")).withColumn("_r", F.col("_cap") / F.col("weight"))
    up = W.partitionBy(F.lit(0)).orderBy("_r", "_i")
    before = up.rowsBetween(W.unboundedPreceding, -1)
    onward = up.rowsBetween(0, W.unboundedFollowing)
    whole = W.partitionBy(F.lit(0))
    s = s.withColumn("_level", (share * F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
                     / F.sum("weight").over(onward))
    s = s.withColumn("_level", F.first(F.when(F.col("_level") <= F.col("_r"), F.col("_level")), True).over(
        up.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    level = F.coalesce(F.col("_level") * F.col("weight"), F.col("_cap"))
    return s.select("source", "source_size", "weight", F.least("_cap", level).alias("target"))


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Exact quotas (sources x shards) by a splitting tree; rows sum to ``quotas`` and shard totals differ by one at most."""
    rng = np.random.default_rng(seed)
    out = np.zeros((len(quotas), shards), dtype=np.int64)

    def total(lo: int, hi: int) -> int:
        whole = int(quotas.sum())
        return whole * hi // shards - whole * lo // shards

    todo = [(0, shards, quotas.astype(np.int64))]
    while todo:
        lo, hi, have = todo.pop()
        if hi - lo == 1:
            out[:, lo] = have
            continue
        mid = (lo + hi) // 2
        want, left = total(lo, mid), np.zeros_like(have)
        rest = int(have.sum())
        for i, n in enumerate(have):  # marginals of the multivariate draw, source by source
            rest -= int(n)
            left[i] = _hypergeometric(rng, int(n), rest, want) if want else 0
            want -= int(left[i])
        todo += [(mid, hi, have - left), (lo, mid, left)]
    return out


EXACT = 10**9  # numpy's own sampler goes so far


def _log_step(z: int, d: int) -> float:
    """log((z + d)! / z!) - d * log(z) for large z, without the cancellation of two large logarithms."""
    x = d / z
    rest = lambda v: 1 / (12 * v) - 1 / (360 * v ** 3)
    return (z + d + 0.5) * (math.log1p(x) - x) + d * x + 0.5 * x + (rest(z + d) - rest(z)) if abs(x) < 0.5 else (
        math.lgamma(z + d + 1) - math.lgamma(z + 1) - d * math.log(z))


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """Marked items among ``sample`` drawn without replacement. Beyond numpy's range: the ratio of uniforms under the same distribution.

    The density's ratio to that of its mode is taken from steps of factorials around the mode in Python integers, so it keeps its
    precision at any size.
    """
    lo, hi = max(sample - bad, 0), min(good, sample)
    if max(good, bad) < EXACT or lo == hi:
        return int(rng.hypergeometric(good, bad, sample)) if max(good, bad) < EXACT else lo
    n = good + bad
    mode = (sample + 1) * (good + 1) // (n + 2)
    sides = (mode, good - mode, sample - mode, bad - sample + mode)
    if min(sides) < 1000:  # a narrow draw: item by item from the end that has few steps
        return _by_inversion(rng, good, bad, sample, lo, hi)
    log_ratio = math.log1p((sides[1] * sides[2] - sides[0] * sides[3]) / (sides[0] * sides[3]))

    def height(d: int) -> float:
        """log of the density at mode + d over that at the mode."""
        return d * log_ratio - _log_step(sides[0], d) - _log_step(sides[3], d) - _log_step(sides[1], -d) - _log_step(sides[2], -d)

    sd = math.sqrt(sample * (good / n) * (bad / n) * ((n - sample) / (n - 1)) + 0.5)
    half = 2 * math.sqrt(2 / math.e) * sd / 2 + 1.5  # covers sqrt(density) * distance of a bell of this width
    while True:
        u, v = 1 - rng.random(), (2 * rng.random() - 1) * half * 1.1
        d = math.floor(v / u + 0.5)
        if lo <= mode + d <= hi and 2 * math.log(u) <= height(d):
            return mode + d


def _by_inversion(rng: np.random.Generator, good: int, bad: int, sample: int, lo: int, hi: int) -> int:
    """Inversion from the end of the support that lies nearer to the mode; the ratio of neighbours is a ratio of integers."""
    if 2 * ((sample + 1) * (good + 1) // (good + bad + 2) - lo) > hi - lo:
        return sample - _by_inversion(rng, bad, good, sample, sample - hi, sample - lo)
    logs, x, total = [0.0], lo, 0.0
    while x < hi and logs[-1] > max(logs) - 60:
        logs.append(logs[-1] + math.log((good - x) * (sample - x)) - math.log((x + 1) * (bad - sample + x + 1)))
        x += 1
    weights = np.exp(np.array(logs) - max(logs))
    total = weights.sum()
    return lo + int(np.searchsorted(np.cumsum(weights), rng.random() * total, side="right"))


def _plan(spark, targets: DataFrame, shards: int, block: int, min_blocks: int, seed: int) -> DataFrame:
    """Per source: block length, blocks, blocks drawn, the affine permutation of its blocks and its shard bounds.

    The quotas table (one row per source) is the only thing that passes the driver.
    """
    rows = targets.orderBy(F.col("source").asc_nulls_last()).collect()
    plan, quotas = [], []
    for r in rows:
        size = int(r["source_size"])
        length = max(1, min(block, -(-size // min_blocks)))
        n = -(-size // length) if size else 0
        passes = int(r["target"] // size) if size else 0
        rest = (r["target"] - passes * size) if size else 0.0
        quotas.append(passes * n + min(n, round(rest / length)))
        plan.append((r["source"], size, float(r["target"]), length, n))
    split = split_quotas(np.array(quotas, dtype=np.int64), shards, seed) if rows else np.zeros((0, shards), dtype=np.int64)
    rng = np.random.default_rng(seed + 1)
    out = []
    for (source, size, target, length, n), q, cuts in zip(plan, quotas, np.cumsum(split, axis=1), strict=True):
        a = 1
        if n > 2:
            most = min(n, 2**26)  # a * block stays a long for any corpus
            a = int(rng.integers(max(1, most // 3), most))
            while math.gcd(a, n) > 1:
                a = a % (most - 1) + 1
        out.append(("" if source is None else f"s{source}", size, target, length, n, int(q), a, int(rng.integers(0, max(n, 1))), [int(c) for c in cuts]))
    schema = "_k string, source_size long, target double, _len long, _n long, _q long, _a long, _b long, _cuts array<long>"
    return spark.createDataFrame(out, T._parse_datatype_string(schema))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, shards: int = SHARDS, block: int = BLOCK,
        min_blocks: int = MIN_BLOCKS, slice_rows: int = SLICE_ROWS, seed: int = SEED) -> DataFrame:
    """``docs`` with size, source_size, target and pieces: array of (pass, shard, start, length, place), in words of the document.

    ``place`` orders the pieces of a shard. Columns of ``docs`` that clash with these five are replaced. The shuffle key is
    (source, slice of the hash): a slice holds about ``slice_rows`` documents however large the source is.
    """
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c not in ("size", "source_size", "target", "pieces")]
    base = docs.select(*keep, n_words(F.col("text")).alias("size"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")).alias("_k"),
                       F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"), F.col("source")).alias("_h"))
    total = docs.count()
    bits = max(0, math.ceil(math.log2(max(1, total / slice_rows))))
    side = F.expr(f"shiftrightunsigned(_h, {64 - bits})") if bits else F.lit(0).cast("long")
    per = cut_lineage(base.groupBy("_k", "source", side.alias("_s")).agg(F.sum("size").alias("w")))
    slices = per.select("_k", "_s", "w")
    before = W.partitionBy("_k").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    carry = slices.select("_k", "_s", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("_before"))
    targets = cut_lineage(source_targets(per.groupBy("source").agg(F.sum("w").alias("source_size")), weights, share, cap))
    plan = _plan(spark, targets, shards, block, min_blocks, seed)

    within = W.partitionBy("_k", "_s").orderBy(F.col("_h") < 0, "_h").rowsBetween(W.unboundedPreceding, -1)
    rows = base.withColumn("_s", side)
    rows = rows.withColumn("_p", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(carry, ["_k", "_s"], "left")
    rows = rows.join(F.broadcast(plan), "_k", "left").withColumn("_p", F.col("_p") + F.col("_before"))
    # blocks this document overlaps, in each pass; rank of the block in the pass's order; drawn if below the quota
    first, last = F.expr("_p div _len"), F.expr("(_p + size - 1) div _len")
    passes = F.greatest(F.expr("(_q + _n - 1) div _n"), F.lit(1))
    cells = F.when((F.col("size") > 0) & (F.col("_q") > 0), F.flatten(F.transform(
        F.sequence(F.lit(0).cast("long"), passes - 1),
        lambda e: F.transform(F.sequence(first, last), lambda b: F.struct(
            e.alias("pass"), b.alias("b"), (e * F.col("_n") + F.pmod(F.col("_a") * b + F.col("_b") + e * 7919, F.col("_n"))).alias("r"))))))
    drawn = F.filter(F.coalesce(cells, F.array().cast("array<struct<pass:long,b:long,r:long>>")), lambda c: c["r"] < F.col("_q"))
    start = lambda c: F.greatest(c["b"] * F.col("_len") - F.col("_p"), F.lit(0))
    end = lambda c: F.least((c["b"] + 1) * F.col("_len") - F.col("_p"), F.col("size"))
    pieces = F.transform(drawn, lambda c: F.struct(
        c["pass"].alias("pass"), F.size(F.filter("_cuts", lambda x: x <= c["r"])).alias("shard"),
        start(c).alias("start"), (end(c) - start(c)).alias("length"), F.xxhash64(F.lit(seed), F.col("_h"), c["r"]).alias("place")))
    return rows.select(*keep, "size", "source_size", "target", pieces.alias("pieces"))


def _cut_text(names: list[str]):
    """Arrow rows (.., text, size, pieces) to a row per pass and shard with the text of its pieces; neighbours run on, gaps become a line break.

    A text's words are found once, however many pieces it has; the other columns stay in Arrow and are repeated as they are.
    """
    def cut(text: str, size: int, pieces: list[dict]):
        homes: dict[tuple, list[dict]] = {}
        for p in pieces:
            homes.setdefault((p["pass"], p["shard"]), []).append(p)
        at = None
        for (_, shard), some in homes.items():
            if sum(p["length"] for p in some) == size:
                yield shard, some[0]["place"], text
                continue
            at = at or [m.span() for m in re.finditer(WORD, text)]
            runs: list[list[int]] = []
            for p in sorted(some, key=lambda p: p["start"]):
                if runs and runs[-1][1] == p["start"]:
                    runs[-1][1] += p["length"]
                else:
                    runs.append([p["start"], p["start"] + p["length"]])
            yield shard, some[0]["place"], "\n".join(text[at[a][0]:at[b - 1][1]] for a, b in runs)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                columns = dict(zip(part.schema.names, part.columns, strict=True))
                rows = [(i, *x) for i, r in enumerate(zip(*[columns[c].to_pylist() for c in ("text", "size", "pieces")], strict=True)) for x in cut(*r)]
                take = pa.array([r[0] for r in rows], pa.int64())
                made = {"_shard": pa.array([r[1] for r in rows], pa.int32()), "_place": pa.array([r[2] for r in rows], pa.int64()), "text": pa.array([r[3] for r in rows], pa.string())}
                if "n_chars" in names:
                    made["n_chars"] = pa.array([len(r[3]) for r in rows], columns["n_chars"].type)
                yield pa.RecordBatch.from_arrays([made[c] if c in made else columns[c].take(take) for c in names], names)
    return run


def mixed_documents(docs: DataFrame, **kwargs) -> DataFrame:
    """The mix as documents: a row per document, pass and shard with the words drawn, placed by shard and shuffled inside it.

    Every piece stays in the shard whose quota it fills, so the words of each shard follow ``split_quotas``.
    """
    return shielded(docs, lambda d: by_shard(d, **kwargs).select(*d.columns))


def by_shard(docs: DataFrame, **kwargs) -> DataFrame:
    """``mixed_documents`` with ``_shard`` and ``_place``; ``docs`` has document columns only."""
    columns = docs.columns
    rows = mix(docs, **kwargs).filter(F.size("pieces") > 0).select(*columns, "size", "pieces")
    names = [*columns, "_shard", "_place"]
    schema = T.StructType([*docs.schema.fields, T.StructField("_shard", T.IntegerType()), T.StructField("_place", T.LongType())])
    cut = rows.mapInArrow(_cut_text(names), schema)
    return cut.repartition("_shard", F.pmod("_place", F.lit(64))).sortWithinPartitions("_shard", "_place")


@query("op10_mixing")
def op10_mixing(spark, sf_dir):
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["length"])
    return out.select("doc_id", "size", "source_size", "target", taken.alias("taken"))
