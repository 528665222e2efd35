"""Parameter grids (GRD). A grid is a small table: its size is set by the dials, not by the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import hash_u32


def cell_grid(spark: SparkSession, dials: dict[str, Sequence], label: str = "cell") -> DataFrame:
    """GRD-1: every combination of the dial levels with a label, generated by exploding one array per dial."""
    out = spark.range(1).select()
    for name, levels in dials.items():
        out = out.select("*", F.explode(F.array(*[F.lit(v) for v in levels])).alias(name))
    return out.withColumn(label, F.concat_ws("|", *[F.concat(F.lit(f"{n}="), F.col(n).cast("string")) for n in dials]))


def stack_grids(*grids: DataFrame) -> DataFrame:
    """GRD-1: stacked lists; a later cell with the settings of an earlier one is flagged as a re-read."""
    out = None
    for i, g in enumerate(grids):
        one = g.withColumn("list", F.lit(i))
        out = one if out is None else out.unionByName(one)
    first = out.groupBy("cell").agg(F.min("list").alias("_f"))
    return out.join(first, "cell").withColumn("reread", F.col("list") > F.col("_f")).drop("_f")


def unmeasured_cells(legal: DataFrame, measured: DataFrame, ledger: DataFrame, thin: DataFrame, dials: Sequence[str]) -> DataFrame:
    """GRD-3: legal cells with the reason each is skipped for: measured, in the ledger, or using a thin level; null = open.

    ``thin``: (dial, level) pairs with too few trades.
    """
    mark = lambda d, n: d.select("cell").distinct().withColumn(n, F.lit(True))
    out = legal.join(mark(measured, "_m"), "cell", "left").join(mark(ledger, "_l"), "cell", "left")
    levels = out.select("cell", F.explode(F.array(*[F.struct(F.lit(d).alias("dial"), F.col(d).cast("string").alias("level")) for d in dials])).alias("e")).select(
        "cell", "e.dial", "e.level")
    bad = levels.join(thin, ["dial", "level"], "left_semi").select("cell").distinct().withColumn("_t", F.lit(True))
    out = out.join(bad, "cell", "left")
    return out.withColumn("skip", F.when(F.col("_m"), "measured").when(F.col("_l"), "ledger").when(F.col("_t"), "thin level")).drop("_m", "_l", "_t")


def random_arm(cands: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """GRD-4: uniform sample of the open cells by hash order."""
    return cands.withColumn("_h", hash_u32(seed, F.col(key))).orderBy("_h", key).limit(n).drop("_h")
