"""Rows that an explode has multiplied do not go through the driver."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import costs, ranges


def broadcast_explodes(df) -> list[str]:
    """Lines of the plan that explode rows below a broadcast."""
    lines, out, at = df._jdf.queryExecution().executedPlan().toString().split("\n"), [], None
    for line in lines:
        depth = len(line) - len(line.lstrip(" :+-*()0123456789"))
        if at is not None and depth <= at:
            at = None
        if at is not None and "Generate" in line:
            out.append(line)
        if "BroadcastExchange" in line and at is None:
            at = depth
    return out


def prints(spark):
    return spark.range(500).select((F.col("id") * 700).alias("ts"), F.col("id").alias("blk"), F.lit(0).alias("li"), (F.col("id") % 5).alias("tok"),
                                   (F.col("id") % 3).cast("string").alias("pool"), (F.col("id") % 17 + 1.0).alias("px"), F.lit(10.0).alias("usd"))


def test_ranges_shuffle_their_units(spark, tmp_path):
    prints(spark).write.parquet(f"{tmp_path}/p")
    p = spark.read.parquet(f"{tmp_path}/p")
    pos = p.select("tok", F.col("blk").alias("id"), (F.col("ts") + 1).alias("lo"), (F.col("ts") + 86400).alias("hi"), (F.col("px") * 1.5).alias("line"))
    assert broadcast_explodes(ranges.first_crossing(pos, p, ["tok"], ["id"], F.col("px"), "line", fine=3600, coarse=14400)) == []
    assert broadcast_explodes(ranges.range_extreme(pos, p, ["tok"], ["id"], F.col("px"), fine=3600, coarse=14400)) == []


def test_route_moments_are_shuffled(spark, tmp_path):
    prints(spark).write.parquet(f"{tmp_path}/p")
    spark.range(5).select(F.col("id").alias("tok")).write.parquet(f"{tmp_path}/t")
    p, tokens = spark.read.parquet(f"{tmp_path}/p"), spark.read.parquet(f"{tmp_path}/t")
    out = costs.static_route_medians(tokens, p, 3600, 0, 86400, F.lit(0.003), "usd", 0.05, 7200)
    assert "strategy=merge" in out._jdf.queryExecution().optimizedPlan().toString()  # the join of the moments with the pools alive
