"""Pairs of overlapping sets: rows shuffled stay few where many sets share an item and hardly any overlap."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import compare as C


def shuffled(spark):
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_rows_shuffled(spark):
    h = lambda *x: F.pmod(F.xxhash64(*x), F.lit(700))
    sets = spark.range(35_000).select((F.col("id") % 5000).alias("p"), h("id").alias("i")).unionByName(
        spark.range(7).select(F.lit(9999).cast("long").alias("p"), h(F.col("id") * 5000 + 17).alias("i")))  # a copy of 17
    before, rows = shuffled(spark), sets.count()
    pairs = [tuple(r) for r in C.overlap_pairs(sets, "p", "i", 0.8).collect()]
    assert (17, 9999) in pairs
    assert shuffled(spark) - before < 4 * rows
