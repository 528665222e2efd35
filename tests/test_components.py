"""Components go through their rounds without the nodes that have no edge."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import compare as C


def test_only_nodes_with_edges_are_relabelled(spark, monkeypatch):
    sizes, cut = [], C.cut_lineage
    monkeypatch.setattr(C, "cut_lineage", lambda df: (sizes.append((out := cut(df)).count()), out)[1])
    edges = spark.createDataFrame([(7, 3), (7, 9), (500, 501)], "a long, b long")
    got = {r["p"]: r["family"] for r in C.connected_components(spark.range(1000).select(F.col("id").alias("p")), edges, "p").collect()}
    assert got == {i: i for i in range(1000)} | {7: 3, 9: 3, 501: 500}
    assert max(sizes) == 6
