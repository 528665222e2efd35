"""What a sequential rule on a stream gets: plain lists in order, gaps last; no frame is made for a key."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tidemark.streaming import tape_stream as X


def test_rules_get_lists_in_order(spark, tmp_path):
    rows = [("a", 50, 3, 7.0), ("a", 10, 2, 5.0), ("a", 10, 1, None), ("b", 20, 4, 1.0), ("a", 90_000, 9, 1.0)]
    df = spark.createDataFrame(rows, "tok string, ts long, blk long, px double").withColumn("event_time", F.timestamp_seconds("ts"))
    df.coalesce(1).write.parquet(f"{tmp_path}/t")

    def step(held, rows):
        assert all(type(v) is list for v in rows.values())
        return {}, pd.DataFrame({"blk": rows["blk"], "n": [len(rows["px"])] * len(rows["blk"])})

    by_px = X.in_event_time(X.stream_tape(spark, f"{tmp_path}/t", df.schema), ["tok"], "blk long, n long", step, ("px",), order=("px", "blk"))
    assert {(r["blk"], r["n"]) for r in X.run_available(by_px).collect()} == {(1, 3), (2, 3), (3, 3), (4, 1)}
