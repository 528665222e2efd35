"""Streams over several triggers equal the batch operators."""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.operators import clean as C
from tidemark.plans.standins import tape
from tidemark.session import ensure_checkpoint_dir
from tidemark.streaming import tape_stream as X


DELAY = "12 days"


@pytest.fixture(scope="module")
def days(spark, sf):
    """The tape as several files out of order, read one per trigger: every third row comes one file late."""
    path = f"{ensure_checkpoint_dir(spark)}/days-{uuid.uuid4().hex}"
    t = tape(spark, sf).withColumn("event_time", F.timestamp_seconds("ts"))
    file = F.least(F.floor(F.col("blk") / 250) + (F.col("blk") % 3 == 0).cast("int"), F.lit(4))
    for i in range(5):
        t.filter(file == i).orderBy(F.hash("blk")).coalesce(1).write.mode("append").parquet(path)
    return path, t


@pytest.fixture(scope="module")
def due(days):
    """Rows that the watermark has passed at the end."""
    top = days[1].agg(F.max("ts").alias("t")).first()["t"]
    return days[1].filter(F.col("ts") < top - 12 * 86400)


def stream(spark, days):
    path, t = days
    return X.stream_tape(spark, path, t.schema, files_per_trigger=1)


def same(got, want):
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_guard_stream_equals_batch(spark, days, due):
    got = X.run_available(X.stream_guard(stream(spark, days), ["tok"], 6.0, delay=DELAY))
    same(got, C.bad_print_guard(days[1], ["tok"], band=6.0).join(due, "blk", "left_semi").select("blk", "accepted"))


def test_dip_and_order_equal_one_file(spark, days, due):
    """The same rows in one file in order give the same signals; every key's rows come out numbered by time."""
    path = f"{ensure_checkpoint_dir(spark)}/one-{uuid.uuid4().hex}"
    days[1].orderBy("blk").coalesce(1).write.parquet(path)
    one = X.stream_tape(spark, path, days[1].schema)
    rule = lambda s: X.stream_dip_signal(s, ["tok"], 0.3, 21600, 20, 86400, delay=DELAY)
    got = X.run_available(rule(stream(spark, days)))
    same(got, X.run_available(rule(one)))
    assert got.count() > 0
    rows = X.run_available(X.ordered_tape(stream(spark, days), ["tok"], DELAY)).join(due.select("blk", "tok"), "blk").collect()
    assert len(rows) == due.count()
    by = {}
    for r in rows:
        by.setdefault(r["tok"], []).append((r["seq"], r["ts"], r["blk"]))
    assert all([x[0] for x in sorted(v)] == list(range(len(v))) and [x[1:] for x in sorted(v)] == sorted(x[1:] for x in v) for v in by.values())


def test_enrichment_waits_for_late_references(spark, days, due):
    from tidemark.operators import joins as J
    s = stream(spark, days).withColumn("is_ref", F.col("pool") == "click")
    got = X.run_available(X.stream_asof_enrich(s, ["tok"], "is_ref", delay=DELAY))
    ref = days[1].filter("pool = 'click'")
    want = J.asof_backward(due.filter("pool <> 'click'"), ref, ["tok"], "r", tie=("blk",), columns=("ts", "px"))
    same(got, want.select("blk", F.col("r.px").alias("ref_px")))


def test_rows_behind_the_watermark_are_counted(spark, days):
    """With no delay to speak of, rows three files late are dropped and counted, or marked; what comes out stays in order."""
    path = f"{ensure_checkpoint_dir(spark)}/late-{uuid.uuid4().hex}"
    file = F.floor(F.col("blk") / 250) + F.when(F.col("blk") % 5 == 0, 3).otherwise(0)
    for i in range(8):
        days[1].filter(file == i).coalesce(1).write.mode("append").parquet(path)
    out, dropped = X.run_counted(X.ordered_tape(X.stream_tape(spark, path, days[1].schema, files_per_trigger=1), ["tok"], "1 second"))
    rows = out.collect()
    late = [r for r in rows if r["seq"] is None]
    last = days[1].groupBy("tok").count().count()  # the watermark stays behind the last rows
    assert len(late) + dropped > 0 and days[1].count() - last <= len(rows) + dropped <= days[1].count() and len({r["blk"] for r in rows}) == len(rows)
    tok, by = {r["blk"]: r["tok"] for r in days[1].collect()}, {}
    for r in sorted((r for r in rows if r["seq"] is not None), key=lambda r: r["seq"]):
        by.setdefault(tok[r["blk"]], []).append((r["ts"], r["blk"]))
    assert all(v == sorted(v) for v in by.values())
    _, none = X.run_counted(X.ordered_tape(stream(spark, days), ["tok"], "400 days"))
    assert none == 0


def test_late_rows_are_seen_per_trigger(spark, days):
    rows = sorted(X.late_audit(stream(spark, days).select("blk", "ts"), 0).collect(), key=lambda r: r["trigger"])
    assert len(rows) == 5 and sum(r["rows"] for r in rows) == days[1].count() and rows[0]["behind"] == 0
    assert all(r["behind"] > 0 and r["lateness"] > 0 for r in rows[1:]) and [r["max_ts"] for r in rows] == sorted(r["max_ts"] for r in rows)


def test_late_audit_over_many_triggers(spark, con, tmp_path):
    """More triggers than Spark keeps progress entries for, every seventh late: equal to SQL's running maximum."""
    path = str(tmp_path)
    ts = [i - (40 + i % 11 if i % 7 == 3 else 0) for i in range(103)]
    for i, t in enumerate(ts):
        pq.write_table(pa.table({"ts": pa.array([t], pa.int64())}), f"{path}/part-{i:04d}.parquet")
        os.utime(f"{path}/part-{i:04d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    rows = X.late_audit(X.stream_tape(spark, path, "ts long", files_per_trigger=1), 90).collect()
    got = (sum(r["rows"] for r in rows), sum(r["past_cut"] for r in rows), sum(r["behind"] for r in rows), max(r["lateness"] for r in rows))
    values = ", ".join(f"({i}, {t})" for i, t in enumerate(ts))
    want = con.execute(f"""SELECT count(*), count(*) FILTER (ts >= 90), count(*) FILTER (ts < m), max(greatest(m - ts, 0)) FROM (
      SELECT ts, max(ts) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM (VALUES {values}) v(i, ts))""").fetchone()
    assert len(rows) == 103 and got == want and got[2] > 10
