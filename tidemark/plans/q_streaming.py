"""Streaming queries: the events file read as a stream, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalar import DAY, epoch_s
from tidemark.plans.q_clean import BAND, guard_sql
from tidemark.plans.registry import query
from tidemark.plans.standins import TAPE, ctes, table
from tidemark.streaming import tape_stream as X

D = DAY
T0 = 1704067200


def stape(spark, sf):
    schema = table(spark, sf, "events").schema
    e = X.stream_tape(spark, sf, schema, pattern="events.parquet")
    return e.select(
        F.col("ts").cast("timestamp").alias("event_time"), epoch_s("ts").alias("ts"), F.col("event_id").alias("blk"), F.lit(0).alias("li"),
        F.col("user_id").alias("tok"), F.col("event_type").alias("pool"), F.col("value").alias("px"),
        F.get_json_object("props", "$.k").cast("double").alias("usd"))


WM = "wm AS (SELECT epoch_us(max(ts)) // 1000 * 1000 - 7200000000 AS us FROM events)"


@query("src_13_stream_tape", ctes(TAPE) + "SELECT blk, ts, tok, pool, px, usd FROM tape")
def _(spark, sf):
    return X.run_available(stape(spark, sf).select("blk", "ts", "tok", "pool", "px", "usd"))


#: Rows that the watermark has passed when the stream has read all there is.
DUE = "due AS (SELECT event_id AS blk FROM events WHERE epoch_us(ts) < (SELECT us FROM wm))"


@query("str_01_watermarked_tape", ctes(TAPE, WM, DUE) + """
SELECT blk, ts, row_number() OVER (PARTITION BY tok ORDER BY ts, blk) - 1 AS seq FROM tape WHERE blk IN (SELECT blk FROM due)""")
def _(spark, sf):
    return X.run_available(X.ordered_tape(stape(spark, sf), ["tok"]))


@query("str_02_stream_dedupe", ctes(TAPE) + "SELECT blk, li, px FROM tape")
def _(spark, sf):
    a = stape(spark, sf)
    both = a.unionByName(stape(spark, sf).filter("usd > 30"))
    return X.run_available(X.stream_dedupe(X.watermarked_tape(both))).select("blk", "li", "px")


@query("str_03_stream_candles", ctes(TAPE, WM, "w AS (SELECT t.*, (ts // 21600) * 21600 AS s FROM tape t)") + """
SELECT tok, s AS start, arg_min(px, blk) AS open, max(px) AS high, min(px) AS low, arg_max(px, blk) AS close, sum(usd) AS vol, count(*) AS n
FROM w WHERE (s + 21600) * 1000000 <= (SELECT us FROM wm) GROUP BY tok, s""")
def _(spark, sf):
    out = X.run_available(X.stream_candles(X.watermarked_tape(stape(spark, sf)), ["tok"], "6 hours"))
    return out.select("tok", F.unix_seconds("window.start").alias("start"), "open", "high", "low", "close", "vol", "n")


@query("str_04_stream_activity", ctes(TAPE, WM, f"""w AS (SELECT tok, (ts // {D}) * {D} - k * {D} AS s FROM tape, range(3) r(k) WHERE usd >= 10)""") + f"""
SELECT tok, s AS start, count(*) AS n FROM w WHERE (s + {3 * D}) * 1000000 <= (SELECT us FROM wm) GROUP BY tok, s""")
def _(spark, sf):
    out = X.run_available(X.stream_activity(X.watermarked_tape(stape(spark, sf)), ["tok"], "3 days", "1 day", 10))
    return out.select("tok", F.unix_seconds("window.start").alias("start"), "n")


@query("str_05_stream_guard", f"WITH {WM}, {DUE} SELECT * FROM (" + guard_sql("tok", False) + ") WHERE blk IN (SELECT blk FROM due)")
def _(spark, sf):
    return X.run_available(X.stream_guard(stape(spark, sf), ["tok"], BAND))


@query("str_06_stream_dip_signal", f"""WITH RECURSIVE {TAPE}, {WM}, {DUE},
d AS (SELECT *, row_number() OVER (PARTITION BY tok ORDER BY blk) AS i FROM (SELECT t.*, (SELECT max(r.px) FROM tape r WHERE r.tok = t.tok AND r.blk <= t.blk AND r.ts // 21600 > t.ts // 21600 - 20) AS high FROM tape t)
  WHERE 1 - px / high >= 0.5),
k AS (SELECT tok, i, ts, blk, px, high FROM d WHERE i = 1 UNION ALL SELECT n.tok, n.i, n.ts, n.blk, n.px, n.high FROM k JOIN LATERAL (
  SELECT * FROM d WHERE d.tok = k.tok AND d.ts >= k.ts + {2 * D} ORDER BY d.blk LIMIT 1) n ON true)
SELECT blk, ts, px, high FROM k WHERE blk IN (SELECT blk FROM due)""")
def _(spark, sf):
    return X.run_available(X.stream_dip_signal(stape(spark, sf), ["tok"], 0.5, 21600, 20, 2 * D))


@query("str_08_stream_sessions", ctes(TAPE, WM, """
g AS (SELECT e.user_id AS tok, epoch_us(e.ts) AS us, t.usd, CASE WHEN epoch_us(e.ts) - lag(epoch_us(e.ts)) OVER (PARTITION BY user_id ORDER BY e.ts) <= 21600000000 THEN 0 ELSE 1 END AS st
      FROM events e JOIN tape t ON t.blk = e.event_id),
s AS (SELECT *, sum(st) OVER (PARTITION BY tok ORDER BY us) AS sid FROM g)""") + """
SELECT tok, min(us) // 1000000 AS start, count(*) AS n, sum(usd) AS vol FROM s GROUP BY tok, sid HAVING max(us) + 21600000000 <= (SELECT us FROM wm)""")
def _(spark, sf):
    out = X.run_available(X.stream_sessions(X.watermarked_tape(stape(spark, sf)), ["tok"], "6 hours"))
    return out.select("tok", F.unix_seconds("session_window.start").alias("start"), "n", "vol")


@query("str_09_stream_asof_enrich", ctes(TAPE, WM, DUE) + """
SELECT t.blk, (SELECT px FROM tape r WHERE r.tok = t.tok AND r.pool = 'click' AND r.blk < t.blk ORDER BY blk DESC LIMIT 1) AS ref_px
FROM tape t JOIN customer ON c_custkey = tok WHERE c_mktsegment <> 'BUILDING' AND t.pool <> 'click' AND t.blk IN (SELECT blk FROM due)""")
def _(spark, sf):
    seg = table(spark, sf, "customer").filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("tok"), F.col("c_mktsegment").alias("pad"))
    s = stape(spark, sf).withColumn("is_ref", F.col("pool") == "click")
    return X.run_available(X.stream_asof_enrich(s, ["tok"], "is_ref", seg, "tok"))


@query("str_10_late_audit", ctes(TAPE) + f"SELECT 0::BIGINT AS trigger, count(*) AS rows, count(*) FILTER (ts >= {T0 + 20 * D}) AS past_cut, 0::BIGINT AS behind, 0::BIGINT AS lateness, max(ts) AS max_ts FROM tape")
def _(spark, sf):
    return X.late_audit(stape(spark, sf).select("blk", "ts"), T0 + 20 * D)
