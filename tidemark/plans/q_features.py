"""Queries of the rolling-feature family. Stand-in units: a "minute" is 6 h and an "hour" a day, as coins print
about twice a day in the given events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalar import DAY, bucket, round_scaled
from tidemark.operators import features as W
from tidemark.operators import joins as J
from tidemark.operators.slicing import quantiles_linear, rank_select, upper_median, width_or_layout
from tidemark.plans.registry import query
from tidemark.plans.standins import CALLS, TAPE, calls, ctes, table, tape

D = DAY
Q = 21600
T0 = 1704067200  # 2024-01-01, the first day of the events
END = 1706745600  # 2024-02-01
FINE, COARSE = Q, 4 * D


@query("agg_01_bucket_ohlcv", ctes(TAPE) + f"""
SELECT tok, pool, w, ts // w AS b, arg_min(px, blk) AS open, max(px) AS high, min(px) AS low, arg_max(px, blk) AS close,
       sum(usd) AS vol, count(*) AS n
FROM tape, (VALUES ({Q}), ({D}), ({5 * D})) v(w) GROUP BY tok, pool, w, ts // w""")
def _(spark, sf):
    t = tape(spark, sf)
    parts = [W.bucket_ohlcv(t, ["tok", "pool"], w).withColumn("w", F.lit(w)) for w in (Q, D, 5 * D)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("agg_02_pool_lifecycle", ctes(TAPE, """
r AS (SELECT *, usd <= 0.05 * max(usd) OVER (PARTITION BY tok, pool ORDER BY ts, blk) AS low FROM tape),
k AS (SELECT tok, pool, max(CASE WHEN NOT low THEN blk END) AS last_ok FROM r GROUP BY ALL),
d AS (SELECT r.tok, r.pool, min(r.ts) AS drain_ts FROM r JOIN k ON r.tok = k.tok AND r.pool = k.pool
      WHERE low AND (last_ok IS NULL OR blk > last_ok) GROUP BY ALL)""") + f"""
SELECT t.tok, t.pool, min(t.ts) AS first_ts, max(t.ts) AS last_ts, count(*) AS n_swaps,
       CAST(sum(CASE WHEN side = 'buy' THEN 1 ELSE 0 END) AS BIGINT) AS n_buys, max(px) AS peak_price,
       arg_min(t.ts, (-px, t.ts)) AS peak_ts, arg_max(px, blk) AS last_price, arg_max(usd, blk) AS last_liq, max(usd) AS peak_liq,
       max(d.drain_ts) AS drain_ts, ({END} - max(t.ts)) // 3600 AS silent_h, {END} - max(t.ts) >= {5 * D} AS dead,
       max(d.drain_ts) IS NOT NULL AS drained,
       CASE WHEN max(d.drain_ts) IS NOT NULL THEN 0.0 ELSE CAST(arg_max(px, blk) AS DOUBLE) END AS book_price
FROM tape t LEFT JOIN d ON d.tok = t.tok AND d.pool = t.pool GROUP BY t.tok, t.pool""")
def _(spark, sf):
    return W.pool_lifecycle(tape(spark, sf), END, "usd", silent=5 * D, low_share=0.05)


@query("agg_03_pool_counts", ctes(TAPE) + "SELECT tok, pool, count(*) AS n, sum(usd) AS vol FROM tape GROUP BY tok, pool")
def _(spark, sf):
    return W.pool_counts(tape(spark, sf))


@query("agg_04_unknown_pools", ctes(TAPE, """
m AS (SELECT tok, count(*) AS n, min(blk) AS first_blk, max(blk) AS last_blk FROM tape
      WHERE tok NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY tok),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, tok) AS rank FROM m)""") + """
SELECT tok, n, first_blk, last_blk, rank,
       round((SELECT sum(n) FROM r WHERE rank <= 10) / (SELECT sum(n) FROM r), 9) AS top10_share,
       round((SELECT sum(n) FROM r WHERE rank <= 50) / (SELECT sum(n) FROM r), 9) AS top50_share FROM r""")
def _(spark, sf):
    known = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("tok"))
    out = W.unknown_pools(tape(spark, sf), known, "tok", (10, 50))
    return out.withColumn("top10_share", F.round("top10_share", 9)).withColumn("top50_share", F.round("top50_share", 9))


@query("agg_05_launch_volume", ctes(TAPE) + f"""
SELECT c_mktsegment AS pad, ts // {D} AS hour, sum(usd) AS vol, count(*) AS n
FROM tape JOIN customer ON c_custkey = tok GROUP BY ALL""")
def _(spark, sf):
    pads = table(spark, sf, "customer").select(F.col("c_custkey").alias("tok"), F.col("c_mktsegment").alias("pad"))
    return W.launch_volume(tape(spark, sf).join(pads, "tok"), "pad", D)


@query("agg_06_upper_median", """
SELECT l_returnflag, l_linestatus, count(*) AS n, (list_sort(list(l_extendedprice)))[count(*) // 2 + 1] AS median
FROM lineitem GROUP BY ALL""")
def _(spark, sf):
    return upper_median(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")


@query("agg_07_quantile_linear", """
SELECT o_orderpriority, count(*) AS n, round(quantile_cont(o_totalprice, 0.025), 6) AS p025,
       round(quantile_cont(o_totalprice, 0.5), 6) AS p50, round(quantile_cont(o_totalprice, 0.975), 6) AS p975
FROM orders GROUP BY ALL""")
def _(spark, sf):
    out = quantiles_linear(table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice", {"p025": 0.025, "p50": 0.5, "p975": 0.975})
    return out.select("o_orderpriority", "n", *[F.round(c, 6).alias(c) for c in ("p025", "p50", "p975")])


@query("agg_08_index_quantile", ctes(TAPE) + """
SELECT pool, count(*) AS n, (list_sort(list(px)))[CAST(floor(0.5 * count(*)) AS BIGINT) + 1] AS p50,
       (list_sort(list(px)))[CAST(floor(0.75 * count(*)) AS BIGINT) + 1] AS p75,
       (list_sort(list(px)))[CAST(floor(0.9 * count(*)) AS BIGINT) + 1] AS p90 FROM tape GROUP BY pool""")
def _(spark, sf):
    n = F.col("n")
    return rank_select(tape(spark, sf), ["pool"], "px", {
        "p50": F.floor(0.5 * n), "p75": F.floor(0.75 * n), "p90": F.floor(0.9 * n)})


@query("agg_09_log_bands", ctes(TAPE, """
q AS (SELECT p, quantile_cont(px, 0.2) AS q FROM tape, (VALUES (0.2)) v(p) GROUP BY p
      UNION ALL SELECT p, quantile_cont(px, 0.4) FROM tape, (VALUES (0.4)) v(p) GROUP BY p
      UNION ALL SELECT p, quantile_cont(px, 0.6) FROM tape, (VALUES (0.6)) v(p) GROUP BY p
      UNION ALL SELECT p, quantile_cont(px, 0.8) FROM tape, (VALUES (0.8)) v(p) GROUP BY p),
s AS (SELECT m * pow(10.0, k) AS s FROM (VALUES (1.0), (2.0), (2.5), (5.0)) a(m), range(-4, 8) b(k))""") + """
SELECT CAST(p AS DOUBLE) AS p, round(q, 6) AS q, CAST(arg_min(s, (abs(ln(s) - ln(q)), s)) AS DOUBLE) AS edge FROM q, s GROUP BY p, q""")
def _(spark, sf):
    return W.log_bands(tape(spark, sf), "px").withColumn("q", F.round("q", 6))


@query("win_07_coin_stats", ctes(TAPE, f"""
h AS (SELECT tok, ts // {D} AS b, arg_max(px, blk) AS close, sum(usd) AS vol FROM tape GROUP BY ALL),
g AS (SELECT tok, b + 1 AS t FROM h),
w AS (SELECT g.tok, g.t, h.b, h.close, h.vol FROM g JOIN h ON h.tok = g.tok AND h.b BETWEEN g.t - 15 AND g.t - 1),
f AS (SELECT tok, t, min(b) AS b0, sum(CASE WHEN b >= t - 5 THEN vol END) AS vol_prior FROM w GROUP BY ALL),
sp AS (SELECT f.tok, f.t, f.vol_prior, f.b0, i.b, (SELECT 1) AS one FROM f, range(0, 15) r(k), LATERAL (SELECT f.b0 + r.k AS b) i WHERE i.b < f.t),
cl AS (SELECT sp.tok, sp.t, sp.vol_prior, sp.b0, sp.b, last_value(w.close IGNORE NULLS) OVER (PARTITION BY sp.tok, sp.t ORDER BY sp.b) AS c
       FROM sp LEFT JOIN w ON w.tok = sp.tok AND w.t = sp.t AND w.b = sp.b),
r AS (SELECT tok, t, vol_prior, CASE WHEN c > 0 AND p > 0 THEN ln(c / p) END AS r FROM (SELECT *, lag(c) OVER (PARTITION BY tok, t ORDER BY b) AS p FROM cl))""") + """
SELECT tok, t AS t_bucket, max(vol_prior) AS vol_prior, count(r) AS n_ret,
       CASE WHEN count(r) >= 6 THEN round(stddev_samp(r), 6) END AS sd FROM r GROUP BY tok, t""")
def _(spark, sf):
    out = W.coin_stats(tape(spark, sf), ["tok"], D, vol_n=5, ret_n=15, min_ret=6)
    return out.withColumn("sd", F.round("sd", 6))


@query("win_08_hot", ctes(TAPE, f"h AS (SELECT tok, ts // {D} AS b, sum(usd) AS vol FROM tape GROUP BY ALL)") + """
SELECT g.tok, g.b + 1 AS t_bucket,
  CAST(coalesce((SELECT sum(vol) FROM h WHERE h.tok = g.tok AND h.b BETWEEN g.b - 2 AND g.b), 0) / 3
     > coalesce((SELECT sum(vol) FROM h WHERE h.tok = g.tok AND h.b BETWEEN g.b - 8 AND g.b - 3), 0) / 6 AS INT) AS hot
FROM h g""")
def _(spark, sf):
    return W.hot(tape(spark, sf), ["tok"], D, 3, 6)


@query("win_01_decayed_volume", ctes(TAPE) + f"""
SELECT blk, tok, pool, round(sum(usd * pow(2.0, (ts - {T0}) / 432000.0)) OVER (PARTITION BY tok, pool ORDER BY ts, blk)
       * pow(2.0, -(ts - {T0}) / 432000.0), 6) AS dvol FROM tape""")
def _(spark, sf):
    out = W.decayed_volume(tape(spark, sf), ["tok", "pool"], 5 * D)
    return out.select("blk", "tok", "pool", F.round("dvol", 6).alias("dvol"))


@query("win_02_main_pool", ctes(TAPE, f"""
p AS (SELECT l.blk, l.tok, r.pool, sum(r.usd * pow(2.0, (r.ts - l.ts) / 432000.0)) AS v, min(r.blk) AS seen
      FROM tape l JOIN tape r ON r.tok = l.tok AND r.blk < l.blk GROUP BY ALL)""") + """
SELECT t.blk, t.tok, (SELECT arg_max(p.pool, (round(p.v, 9), -p.seen)) FROM p WHERE p.blk = t.blk) AS main FROM tape t""")
def _(spark, sf):
    return W.main_pool(tape(spark, sf), 5 * D).select("blk", "tok", "main")


HIGH_SQL = """
SELECT l.blk, l.tok, l.pool,
  (SELECT max(CAST(r.px AS FLOAT)) FROM tape r WHERE {k} AND r.blk <= l.blk AND r.ts // {q} > l.ts // {q} - 2)::DOUBLE AS high_2,
  (SELECT max(CAST(r.px AS FLOAT)) FROM tape r WHERE {k} AND r.blk <= l.blk AND r.ts // {q} > l.ts // {q} - 8)::DOUBLE AS high_8,
  (SELECT max(CAST(r.px AS FLOAT)) FROM tape r WHERE {k} AND r.blk <= l.blk
     AND (r.ts // {q} > l.ts // {q} - 8 OR r.ts // {d} >= l.ts // {d} - 5))::DOUBLE AS high_day
FROM tape l"""


@query("win_03_pool_highs", ctes(TAPE) + HIGH_SQL.format(k="r.tok = l.tok AND r.pool = l.pool", q=Q, d=D))
def _(spark, sf):
    out = W.highs(tape(spark, sf), ["tok", "pool"], Q, (2, 8), D, 5)
    return out.select("blk", "tok", "pool", "high_2", "high_8", "high_day")


@query("win_04_coin_highs", ctes(TAPE, "h AS (" + HIGH_SQL.format(k="r.tok = l.tok", q=Q, d=D) + ")") + f"""
SELECT h.*, (SELECT arg_min(r.pool, (-CAST(r.px AS FLOAT), r.blk)) FROM tape r WHERE r.tok = h.tok AND r.blk <= h.blk
   AND r.ts // {Q} > (SELECT ts FROM tape z WHERE z.blk = h.blk) // {Q} - 8) AS maker FROM h""")
def _(spark, sf):
    out = W.highs(tape(spark, sf), ["tok"], Q, (2, 8), D, 5, with_maker=True)
    return out.select("blk", "tok", "pool", "high_2", "high_8", "high_day", "maker")


@query("win_05_dip", ctes(TAPE, "h AS (" + HIGH_SQL.format(k="r.tok = l.tok AND r.pool = l.pool", q=Q, d=D) + ")") + """
SELECT t.blk, t.tok, round(1 - t.px / nullif(h.high_day, 0), 6) AS dip FROM tape t JOIN h USING (blk) WHERE 1 - t.px / nullif(h.high_day, 0) >= 0.3""")
def _(spark, sf):
    out = W.highs(tape(spark, sf), ["tok", "pool"], Q, (2, 8), D, 5).withColumn("dip", W.dip(F.col("px"), F.col("high_day")))
    return out.filter("dip >= 0.3").select("blk", "tok", F.round("dip", 6).alias("dip"))


@query("win_06_history_hours", ctes(TAPE, f"""
h AS (SELECT tok, ts // {D} AS b, max(CASE WHEN usd >= 50 THEN 1 ELSE 0 END) AS ok FROM tape GROUP BY ALL),
f AS (SELECT tok, min(ts) AS birth FROM tape GROUP BY tok)""") + f"""
SELECT g.tok, g.b + 1 AS t_bucket, CASE WHEN (g.b + 1 - 7) * {D} < {T0 + 2 * D} AND (g.b + 1 - 7) * {D} < f.birth THEN -1
  ELSE (SELECT sum(ok) FROM h WHERE h.tok = g.tok AND h.b BETWEEN g.b - 6 AND g.b) END::BIGINT AS h_n
FROM h g JOIN f ON f.tok = g.tok""")
def _(spark, sf):
    return W.history_hours(tape(spark, sf), ["tok"], 50, 7, D, coverage=T0 + 2 * D)


@query("win_09_recent_prints", ctes(TAPE) + f"""
SELECT l.blk, l.tok, (SELECT count(*) FROM tape r WHERE r.tok = l.tok AND r.usd >= 40 AND r.ts > l.ts - {2 * D} AND r.ts <= l.ts) AS n10
FROM tape l""")
def _(spark, sf):
    return W.recent_prints(tape(spark, sf), ["tok"], 2 * D, 40).select("blk", "tok", "n10")


@query("win_10_distinct_buyers", ctes(TAPE) + f"""
SELECT tok, CAST(ceil(ts / {D}.0) AS BIGINT) AS t_bucket, count(DISTINCT CAST(usd AS BIGINT) % 10) AS buyers
FROM tape WHERE side = 'buy' AND usd >= 20 GROUP BY ALL""")
def _(spark, sf):
    t = tape(spark, sf).withColumn("w", F.col("usd").cast("long") % 10)
    return W.distinct_buyers(t, ["tok"], "w", 20, D)


RINGS = ((Q, 8), (D, 10), (5 * D, 6))


def _px_at(off: str) -> str:
    return f"""coalesce(
  (SELECT arg_max(c, b) FROM cb WHERE cb.tok = l.tok AND w = {Q} AND b < ({off}) // {Q} AND b > l.ts // {Q} - 8),
  (SELECT arg_max(c, b) FROM cb WHERE cb.tok = l.tok AND w = {D} AND b < ({off}) // {D} AND b > l.ts // {D} - 10),
  (SELECT arg_max(c, b) FROM cb WHERE cb.tok = l.tok AND w = {5 * D} AND b < ({off}) // {5 * D} AND b > l.ts // {5 * D} - 6))"""


CB = f"""cb AS (SELECT tok, w, ts // w AS b, arg_max(px, blk) AS c FROM tape, (VALUES ({Q}), ({D}), ({5 * D})) v(w) GROUP BY ALL)"""


@query("win_11_trend", ctes(TAPE, CB, f"""
x AS (SELECT l.blk, l.tok, {_px_at(f'l.ts - {D}')} AS a, {_px_at(f'l.ts - {3 * D}')} AS z FROM tape l WHERE l.pool = 'purchase'),
c AS (SELECT blk, tok, CASE WHEN a > 0 AND z > 0 THEN a / z - 1 END AS chg FROM x)""") + """
SELECT blk, tok, round(chg, 6) AS chg, CASE WHEN chg >= -0.09 THEN 'up' WHEN chg <= -0.30 THEN 'away'
  WHEN chg IS NOT NULL THEN 'flat' END AS trend FROM c""")
def _(spark, sf):
    t = tape(spark, sf)
    out = W.trend(t.filter("pool = 'purchase'").select("blk", "tok", "ts"), t, ["tok"], D, 2 * D, RINGS)
    return out.select("blk", "tok", F.round("chg", 6).alias("chg"), "trend")


@query("win_12_lookback_return", ctes(TAPE, CB) + f"""
SELECT blk, tok, round(CASE WHEN p > 0 THEN px / p - 1 END, 6) AS ret_back
FROM (SELECT l.*, {_px_at(f'l.ts - {D}')} AS p FROM tape l WHERE l.pool = 'purchase')""")
def _(spark, sf):
    t = tape(spark, sf)
    out = W.lookback_return(t.filter("pool = 'purchase'").select("blk", "tok", "ts", "px"), t, ["tok"], D, RINGS)
    return out.select("blk", "tok", F.round("ret_back", 6).alias("ret_back"))


EPISODES = f"""RECURSIVE tape AS MATERIALIZED ({TAPE.split('AS (', 1)[1][:-1]}),
d AS (SELECT *, row_number() OVER (PARTITION BY tok ORDER BY blk) AS i FROM (
  SELECT t.*, max(CAST(px AS FLOAT)) OVER (PARTITION BY tok ORDER BY blk) AS hi FROM tape t) WHERE 1 - px / nullif(hi, 0) >= 0.3),
k AS (SELECT tok, i, ts, blk, pool, px FROM d WHERE i = 1
  UNION ALL
  SELECT n.tok, n.i, n.ts, n.blk, n.pool, n.px FROM k JOIN LATERAL (
    SELECT * FROM d WHERE d.tok = k.tok AND d.ts >= k.ts + {2 * D} ORDER BY d.blk LIMIT 1) n ON true),
ep AS (SELECT k.*, (SELECT min(r.ts) FROM tape r WHERE r.tok = k.tok AND r.pool = k.pool AND r.ts > k.ts AND r.ts <= k.ts + {6 * D}
                    AND r.px >= 1.2 * k.px) AS rec_ts FROM k)"""


def _episodes(spark, sf):
    t = tape(spark, sf)
    from tidemark.functions.scalar import float32
    from tidemark.operators.slicing import running
    hi = running(t, ["tok"], W.ORDER, {"hi": ("max", float32(F.col("px")))}, bucket("ts", width_or_layout(None)))
    dips = hi.filter(W.dip(F.col("px"), F.col("hi")) >= 0.3).drop("hi")
    return t, W.dip_episodes(t, dips, 2 * D, 1.2, 6 * D, FINE, COARSE)


@query("win_13_dip_episodes", "WITH " + EPISODES + " SELECT tok, blk, ts, rec_ts FROM ep")
def _(spark, sf):
    return _episodes(spark, sf)[1].select("tok", "blk", "ts", "rec_ts")


#: The prints in the operator's order (ts, blk), whatever order their numbers have.
EPISODES_IN_TIME = EPISODES.replace("ORDER BY blk", "ORDER BY ts, blk").replace("ORDER BY d.blk", "ORDER BY d.ts, d.blk")


@query("win_13_recovered_before", "WITH " + EPISODES_IN_TIME + f"""
SELECT s.blk, s.tok, (SELECT count(*) FROM ep WHERE ep.tok = s.tok AND ep.rec_ts <= s.ts AND ep.ts >= s.ts - {10 * D}) AS nrec
FROM tape s WHERE s.pool = 'purchase'""")
def _(spark, sf):
    t, ep = _episodes(spark, sf)
    out = W.recovered_before(t.filter("pool = 'purchase'").select("blk", "tok", "ts"), ep, 10 * D)
    return out.select("blk", "tok", "nrec")


@query("win_14_sell_flags", ctes(TAPE, f"""
w AS (SELECT l.blk, l.tok, r.side, r.px, r.usd, r.ts, row_number() OVER (PARTITION BY l.blk ORDER BY r.blk DESC) AS rk
      FROM tape l JOIN tape r ON r.tok = l.tok AND r.blk <= l.blk AND r.ts > l.ts - {3 * D}),
a AS (SELECT blk, tok, max(CASE WHEN side = 'sell' AND usd >= 60 THEN 1 ELSE 0 END) AS sell_big,
        list_sort(list(px) FILTER (side = 'sell' AND rk <= 5)) AS s, list_sort(list(px) FILTER (side = 'buy' AND rk <= 5)) AS b
      FROM w GROUP BY ALL)""") + """
SELECT blk, tok, CAST(sell_big AS INT) AS sell_big, CAST(coalesce(len(s), 0) AS INT) AS n_sells,
       round(s[len(s) // 2 + 1] / nullif(b[len(b) // 2 + 1], 0), 6) AS sell_buy_ratio FROM a""")
def _(spark, sf):
    out = W.sell_flags(tape(spark, sf), ["tok"], 3 * D, 5, 60)
    return out.select("blk", "tok", "sell_big", "n_sells", round_scaled(F.col("sell_buy_ratio"), 6).alias("sell_buy_ratio"))


@query("win_15_fee_estimate", ctes(TAPE, """
s AS (SELECT *, lag(px) OVER (PARTITION BY tok, pool ORDER BY blk) AS lp, usd + 1 AS aq, (usd + 1) / (px * 1.05) AS am FROM tape),
f AS (SELECT *, CASE WHEN lp > 0 AND px > 0 THEN CASE WHEN side = 'buy' THEN aq / (am * sqrt(px * lp)) - 1
       ELSE 1 - aq / (am * sqrt(px * lp)) END END AS f0 FROM s),
g AS (SELECT *, CASE WHEN f0 > -0.001 AND f0 < 0.99 THEN greatest(f0, 0) END AS fee FROM f),
n AS (SELECT *, count(fee) OVER (PARTITION BY tok, pool ORDER BY blk) AS rk FROM g),
l AS (SELECT n.blk, list_sort(list(m.fee)) AS fs FROM n JOIN n m ON m.tok = n.tok AND m.pool = n.pool AND m.fee IS NOT NULL
      AND m.rk BETWEEN n.rk - 4 AND n.rk GROUP BY n.blk)""") + """
SELECT g.blk, g.tok, g.pool, round(fee, 6) AS fee, round(fs[len(fs) // 2 + 1], 6) AS fee_est FROM g LEFT JOIN l USING (blk)""")
def _(spark, sf):
    t = tape(spark, sf).withColumn("aq", F.col("usd") + 1).withColumn("at", F.try_divide("aq", F.col("px") * 1.05))
    out = W.fee_estimate(t, ["tok", "pool"], "px", "at", "aq")
    return out.select("blk", "tok", "pool", F.round("fee", 6).alias("fee"), F.round("fee_est", 6).alias("fee_est"))


@query("win_16_signal_features", ctes(TAPE, f"""
w AS (SELECT l.blk, l.tok, l.ts AS t, r.ts, r.side, CAST(r.px AS FLOAT) AS x FROM tape l JOIN tape r
      ON r.tok = l.tok AND r.ts BETWEEN l.ts - {4 * D} AND l.ts WHERE l.pool = 'purchase'),
m AS (SELECT *, max(x) OVER (PARTITION BY blk) AS mx FROM w),
k AS (SELECT blk, tok, min(CASE WHEN x = mx THEN ts END) AS max_first, max(CASE WHEN x = mx THEN ts END) AS max_last,
             count(CASE WHEN x = mx THEN 1 END) AS max_ties FROM m GROUP BY ALL)""") + """
SELECT k.*, (SELECT count(*) FROM w WHERE w.blk = k.blk AND side = 'sell' AND ts > max_first) AS sells_since_first,
       (SELECT count(*) FROM w WHERE w.blk = k.blk AND side = 'sell' AND ts > max_last) AS sells_since_last FROM k""")
def _(spark, sf):
    t = tape(spark, sf)
    out = W.signal_features(t.filter("pool = 'purchase'").select("blk", "tok", "ts"), t, ["tok"], "blk", 4 * D, Q, 4 * Q)
    return out.select("blk", "tok", "max_first", "max_last", "max_ties", "sells_since_first", "sells_since_last")


@query("win_17_activity_count", ctes(TAPE, f"h AS (SELECT tok, ts // {Q} AS b, count(*) AS n FROM tape WHERE usd >= 10 GROUP BY ALL)") + """
SELECT g.tok, g.b, CAST((SELECT sum(n) FROM h WHERE h.tok = g.tok AND h.b BETWEEN g.b - 6 AND g.b) AS BIGINT) AS activity FROM h g""")
def _(spark, sf):
    return W.activity_count(tape(spark, sf), ["tok"], Q, 6, 10)


@query("win_18_age_at", ctes(TAPE) + f"""
SELECT t.blk, t.tok, greatest(t.ts - least(CASE WHEN c_acctbal > 0 THEN {T0} - CAST(floor(c_acctbal) AS BIGINT) END, f.first_ts), 0) AS age
FROM tape t JOIN (SELECT tok, min(ts) AS first_ts FROM tape GROUP BY tok) f USING (tok) LEFT JOIN customer ON c_custkey = t.tok
WHERE t.pool = 'purchase'""")
def _(spark, sf):
    t = tape(spark, sf)
    births = table(spark, sf, "customer").select(F.col("c_custkey").alias("tok"), F.when(
        F.col("c_acctbal") > 0, F.lit(T0) - F.floor("c_acctbal").cast("long")).alias("birth_ts"))
    first = t.groupBy("tok").agg(F.min("ts").alias("first_ts"))
    return W.age_at(t.filter("pool = 'purchase'"), births, first).select("blk", "tok", "age")


@query("win_19_rank_on_key", ctes(TAPE, CALLS) + """
SELECT id, tok, caller, row_number() OVER (PARTITION BY tok ORDER BY ts, id) AS rank_coin,
       row_number() OVER (PARTITION BY caller ORDER BY ts, id) AS rank_caller FROM calls""")
def _(spark, sf):
    out = W.rank_on_key(calls(spark, sf), "tok", "rank_coin")
    return W.rank_on_key(out, "caller", "rank_caller").select("id", "tok", "caller", "rank_coin", "rank_caller")


@query("win_20_follower_lag", ctes(TAPE, CALLS, "f AS (SELECT *, ts - min(ts) OVER (PARTITION BY tok) AS lag_s, row_number() OVER (PARTITION BY tok ORDER BY ts, id) AS rk FROM calls)") + f"""
SELECT CASE WHEN rk = 1 THEN 'first' WHEN lag_s <= {D} THEN '<={D}' WHEN lag_s <= {5 * D} THEN '<={5 * D}'
  WHEN lag_s <= {15 * D} THEN '<={15 * D}' ELSE '>{15 * D}' END AS lag_band, count(*) AS n, count(DISTINCT tok) AS coins FROM f GROUP BY 1""")
def _(spark, sf):
    out = W.follower_lag(calls(spark, sf), "tok", [D, 5 * D, 15 * D])
    return out.groupBy("lag_band").agg(F.count("*").alias("n"), F.count_distinct("tok").alias("coins"))


@query("win_21_runup", ctes(TAPE, CALLS) + f"""
SELECT c.id, round(100 * (now.px / nullif(coalesce(old.px, CASE WHEN ins.ts < c.ts THEN ins.px END), 0) - 1), 6) AS runup_pct,
       coalesce(now.px, CASE WHEN aft.ts - c.ts <= {D} THEN aft.px END) AS px_at_call
FROM calls c
LEFT JOIN LATERAL (SELECT px FROM tape t WHERE t.tok = c.tok AND t.ts < c.ts ORDER BY blk DESC LIMIT 1) now ON true
LEFT JOIN LATERAL (SELECT px FROM tape t WHERE t.tok = c.tok AND t.ts < c.ts - {3 * D} ORDER BY blk DESC LIMIT 1) old ON true
LEFT JOIN LATERAL (SELECT px, ts FROM tape t WHERE t.tok = c.tok AND t.ts >= c.ts - {3 * D} ORDER BY blk LIMIT 1) ins ON true
LEFT JOIN LATERAL (SELECT px, ts FROM tape t WHERE t.tok = c.tok AND t.ts >= c.ts ORDER BY blk LIMIT 1) aft ON true""")
def _(spark, sf):
    out = W.runup(calls(spark, sf).select("id", "tok", "ts"), tape(spark, sf), ["tok"], 3 * D, D)
    return out.select("id", F.round("runup_pct", 6).alias("runup_pct"), "px_at_call")


CANDLES = f"candles AS (SELECT tok, (ts // {Q} + 1) * {Q} AS ts, max(px) AS high, arg_max(px, blk) AS close FROM tape GROUP BY tok, ts // {Q})"


def _candles(spark, sf):
    return W.bucket_ohlcv(tape(spark, sf), ["tok"], Q).select("tok", ((F.col("b") + 1) * Q).alias("ts"), "high", "close")


@query("win_22_race", ctes(TAPE, CALLS, CANDLES, f"""
g AS (SELECT c.id, c.tok, c.ts, c.call_px, o.off FROM calls c,
      (SELECT unnest(range({Q}, {4 * Q} + 1, {Q})) AS off UNION ALL SELECT unnest(range({4 * Q + D}, {11 * D} + 1, {D}))) o)""") + f"""
SELECT g.id, g.tok, CAST(g.off AS INT) AS off, round(100 * (k.close / nullif(call_px, 0) - 1), 5) AS pct
FROM g ASOF JOIN candles k ON k.tok = g.tok AND g.ts + g.off >= k.ts
WHERE k.ts > g.ts AND g.ts + g.off - k.ts <= {2 * D}""")
def _(spark, sf):
    out = W.race(calls(spark, sf), _candles(spark, sf), ["tok"], "id", [(Q, 4 * Q), (D, 11 * D)], "call_px", 2 * D)
    return out.withColumn("pct", F.round("pct", 5))


@query("win_23_peak_after", ctes(TAPE, CALLS, CANDLES) + f"""
SELECT c.id, round(p.high / nullif(call_px, 0), 6) AS peak_x, p.ts - c.ts AS peak_s, round(l.high / nullif(call_px, 0), 6) AS late_x, l.ts - c.ts AS late_s FROM calls c
LEFT JOIN LATERAL (SELECT high, ts FROM candles k WHERE k.tok = c.tok AND k.ts > c.ts AND k.ts <= c.ts + {5 * D} ORDER BY high DESC, ts LIMIT 1) p ON true
LEFT JOIN LATERAL (SELECT high, ts FROM candles k WHERE k.tok = c.tok AND k.ts > c.ts + {7 * D} AND k.ts <= c.ts + {20 * D} ORDER BY high DESC, ts LIMIT 1) l ON true""")
def _(spark, sf):
    c, k = calls(spark, sf), _candles(spark, sf)
    a = W.peak_after(c, k, ["tok"], "id", 0, 5 * D, "call_px", Q, 4 * Q, "peak")
    b = W.peak_after(a, k, ["tok"], "id", 7 * D, 20 * D, "call_px", Q, 4 * Q, "late")
    return b.select("id", F.round("peak_x", 6).alias("peak_x"), "peak_s", F.round("late_x", 6).alias("late_x"), "late_s")


@query("win_24_first_multiple", ctes(TAPE, CALLS, CANDLES) + f"""
SELECT c.id, (SELECT min(k.ts) FROM candles k WHERE k.tok = c.tok AND k.ts > c.ts AND k.ts <= c.ts + {12 * D} AND k.high >= 3 * call_px) - c.ts AS hit_s
FROM calls c""")
def _(spark, sf):
    out = W.first_multiple(calls(spark, sf), _candles(spark, sf), ["tok"], "id", 3.0, "call_px", 12 * D, Q, 4 * Q)
    return out.select("id", "hit_s")


@query("win_25_at_call_features", ctes(TAPE, CALLS) + f"""
SELECT c.id, round(100 * (n.px / nullif(o.px, 0) - 1), 6) AS move_pct,
       coalesce((SELECT sum(usd) FROM tape t WHERE t.tok = c.tok AND t.ts < c.ts AND t.ts >= c.ts - {4 * D}), 0) AS vol_back,
       CASE WHEN c.ts - n.ts <= {3 * D} THEN n.usd END AS depth
FROM calls c
LEFT JOIN LATERAL (SELECT px, ts, usd FROM tape t WHERE t.tok = c.tok AND t.ts < c.ts ORDER BY blk DESC LIMIT 1) n ON true
LEFT JOIN LATERAL (SELECT px FROM tape t WHERE t.tok = c.tok AND t.ts < c.ts - {4 * D} ORDER BY blk DESC LIMIT 1) o ON true""")
def _(spark, sf):
    out = W.at_call_features(calls(spark, sf).select("id", "tok", "ts"), tape(spark, sf), ["tok"], "id", 4 * D, 3 * D)
    return out.select("id", F.round("move_pct", 6).alias("move_pct"), "vol_back", "depth")


@query("win_26_track_record", ctes(TAPE, CALLS, f"""
g AS (SELECT *, 0.5 + call_px / 100 AS gr FROM calls),
k AS (SELECT c.id, c.tok, count(o.id) AS n, coalesce(sum(ln(o.gr)), 0) AS ls, coalesce(sum(o.gr), 0) AS s, max(o.gr) AS bst
      FROM g c LEFT JOIN g o ON o.tok = c.tok AND o.ts + {2 * D} <= c.ts GROUP BY ALL),
r AS (SELECT *, CASE WHEN n >= 5 THEN least(greatest(100 * (exp(ls / n) - 1), -50), 50)
   WHEN n > 1 THEN 100 * ((s - bst) / (n - 1) - 1) ELSE 0 END * n / (n + 8) AS sc FROM k)""") + """
SELECT id, tok, n AS n_closed, CASE WHEN n > 0 THEN round(sc, 6) END AS score,
  CASE WHEN n = 0 THEN 'new' WHEN sc > 10 THEN 'A' WHEN sc > 0 THEN 'B' ELSE 'C' END AS tier FROM r""")
def _(spark, sf):
    c = calls(spark, sf)
    o = c.select("tok", (F.col("ts") + 2 * D).alias("close_ts"), (0.5 + F.col("call_px") / 100).alias("gr"))
    out = W.track_record(J.closed_before(c.select("id", "tok", "ts"), o, "tok", "close_ts", "gr"))
    return out.select("id", "tok", "n_closed", F.round("score", 6).alias("score"), "tier")


@query("win_27_life_of_window", ctes(TAPE, CALLS) + f"""
SELECT c.id, count(DISTINCT CASE WHEN t.ts // {D} > c.ts // {D} THEN t.ts // {D} END) AS data_days,
       max(CASE WHEN t.ts // {D} > c.ts // {D} THEN t.ts END) AS last_print,
       count(CASE WHEN t.ts > c.ts + {7 * D} THEN 1 END) AS after_d7, count(CASE WHEN t.ts > c.ts + {7 * D} THEN 1 END) = 0 AS dead_by_d7
FROM calls c LEFT JOIN tape t ON t.tok = c.tok GROUP BY c.id""")
def _(spark, sf):
    out = W.life_of_window(calls(spark, sf).select("id", "tok", "ts"), tape(spark, sf), ["tok"], "id")
    return out.select("id", "data_days", "last_print", "after_d7", "dead_by_d7")
