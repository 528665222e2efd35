"""Queries of the join family."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalar import DAY, bucket
from tidemark.operators import joins as J
from tidemark.plans.registry import query
from tidemark.plans.standins import CALLS, TAPE, TRADES, TWINS, calls, ctes, table, tape, trades, twins

D = DAY


@query("jon_01_asof_backward", ctes(TAPE) + f"""
SELECT l.blk, l.tok, l.ts, CASE WHEN l.ts - r.ts <= {2 * D} THEN r.blk END AS r_blk,
       CASE WHEN l.ts - r.ts <= {2 * D} THEN r.px END AS r_px
FROM (SELECT *, ts * 1000000 + 999999 AS o FROM tape WHERE pool = 'purchase') l
ASOF LEFT JOIN (SELECT *, ts * 1000000 + row_number() OVER (PARTITION BY tok, ts ORDER BY blk) AS o
                FROM tape WHERE pool = 'click') r
  ON l.tok = r.tok AND l.o >= r.o""")
def _(spark, sf):
    t = tape(spark, sf)
    out = J.asof_backward(t.filter("pool = 'purchase'"), t.filter("pool = 'click'"), ["tok"], tol=2 * D,
                          tie=["blk"], columns=["ts", "blk", "px"])
    return out.select("blk", "tok", "ts", F.col("r.blk").alias("r_blk"), F.col("r.px").alias("r_px"))


@query("jon_01_asof_strict", ctes(TAPE) + """
SELECT l.blk, l.tok, l.pool, r.blk AS prev_blk, r.px AS prev_px
FROM tape l ASOF LEFT JOIN (
  SELECT tok, ts, max(blk) AS blk, max_by(px, blk) AS px FROM tape GROUP BY tok, ts) r
  ON l.tok = r.tok AND l.ts > r.ts""")
def _(spark, sf):
    t = tape(spark, sf)
    out = J.asof_backward(t, t, ["tok"], strict=True, tie=["blk"], columns=["blk", "px"])
    return out.select("blk", "tok", "pool", F.col("r.blk").alias("prev_blk"), F.col("r.px").alias("prev_px"))


@query("jon_02_asof_forward", ctes(TAPE) + f"""
SELECT l.blk, l.tok, CASE WHEN r.ts - l.ts <= {D} THEN r.blk END AS fill_blk,
       CASE WHEN r.ts - l.ts <= {D} THEN r.px END AS fill_px,
       CASE WHEN r.ts - l.ts <= {D} THEN r.ts - l.ts END AS lag_s
FROM (SELECT * FROM tape WHERE pool = 'signup') l
ASOF LEFT JOIN (SELECT tok, ts, min(blk) AS blk, min_by(px, blk) AS px FROM tape WHERE pool = 'view' GROUP BY tok, ts) r
  ON l.tok = r.tok AND l.ts <= r.ts""")
def _(spark, sf):
    t = tape(spark, sf)
    out = J.asof_forward(t.filter("pool = 'signup'"), t.filter("pool = 'view'"), ["tok"], tol=D, tie=["blk"],
                         columns=["ts", "blk", "px"])
    return out.select("blk", "tok", F.col("r.blk").alias("fill_blk"), F.col("r.px").alias("fill_px"),
                      (F.col("r.ts") - F.col("ts")).alias("lag_s"))


@query("jon_03_interp_linear", ctes(TAPE, """
series AS (SELECT (ts // 21600) * 21600 AS x, avg(px) AS y FROM tape WHERE pool = 'click' GROUP BY 1),
p AS (SELECT l.blk, l.ts, s.x, s.y FROM (SELECT * FROM tape WHERE pool = 'purchase') l ASOF LEFT JOIN series s ON l.ts >= s.x),
q AS (SELECT l.blk, s.x AS nx, s.y AS ny FROM (SELECT * FROM tape WHERE pool = 'purchase') l ASOF LEFT JOIN series s ON l.ts < s.x)""") + """
SELECT p.blk, p.ts, round(CASE WHEN x IS NULL THEN ny WHEN nx IS NULL THEN y
       ELSE y + (ny - y) * (ts - x) / (nx - x) END, 6) AS interp
FROM p JOIN q USING (blk)""")
def _(spark, sf):
    t = tape(spark, sf)
    series = t.filter("pool = 'click'").groupBy((bucket("ts", 21600) * 21600).alias("ts")).agg(F.avg("px").alias("v"))
    out = J.interp_linear(t.filter("pool = 'purchase'").select("blk", "ts"), series, step=21600)
    return out.withColumn("interp", F.round("interp", 6))


@query("prj_17_block_time", ctes(TAPE, """
anchors AS (SELECT min(blk) AS b, min_by(ts, blk) AS t FROM tape WHERE pool = 'click' GROUP BY ts // 86400),
n AS (SELECT b, t, lead(b) OVER (ORDER BY b) AS b1, lead(t) OVER (ORDER BY b) AS t1,
             lag(b) OVER (ORDER BY b) AS b0, lag(t) OVER (ORDER BY b) AS t0 FROM anchors),
f AS (SELECT * FROM n WHERE b0 IS NULL)""") + """
SELECT l.blk, CAST(floor(CASE
    WHEN n.b IS NULL THEN f.t + (f.t1 - f.t) * (l.blk - f.b) / (f.b1 - f.b)
    WHEN n.b1 IS NULL THEN n.t0 + (n.t - n.t0) * (l.blk - n.b0) / (n.b - n.b0)
    ELSE n.t + (n.t1 - n.t) * (l.blk - n.b) / (n.b1 - n.b) END + 0.5) AS BIGINT) AS block_ts
FROM tape l ASOF LEFT JOIN n ON l.blk >= n.b, f""")
def _(spark, sf):
    t = tape(spark, sf)
    anchors = t.filter("pool = 'click'").groupBy(bucket("ts", D).alias("d")).agg(
        F.min("blk").alias("blk"), F.min_by("ts", "blk").alias("ts"))
    return J.block_time(t.select("blk"), anchors.select("blk", "ts"), step=300)


@query("jon_04_asof_multires", ctes(TAPE, f"""
c AS (SELECT tok, w, ts // w AS b, max_by(px, blk) AS close FROM tape, (VALUES (21600), ({D}), ({5 * D})) v(w)
      GROUP BY ALL),
s AS (SELECT blk, tok, ts AS now, ts - 43200 AS t FROM tape WHERE pool = 'purchase'),
j AS (SELECT s.blk, s.tok, c.w, max_by(c.close, c.b) AS close
      FROM s JOIN c ON c.tok = s.tok AND c.b < s.t // c.w
       AND c.b > s.now // c.w - CASE c.w WHEN 21600 THEN 8 WHEN {D} THEN 5 ELSE 4 END
      GROUP BY ALL)""") + f"""
SELECT s.blk, s.tok, coalesce(max(CASE WHEN w = 21600 THEN close END), max(CASE WHEN w = {D} THEN close END),
       max(CASE WHEN w = {5 * D} THEN close END)) AS px_at
FROM s LEFT JOIN j ON j.blk = s.blk GROUP BY s.blk, s.tok""")
def _(spark, sf):
    t = tape(spark, sf)
    left = t.filter("pool = 'purchase'").select("blk", "tok", F.col("ts").alias("now"), (F.col("ts") - 43200).alias("t"))
    out = J.asof_multires(left, t, ["tok"], "t", "now", rings=((21600, 8), (D, 5), (5 * D, 4)), order=("blk",))
    return out.select("blk", "tok", "px_at")


@query("jon_05_range_join", ctes(TAPE) + f"""
SELECT l.blk, l.tok, r.blk AS hit_blk, r.px AS hit_px FROM tape l JOIN tape r
  ON r.tok = l.tok AND r.ts >= l.ts AND r.ts <= l.ts + {2 * D}
WHERE l.pool = 'purchase' AND r.pool = 'view'""")
def _(spark, sf):
    t = tape(spark, sf)
    left = t.filter("pool = 'purchase'").select("blk", "tok", F.col("ts").alias("lo"), (F.col("ts") + 2 * D).alias("hi"))
    right = t.filter("pool = 'view'").select("tok", F.col("ts"), F.col("blk").alias("hit_blk"), F.col("px").alias("hit_px"))
    return J.range_join(left, right, ["tok"], "lo", "hi", D).select("blk", "tok", "hit_blk", "hit_px")


@query("jon_05_range_sums", ctes(TAPE) + f"""
SELECT l.blk, l.tok, count(r.blk) AS n_in, round(coalesce(sum(r.usd), 0), 6) AS usd_in
FROM tape l LEFT JOIN tape r ON r.tok = l.tok AND r.ts BETWEEN l.ts - {3 * D} AND l.ts + {D} AND r.pool = 'view'
WHERE l.pool = 'purchase' GROUP BY l.blk, l.tok""")
def _(spark, sf):
    t = tape(spark, sf)
    left = t.filter("pool = 'purchase'").select("blk", "tok", "ts")
    out = J.range_sums(left, t.filter("pool = 'view'"), ["tok"], F.col("ts") - 3 * D, F.col("ts") + D,
                       {"n_in": ("count", F.col("blk")), "usd_in": ("sum", F.col("usd"))}, ["blk"])
    return out.select("blk", "tok", "n_in", F.round("usd_in", 6).alias("usd_in"))


@query("jon_06_interval_flag", ctes(TAPE) + """
SELECT l.blk, l.tok, EXISTS (SELECT 1 FROM tape r WHERE r.pool = 'error' AND r.tok = l.tok
       AND r.ts <= l.ts AND l.ts < r.ts + CAST(r.usd AS BIGINT) * 3600) AS flag
FROM tape l WHERE l.pool = 'click'""")
def _(spark, sf):
    t = tape(spark, sf)
    iv = t.filter("pool = 'error'").select("tok", F.col("ts").alias("s"), (F.col("ts") + F.col("usd").cast("long") * 3600).alias("e"))
    return J.interval_flag(t.filter("pool = 'click'").select("blk", "tok", "ts"), iv, ["tok"]).select("blk", "tok", "flag")


STATES = f"""st AS (
  SELECT s.blk, s.tok, r.pool, max_by(r.px, r.blk) AS px, max_by(r.usd, r.blk) AS usd, max(r.ts) AS rts
  FROM (SELECT * FROM tape WHERE pool = 'signup') s JOIN tape r ON r.tok = s.tok AND r.ts <= s.ts AND r.ts >= s.ts - {10 * D}
  GROUP BY ALL),
fresh AS (SELECT * FROM st WHERE true)"""


@query("jon_07_state_by_pool_at", ctes(TAPE, STATES) + "SELECT blk, tok, pool, px, usd, rts FROM fresh")
def _(spark, sf):
    t = tape(spark, sf)
    out = J.state_by_pool_at(t.filter("pool = 'signup'").select("blk", "tok", "ts"), t, max_age=10 * D, tie=["blk"])
    return out.select("blk", "tok", "pool", F.col("state.px").alias("px"), F.col("state.usd").alias("usd"),
                      F.col("state.ts").alias("rts"))


@query("jon_08_cheapest_pool", ctes(TAPE, STATES) + """
, r AS (SELECT *, 0.01 + 100 / (px + usd + 1) AS cost FROM fresh)
SELECT blk, arg_min(pool, (cost, pool)) AS best_pool, round(min(cost), 9) AS best_cost FROM r GROUP BY blk""")
def _(spark, sf):
    t = tape(spark, sf)
    cost = F.lit(0.01) + 100 / (F.col("state.px") + F.col("state.usd") + 1)
    out = J.cheapest_pool(t.filter("pool = 'signup'").select("blk", "tok", "ts"), t, ["blk"], cost, max_age=10 * D, tie=["blk"])
    return out.select("blk", "best_pool", F.round("best_cost", 9).alias("best_cost"))


@query("jon_10_reference_price", ctes(TAPE, STATES) + """
SELECT blk, arg_min(pool, (-usd, pool)) AS ref_pool, arg_min(px, (-usd, pool)) AS ref_px FROM fresh GROUP BY blk""")
def _(spark, sf):
    t = tape(spark, sf)
    return J.reference_price(t.filter("pool = 'signup'").select("blk", "tok", "ts"), t, ["blk"], max_age=10 * D, tie=["blk"])


@query("jon_09_best_route", """
WITH d AS (SELECT l_orderkey, min((1 + l_tax) * (1 - l_discount)) AS direct_rate FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1),
g AS (SELECT l_orderkey, min(CASE WHEN l_returnflag = 'A' THEN 1 - l_discount / 2 END) AS a,
             min(CASE WHEN l_returnflag = 'R' THEN 1 - l_discount / 2 END) AS b FROM lineitem GROUP BY 1),
j AS (SELECT o_orderkey, direct_rate, a * b AS via_rate FROM orders LEFT JOIN d ON d.l_orderkey = o_orderkey LEFT JOIN g ON g.l_orderkey = o_orderkey)
SELECT o_orderkey, round(CASE WHEN direct_rate IS NULL THEN via_rate WHEN via_rate IS NULL THEN direct_rate
         ELSE least(direct_rate, via_rate) END, 9) AS route_rate,
       CASE WHEN direct_rate IS NULL AND via_rate IS NULL THEN 'none'
            WHEN via_rate IS NULL OR direct_rate <= via_rate THEN 'direct' ELSE 'via' END AS route FROM j""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    li = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    direct = li.filter("l_returnflag = 'N'").select("o_orderkey", ((1 + F.col("l_tax")) * (1 - F.col("l_discount"))).alias("rate"))
    via = li.filter("l_returnflag in ('A', 'R')").select(
        "o_orderkey", F.when(F.col("l_returnflag") == "A", 1).otherwise(2).alias("leg"), (1 - F.col("l_discount") / 2).alias("rate"))
    return J.best_route(o, direct, via, ["o_orderkey"]).select("o_orderkey", F.round("route_rate", 9).alias("route_rate"), "route")


@query("jon_11_twin_candidates", ctes(TAPE, f"""
pool AS (SELECT DISTINCT ts // {D} AS d, CAST(least(floor(usd / 25), 3) AS INT) AS b, tok FROM tape WHERE pool <> 'purchase'),
ring AS (SELECT d, b, tok AS twin, count(*) OVER (PARTITION BY d, b) AS n,
                row_number() OVER (PARTITION BY d, b ORDER BY ('0x' || substr(md5('s1|' || d || '|' || b || '|' || tok), 1, 8))::BIGINT, tok) - 1 AS pos FROM pool),
sig AS (SELECT blk, tok, ts // {D} AS d, CAST(least(floor(usd / 25), 3) AS INT) AS b FROM tape WHERE pool = 'purchase'),
st AS (SELECT s.*, z.n, ('0x' || substr(md5('s1|start|' || blk), 1, 8))::BIGINT % z.n AS start
       FROM sig s JOIN (SELECT DISTINCT d, b, n FROM ring) z USING (d, b)),
hit AS (SELECT st.blk, st.tok, r.twin, st.n, (r.pos - st.start + st.n) % st.n AS step
        FROM st JOIN ring r ON r.d = st.d AND r.b = st.b WHERE r.twin <> st.tok)""") + """
SELECT blk, tok, twin, n AS n_pool, CAST(draw AS INT) AS draw FROM (
  SELECT *, row_number() OVER (PARTITION BY blk ORDER BY step) AS draw FROM hit) WHERE draw <= 3""")
def _(spark, sf):
    t = tape(spark, sf).withColumn("d", bucket("ts", D)).withColumn("b", F.least(F.floor(F.col("usd") / 25), F.lit(3)).cast("int"))
    pool = t.filter("pool <> 'purchase'").select("d", "b", "tok").distinct()
    sig = t.filter("pool = 'purchase'").select("blk", "tok", "d", "b")
    out = J.ring_draw(sig, pool, ["d", "b"], "tok", 3, "s1", ["blk"], "tok")
    return out.select("blk", "tok", "twin", "n_pool", "draw")


@query("jon_12_twin_pairs", ctes(TRADES, TWINS) + """
SELECT t.pair, t.cell, round(t.ret, 6) AS ret, round(avg(CASE WHEN tw = 'A' THEN twin_ret END), 6) AS twin_A,
       round(avg(CASE WHEN tw = 'R' THEN twin_ret END), 6) AS twin_R, count(twin_ret) AS n_twins
FROM trades t JOIN twins w ON w.pair = t.pair GROUP BY t.pair, t.cell, t.ret""")
def _(spark, sf):
    out = J.twin_pairs(trades(spark, sf), twins(spark, sf), "pair", "tw", "twin_ret", ["A", "R"])
    return out.select("pair", "cell", F.round("ret", 6).alias("ret"), F.round("twin_A", 6).alias("twin_A"),
                      F.round("twin_R", 6).alias("twin_R"), "n_twins")


@query("jon_13_distinct_others_within", ctes(TAPE, CALLS) + f"""
SELECT c.id, c.tok, CAST(count(DISTINCT o.chat) AS BIGINT) AS others FROM calls c LEFT JOIN calls o
  ON o.tok = c.tok AND o.chat <> c.chat AND o.ts BETWEEN c.ts - {2 * D} AND c.ts + {2 * D}
GROUP BY c.id, c.tok""")
def _(spark, sf):
    return J.distinct_others_within(calls(spark, sf), "tok", "chat", "id", 2 * D).select("id", "tok", "others")


@query("jon_14_prior_events", ctes(TAPE, CALLS) + """
SELECT c.id, c.tok, count(o.id) AS prior_rows, count(DISTINCT CASE WHEN o.chat <> c.chat THEN o.chat END) AS prior_others
FROM calls c LEFT JOIN calls o ON o.tok = c.tok AND o.ts < c.ts GROUP BY c.id, c.tok""")
def _(spark, sf):
    return J.prior_events(calls(spark, sf), "tok", "chat", "id").select("id", "tok", "prior_rows", "prior_others")


@query("jon_15_closed_before", ctes(TAPE, CALLS) + f"""
SELECT c.id, c.caller, count(o.id) AS n_closed, round(coalesce(sum(o.call_px), 0), 6) AS sum_closed, max(o.call_px) AS best_closed
FROM calls c LEFT JOIN calls o ON o.caller = c.caller AND o.ts + {D} <= c.ts GROUP BY c.id, c.caller""")
def _(spark, sf):
    c = calls(spark, sf)
    o = c.select("caller", (F.col("ts") + D).alias("close_ts"), "call_px")
    out = J.closed_before(c, o, "caller", "close_ts", "call_px")
    return out.select("id", "caller", "n_closed", F.round(F.coalesce("sum_closed", F.lit(0.0)), 6).alias("sum_closed"), "best_closed")


@query("jon_16_paired_delay", ctes(TAPE, CALLS, """
f AS (SELECT c.id, d, min_by(t.px, t.blk) AS px FROM calls c, (VALUES (3600), (86400)) v(d)
      JOIN tape t ON t.tok = c.tok AND t.ts >= c.ts + d AND t.ts <= c.ts + d + 172800 GROUP BY ALL)""") + """
SELECT a.id, a.px AS a_value, b.px AS b_value, round(b.px - a.px, 6) AS diff FROM f a JOIN f b ON a.id = b.id AND a.d = 3600 AND b.d = 86400""")
def _(spark, sf):
    t = tape(spark, sf)
    c = calls(spark, sf).select("id", "tok", "ts", F.explode(F.array(F.lit(3600), F.lit(86400))).alias("d"))
    c = c.withColumn("at", F.col("ts") + F.col("d"))
    fills = J.asof_forward(c, t, ["tok"], tol=2 * D, left_ts="at", tie=["blk"], columns=["ts", "px"])
    fills = fills.filter("r is not null").select("id", "d", F.col("r.px").alias("px"))
    out = J.paired(fills.filter("d = 3600"), fills.filter("d = 86400"), ["id"], "px")
    return out.withColumn("diff", F.round("diff", 6))


@query("jon_17_semi_anti", """
SELECT 'known' AS part, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS key_sum FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
UNION ALL SELECT 'unknown', count(*), CAST(sum(o_custkey) AS BIGINT) FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    c = table(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("k"))
    agg = lambda d, n: d.agg(F.lit(n).alias("part"), F.count("*").alias("n"), F.sum("k").alias("key_sum"))
    return agg(J.keep_known(o, c, ["k"]), "known").unionByName(agg(J.drop_known(o, c, ["k"]), "unknown"))


@query("jon_18_audit_join", ctes(TRADES) + """
SELECT t.cell, count(*) AS trades, count(a.f) AS covered, CAST(sum(coalesce(a.f, 0)) AS BIGINT) AS flagged
FROM trades t LEFT JOIN (SELECT c_custkey AS tok, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS f
                         FROM customer WHERE c_mktsegment <> 'BUILDING') a USING (tok) GROUP BY t.cell""")
def _(spark, sf):
    a = table(spark, sf, "customer").filter("c_mktsegment <> 'BUILDING'").select(
        F.col("c_custkey").alias("tok"), (F.col("c_acctbal") < 0).alias("f"))
    return J.audit_join(trades(spark, sf), a, ["tok"], "f", ["cell"])
