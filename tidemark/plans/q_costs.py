"""Queries of the cost family: line items as trade sides, parts as pools, suppliers and nations as lookup tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalar import DAY, bucket
from tidemark.operators import costs as K
from tidemark.plans.registry import query
from tidemark.plans.standins import TAPE, ctes, table, tape

D = DAY
T0 = 1704067200
S1 = K.S1
GAS2 = 100 * (2 * 8.97e-06 + 0.0941 * 7.509e-06 + 0.1908 * 7.509e-06)


def rnd(df, digits, *cols):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("cst_01_classify_pool", """
WITH rc AS (SELECT l_partkey AS pool, min(l_returnflag) AS type, min(l_tax) AS take FROM lineitem WHERE l_quantity > 48 AND l_discount > 0.08 GROUP BY 1),
tb AS (SELECT p_partkey AS pool, p_type AS type, p_size / 1000.0 AS take FROM part WHERE p_size < 10),
hk AS (SELECT p_brand AS hook, 'h' || count(*) AS type, 0.03 AS take FROM part WHERE p_size > 42 AND p_type = 'PROMO' GROUP BY 1), vn AS (SELECT p_type AS venue, 'v' || count(*) AS type, min(p_size / 5000.0) AS take FROM part WHERE p_retailprice > 1080 GROUP BY 1)
SELECT p_partkey AS pool, CASE WHEN rc.type IS NOT NULL THEN 'receipt' WHEN tb.type IS NOT NULL THEN 'table' WHEN hk.type IS NOT NULL THEN 'hook' WHEN vn.type IS NOT NULL THEN 'venue' ELSE 'unknown' END AS cost_src,
  coalesce(rc.type, tb.type, hk.type, vn.type, 'unknown') AS type, round(CASE WHEN rc.type IS NOT NULL THEN rc.take WHEN tb.type IS NOT NULL THEN tb.take WHEN hk.type IS NOT NULL THEN hk.take ELSE vn.take END::DOUBLE, 6) AS take
FROM part LEFT JOIN rc ON rc.pool = p_partkey LEFT JOIN tb ON tb.pool = p_partkey LEFT JOIN hk ON hk.hook = p_brand LEFT JOIN vn ON vn.venue = p_type""")
def _(spark, sf):
    p, li = table(spark, sf, "part"), table(spark, sf, "lineitem")
    rc = li.filter("l_quantity > 48 and l_discount > 0.08").groupBy(F.col("l_partkey").alias("pool")).agg(F.min("l_returnflag").alias("type"), F.min("l_tax").alias("take"))
    tb = p.filter("p_size < 10").select(F.col("p_partkey").alias("pool"), F.col("p_type").alias("type"), (F.col("p_size") / 1000.0).alias("take"))
    hk = p.filter("p_size > 42 and p_type = 'PROMO'").groupBy(F.col("p_brand").alias("hook")).agg(F.concat(F.lit("h"), F.count("*")).alias("type"), F.lit(0.03).alias("take"))
    vn = p.filter("p_retailprice > 1080").groupBy(F.col("p_type").alias("venue")).agg(F.concat(F.lit("v"), F.count("*")).alias("type"), F.min(F.col("p_size") / 5000.0).alias("take"))
    pools = p.select(F.col("p_partkey").alias("pool"), F.col("p_brand").alias("hook"), F.col("p_type").alias("venue"))
    return rnd(K.classify_pool(pools, rc, tb, hk, vn), 6, "take").select("pool", "cost_src", "type", "take")


@query("cst_02_ex_ante_take", """
WITH p AS (SELECT p_partkey AS pool, CASE WHEN p_type = 'SMALL' THEN 'v2' ELSE 'v4' END AS kind, p_type = 'PROMO' AS is_launch, CASE WHEN p_size < 40 THEN p_size / 2000.0 END AS terms,
   CASE WHEN p_size > 45 THEN NULL WHEN p_size > 30 THEN 8388608 ELSE p_size * 600 END AS pips, CASE WHEN p_retailprice > 1000 THEN p_retailprice / 120000 END AS est FROM part),
t AS (SELECT *, CASE WHEN kind = 'v4' THEN CASE WHEN is_launch THEN terms WHEN pips IS NULL THEN NULL WHEN pips < 1000000 THEN pips / 1e6 ELSE est END END AS tk FROM p)
SELECT pool, round(tk::DOUBLE, 9) AS ex_take, CASE WHEN kind <> 'v4' THEN 'V23' WHEN tk IS NULL THEN 'UNK' WHEN tk <= 0.01 + 1e-9 THEN 'LOW' ELSE 'HIGH' END AS take_band FROM t""")
def _(spark, sf):
    s = F.col("p_size")
    p = table(spark, sf, "part").select(
        F.col("p_partkey").alias("pool"), F.when(F.col("p_type") == "SMALL", "v2").otherwise("v4").alias("kind"), (F.col("p_type") == "PROMO").alias("is_launch"),
        F.when(s < 40, s / 2000.0).alias("terms"), F.when(s > 45, None).when(s > 30, 8388608).otherwise(s * 600).alias("pips"),
        F.when(F.col("p_retailprice") > 1000, F.col("p_retailprice") / 120000).alias("est"))
    return rnd(K.ex_ante_take(p, "kind", "terms", "is_launch", "pips", "est"), 9, "ex_take").select("pool", "ex_take", "take_band")


@query("cst_03_tax", """
WITH t AS (SELECT c_custkey AS tok, CASE WHEN c_mktsegment = 'BUILDING' THEN 'unknown' ELSE 'known' END AS status, CASE WHEN c_acctbal > 0 THEN c_acctbal / 1e5 END AS b, c_nationkey / 500.0 AS s,
   CASE WHEN c_nationkey < 20 THEN 0.02 END AS e FROM customer WHERE c_acctbal < 9000)
SELECT o_orderkey, round(CASE WHEN status IS NULL THEN 0 WHEN status = 'unknown' THEN coalesce(e, 0) ELSE coalesce(b, 0) END::DOUBLE, 9) AS tax_buy,
  round(CASE WHEN status IS NULL THEN 0 WHEN status = 'unknown' THEN coalesce(e, 0) ELSE coalesce(s, 0) END::DOUBLE, 9) AS tax_sell FROM orders LEFT JOIN t ON tok = o_custkey""")
def _(spark, sf):
    c = table(spark, sf, "customer").filter("c_acctbal < 9000").select(
        F.col("c_custkey").alias("tok"), F.when(F.col("c_mktsegment") == "BUILDING", "unknown").otherwise("known").alias("status"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") / 1e5).alias("buy"), (F.col("c_nationkey") / 500.0).alias("sell"), F.when(F.col("c_nationkey") < 20, 0.02).alias("expected_tax"))
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("tok"))
    return rnd(K.tax(o, c), 9, "tax_buy", "tax_sell").select("o_orderkey", "tax_buy", "tax_sell")


SIDE = """s AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'N' THEN 'v2' ELSE 'v4' END AS kind, CASE WHEN l_linestatus = 'O' THEN 'buy' ELSE 'sell' END AS side, l_extendedprice AS px,
  l_quantity / 5 AS depth, l_tax / 5 AS fee, l_discount / 4 AS take, l_discount / 50 AS imp, CASE WHEN l_quantity > 10 THEN l_quantity / 1e4 END AS ipe FROM lineitem)"""


def _sides(spark, sf):
    li = table(spark, sf, "lineitem")
    c = F.col
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.when(c("l_returnflag") == "N", "v2").otherwise("v4").alias("kind"), F.when(c("l_linestatus") == "O", "buy").otherwise("sell").alias("side"),
        c("l_extendedprice").alias("px"), (c("l_quantity") / 5).alias("depth"), (c("l_tax") / 5).alias("fee"), (c("l_discount") / 4).alias("take"), (c("l_discount") / 50).alias("imp"),
        F.when(c("l_quantity") > 10, c("l_quantity") / 1e4).alias("ipe"))


@query("cst_04_cost_per_side", "WITH " + SIDE + """
SELECT l_orderkey, l_linenumber, round(fee + CASE WHEN kind = 'v4' THEN take + imp ELSE greatest(coalesce(ipe, 0) * 0.7, imp) END + 0.001, 9) AS cost FROM s""")
def _(spark, sf):
    c = F.col
    x = K.cost_per_side(c("kind"), c("fee"), c("take"), c("imp"), c("ipe"), F.lit(0.7), F.lit(0.001))
    return _sides(spark, sf).select("l_orderkey", "l_linenumber", F.round(x, 9).alias("cost"))


@query("cst_05_depth_impact", "WITH " + SIDE + f"""
SELECT l_orderkey, l_linenumber, round(px * CASE WHEN kind = 'v4' THEN (1 + 0.7 * {S1!r} / depth) * (1 + fee) ELSE CASE WHEN side = 'sell' THEN (1 + fee) / (1 - fee) ELSE 1 END * 1.004 END, 4) AS buy_px,
  round(px * CASE WHEN kind = 'v4' THEN (1 - fee) / (1 + 0.6 * {S1!r} / depth) ELSE CASE WHEN side = 'buy' THEN (1 - fee) / (1 + fee) ELSE 1 END * 0.996 END, 4) AS sell_px FROM s""")
def _(spark, sf):
    c = F.col
    b = K.buy_price(c("kind"), c("px"), c("side"), F.lit(0.7), c("depth"), c("fee"))
    s = K.sell_price(c("kind"), c("px"), c("side"), F.lit(0.6), c("depth"), c("fee"))
    return _sides(spark, sf).select("l_orderkey", "l_linenumber", F.round(b, 4).alias("buy_px"), F.round(s, 4).alias("sell_px"))


@query("cst_06_constant_product", "WITH " + SIDE + """
, n AS (SELECT *, 0.7 * (1 - fee) / (px * (1 + 0.7 * (1 - fee) / depth)) AS n FROM s), v AS (SELECT *, n * (1 - take) * px * 1.07 AS v FROM n)
SELECT l_orderkey, l_linenumber, round(v / (1 + v / (depth * 2)) / 0.7, 9) AS multiple FROM v""")
def _(spark, sf):
    c = F.col
    x = K.constant_product(F.lit(0.7), c("fee"), c("px"), c("depth"), c("take"), c("px") * 1.07, c("depth") * 2)
    return _sides(spark, sf).select("l_orderkey", "l_linenumber", F.round(x, 9).alias("multiple"))


ROUTE = """st AS (SELECT l_orderkey AS id, CASE l_returnflag WHEN 'N' THEN 'direct' WHEN 'A' THEN 'first' ELSE 'second' END AS leg, CASE WHEN l_tax < 0.08 THEN l_tax / 5 END AS fee, l_quantity / 5 AS depth,
  100 + l_discount * 150 AS px FROM lineitem),
rf AS (SELECT id, leg, arg_max(px, (depth, px)) AS ref FROM st GROUP BY ALL),
ok AS (SELECT st.*, (1 + fee) * (1 + 0.05 * {s1} / depth) AS mb, (1 - fee) / (1 + 0.05 * {s1} / depth) AS ms FROM st JOIN rf ON rf.id = st.id AND rf.leg = st.leg WHERE fee IS NOT NULL AND depth > 0 AND abs(px / ref - 1) <= 0.10),
lg AS (SELECT id, leg, {agg}(m{x}) AS m FROM ok GROUP BY ALL),
rt AS (SELECT id, max(m) FILTER (leg = 'direct') AS direct, max(m) FILTER (leg = 'first') * max(m) FILTER (leg = 'second') AS via FROM lg GROUP BY id)"""


def _states(spark, sf):
    c = F.col
    return table(spark, sf, "lineitem").select(
        c("l_orderkey").alias("id"), F.when(c("l_returnflag") == "N", "direct").when(c("l_returnflag") == "A", "first").otherwise("second").alias("leg"),
        F.when(c("l_tax") < 0.08, c("l_tax") / 5).alias("fee"), (c("l_quantity") / 5).alias("depth"), (100 + c("l_discount") * 150).alias("px"), F.lit(0.05).alias("size"))


@query("cst_07_hop_route", "WITH " + ROUTE.format(s1=repr(S1), agg="min", x="b") + """
SELECT id, round(CASE WHEN direct IS NULL THEN via WHEN via IS NULL THEN direct ELSE least(direct, via) END, 9) AS mult,
  CASE WHEN direct IS NOT NULL AND (via IS NULL OR direct <= via) THEN 'direct' WHEN via IS NOT NULL THEN 'via_usdg' END AS route, round(direct, 9) AS mult_direct FROM rt""")
def _(spark, sf):
    both = K.hop_route(_states(spark, sf), ["id"], "buy", "size", allow_usdg=True)
    one = K.hop_route(_states(spark, sf), ["id"], "buy", "size").select("id", F.col("mult").alias("mult_direct"))
    return rnd(both.join(one, "id"), 9, "mult", "mult_direct").select("id", "mult", "route", "mult_direct")


@query("cst_08_hop_apply", "WITH " + ROUTE.format(s1=repr(S1), agg="max", x="s") + f"""
SELECT o_orderkey, round((net + {GAS2!r} / 0.02 + 100) * CASE WHEN direct IS NULL THEN via WHEN via IS NULL THEN direct ELSE greatest(direct, via) END / 1.011 - 100 - {GAS2!r} / 0.02 - 100 * 8.97e-06 / 0.02, 6) AS net_hop
FROM (SELECT o_orderkey, (o_totalprice - 240000) / 2503 AS net FROM orders) LEFT JOIN rt ON id = o_orderkey""")
def _(spark, sf):
    rt = K.hop_route(_states(spark, sf), ["id"], "sell", "size", allow_usdg=True).select(F.col("id").alias("o_orderkey"), "mult")
    o = table(spark, sf, "orders").select("o_orderkey", ((F.col("o_totalprice") - 240000) / 2503).alias("net")).join(rt, "o_orderkey", "left")
    return o.select("o_orderkey", F.round(K.hop_apply(F.col("net"), F.lit(0.02), F.lit(1.011), F.col("mult")), 6).alias("net_hop"))


@query("cst_09_static_hop", """
SELECT p_partkey, coalesce(s.b, 1.02) AS hop_buy, coalesce(s.s, 1.02) AS hop_sell, CASE WHEN s.b IS NULL THEN 'fallback' ELSE 'token' END AS hop_src
FROM part LEFT JOIN (SELECT s_suppkey AS q, 1 + s_nationkey / 1000.0::DOUBLE AS b, 1 - s_nationkey / 2000.0::DOUBLE AS s FROM supplier WHERE s_acctbal > 3000) s ON q = p_size""")
def _(spark, sf):
    s = table(spark, sf, "supplier").filter("s_acctbal > 3000").select(F.col("s_suppkey").cast("int").alias("p_size"), (1 + F.col("s_nationkey") / 1000.0).alias("buy"), (1 - F.col("s_nationkey") / 2000.0).alias("sell"))
    return K.static_hop(table(spark, sf, "part"), s, "p_size", F.lit(1.02)).select("p_partkey", "hop_buy", "hop_sell", "hop_src")


@query("cst_10_gas_pts", ctes(TAPE) + f"SELECT blk, round({GAS2!r} / (50 / (2000 + px)), 9) AS gas FROM tape")
def _(spark, sf):
    return tape(spark, sf).select("blk", F.round(K.gas_pts(50 / (2000 + F.col("px"))), 9).alias("gas"))


@query("cst_11_eth_booking", ctes(TAPE, """
se AS (SELECT (ts // 21600) * 21600 AS x, 1800 + avg(px) AS y FROM tape WHERE pool = 'click' GROUP BY 1),
n AS (SELECT x, y, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1 FROM se),
pos AS (SELECT blk, ts, ts + 200000 AS xt, px, px * 1.1 + usd / 100 AS xp FROM tape WHERE pool = 'view'),
e AS (SELECT blk, CASE WHEN n.x IS NULL THEN (SELECT arg_min(y, x) FROM se) WHEN x1 IS NULL THEN y ELSE y + (y1 - y) * (ts - n.x) / (x1 - n.x) END AS ee FROM pos ASOF LEFT JOIN n ON pos.ts >= n.x),
z AS (SELECT blk, CASE WHEN n.x IS NULL THEN (SELECT arg_min(y, x) FROM se) WHEN x1 IS NULL THEN y ELSE y + (y1 - y) * (xt - n.x) / (x1 - n.x) END AS ez FROM pos ASOF LEFT JOIN n ON pos.xt >= n.x)""") + """
SELECT blk, round(xp / nullif(px, 0) * ee / ez, 6) AS gross_eth FROM pos JOIN e USING (blk) JOIN z USING (blk)""")
def _(spark, sf):
    t = tape(spark, sf)
    series = t.filter("pool = 'click'").groupBy((bucket("ts", 21600) * 21600).alias("ts")).agg((1800 + F.avg("px")).alias("v"))
    pos = t.filter("pool = 'view'").select("blk", "ts", (F.col("ts") + 200000).alias("xt"), "px", (F.col("px") * 1.1 + F.col("usd") / 100).alias("xp"))
    return rnd(K.eth_booking(pos, series, "ts", "xt", "px", "xp"), 6, "gross_eth").select("blk", "gross_eth")


_NET = "100 * ({g} * (1 - (cs - si)) / (1 + si) / ((1 + (cb - bi)) * (1 + bi)) - 1) - gas"
_HOP = ("CASE WHEN q THEN ({n} + gas + 100) * coalesce({s}, (1 - hf{u}) / (1 + hi{u} * greatest(0.01, ({n} + 100) / 100))) / hob{u} - 100 - gas - hg ELSE {n} END")
VIEW = f"""v AS (SELECT o_orderkey, 1 + (o_totalprice - 240000) / 250300 AS g, 1 + (o_totalprice - 200000) / 250300 AS gt, 1 + (o_totalprice - 220000) / 250300 AS gl, 1 + (o_totalprice - 210000) / 250300 AS gl9,
  0.01 + (o_custkey % 7) / 500.0 AS cb, (o_custkey % 3) / 400.0 AS bi, 0.012 + (o_custkey % 5) / 400.0 AS cs, (o_custkey % 4) / 500.0 AS si, 0.011 AS mb, 0.016 AS ms,
  o_orderstatus = 'F' AS hb, o_orderstatus = 'P' AS hs, 0.02 AS clip, o_custkey % 9 > 0 AS q, o_orderpriority = '5-LOW' AS fb,
  CASE WHEN o_custkey % 6 > 0 THEN 1.004 END AS hob, 0.003 AS hf, 0.001 AS hi, CASE WHEN o_custkey % 5 > 0 THEN 0.993 END AS s60, CASE WHEN o_custkey % 5 > 1 THEN 0.992 END AS str,
  CASE WHEN o_custkey % 5 > 2 THEN 0.991 END AS sl, 0.99 AS sl9, 1.003 AS hob_u, 0.002 AS hf_u, 0.0005 AS hi_u, CASE WHEN o_custkey % 4 > 0 THEN 0.994 END AS su FROM orders),
gs AS (SELECT *, {GAS2!r} / clip AS gas, 100 * 8.97e-06 / clip AS hg FROM v),
r AS (SELECT *, {_NET.format(g='g')} AS r60, {_NET.format(g='gt')} AS rt, {_NET.format(g='gl')} AS l0, {_NET.format(g='gl9')} AS l9 FROM gs),
z AS (SELECT *, CASE WHEN fb THEN least(rt, 0) ELSE l0 END AS lat, CASE WHEN fb THEN least(rt, 0) ELSE l9 END AS lat90 FROM r),
x AS (SELECT *, 100 * (g * (1 - ms) / (1 + mb) - 1) - 0.2 AS meas, 100 * (gt * (1 - ms) / (1 + mb) - 1) - 0.2 AS meas_trig,
  100 * (g * (1 - greatest(ms, 0.014) - hs::INT * 0.01) / (1 + greatest(mb, 0.014) + hb::INT * 0.01) - 1) - 0.2 AS heavy, r60 AS real60, rt AS realtrig,
  {_HOP.format(n='r60', s='s60', u='')} AS real60h, {_HOP.format(n='rt', s='str', u='')} AS realtrigh, {_HOP.format(n='lat', s='sl', u='')} AS lath,
  {_HOP.format(n='lat90', s='sl9', u='')} AS lat90h, {_HOP.format(n='r60', s='su', u='_u')} AS real60u FROM z)"""
NAMES = ["meas", "meas_trig", "heavy", "real60", "realtrig", "lat", "lat90", "real60h", "realtrigh", "lath", "lat90h", "real60u"]


@query("cst_12_views", "WITH " + VIEW + " " + " UNION ALL ".join(
    f"SELECT o_orderkey, '{n}' AS view, round((CASE WHEN fb AND {n} > 0 THEN 0 ELSE {n} END)::DOUBLE, 6) AS ret FROM x" for n in NAMES))
def _(spark, sf):
    c, p = F.col("o_custkey"), F.col("o_totalprice")
    g = lambda z: 1 + (p - z) / 250300
    if_over = lambda m, k, v: F.when(c % m > k, v)
    df = table(spark, sf, "orders").select(
        "o_orderkey", g(240000).alias("gross"), g(200000).alias("gross_trig"), g(220000).alias("gross_lat"), g(210000).alias("gross_lat90"),
        (0.01 + (c % 7) / 500.0).alias("cost_buy"), ((c % 3) / 400.0).alias("impact_buy"), (0.012 + (c % 5) / 400.0).alias("cost_sell"), ((c % 4) / 500.0).alias("impact_sell"),
        F.lit(0.011).alias("model_buy"), F.lit(0.016).alias("model_sell"), (F.col("o_orderstatus") == "F").alias("hook_buy"), (F.col("o_orderstatus") == "P").alias("hook_sell"),
        F.lit(0.02).alias("clip_eth"), (c % 9 > 0).alias("quoted"), (F.col("o_orderpriority") == "5-LOW").alias("fallback"),
        if_over(6, 0, 1.004).alias("hop_buy"), F.lit(0.003).alias("hop_fee"), F.lit(0.001).alias("hop_impact"), if_over(5, 0, 0.993).alias("hop_sell_60"),
        if_over(5, 1, 0.992).alias("hop_sell_trig"), if_over(5, 2, 0.991).alias("hop_sell_lat"), F.lit(0.99).alias("hop_sell_lat90"),
        F.lit(1.003).alias("hop_buy_u"), F.lit(0.002).alias("hop_fee_u"), F.lit(0.0005).alias("hop_impact_u"), if_over(4, 0, 0.994).alias("hop_sell_u"))
    return K.views(df).select("o_orderkey", "view", F.round("ret", 6).alias("ret"))


@query("cst_13_heavy", "WITH " + SIDE + """
SELECT l_orderkey, l_linenumber, round(100 * (px * 1.1 * (1 - greatest(take, 0.014) - (side = 'buy')::INT * 0.01) / (px * (1 + greatest(fee, 0.014) + (kind = 'v4')::INT * 0.01)) - 1) - 0.2, 6) AS heavy FROM s""")
def _(spark, sf):
    c = F.col
    x = K.heavy(c("px") * 1.1, c("px"), c("fee"), c("take"), c("kind") == "v4", c("side") == "buy")
    return _sides(spark, sf).select("l_orderkey", "l_linenumber", F.round(x, 6).alias("heavy"))


@query("cst_14_real_vs_old", """
WITH s AS (SELECT l_returnflag AS f, round(l_extendedprice / (l_quantity * 2000), 4) AS booked, l_extendedprice / (l_quantity * 2000) + CASE WHEN l_discount = 0.05 THEN 0.001 ELSE 0 END AS r FROM lineitem)
SELECT f, count(*) AS n, count(*) FILTER (abs(booked - r) > 2e-4) AS missed FROM s GROUP BY f""")
def _(spark, sf):
    c = F.col
    li = table(spark, sf, "lineitem").withColumn("booked", F.round(c("l_extendedprice") / (c("l_quantity") * 2000), 4))
    out = K.real_vs_old(li, "booked", c("l_extendedprice") / (c("l_quantity") * 2000) + F.when(c("l_discount") == 0.05, 0.001).otherwise(0.0))
    return out.groupBy(c("l_returnflag").alias("f")).agg(F.count("*").alias("n"), F.count_if(~c("reproduced")).alias("missed"))


@query("cst_15_rederive_check", """
WITH s AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS a, l_quantity * p_retailprice AS b, l_discount AS d, CASE WHEN l_tax > 0 THEN l_discount END AS d2 FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT count(*) AS rows, count(*) FILTER (abs(a - b) > 1e-6 * greatest(1, abs(a), abs(b))) AS bad_price, count(*) FILTER (coalesce(abs(d - d2) > 1e-6, true)) AS bad_disc,
  (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS dup_keys FROM s""")
def _(spark, sf):
    c = F.col
    li = table(spark, sf, "lineitem").join(table(spark, sf, "part").select(c("p_partkey").alias("l_partkey"), "p_retailprice"), "l_partkey")
    return K.rederive_check(li, {"price": (c("l_extendedprice"), c("l_quantity") * c("p_retailprice")), "disc": (c("l_discount"), F.when(c("l_tax") > 0, c("l_discount")))},
                            ["l_orderkey", "l_linenumber"])


@query("cst_16_cost_source_counts", """
SELECT o_orderpriority AS cell, side, src, count(*) AS n, round(avg((o_orderstatus = 'P')::INT), 9) AS fallback_share FROM (
  SELECT *, 'buy' AS side, o_orderstatus AS src FROM orders UNION ALL SELECT *, 'sell', CASE WHEN o_totalprice > 250000 THEN 'table' ELSE 'receipt' END FROM orders) GROUP BY ALL""")
def _(spark, sf):
    c = F.col
    o = table(spark, sf, "orders").select(c("o_orderpriority").alias("cell"), c("o_orderstatus").alias("b"), F.when(c("o_totalprice") > 250000, "table").otherwise("receipt").alias("s"),
                                          (c("o_orderstatus") == "P").alias("fb"))
    return rnd(K.cost_source_counts(o, ["cell"], {"buy": "b", "sell": "s"}, "fb"), 9, "fallback_share")


@query("cst_17_static_route_medians", ctes(TAPE, f"""
tk AS (SELECT c_custkey AS tok FROM customer), sp AS (SELECT tok, t AS ts FROM tk, (SELECT unnest(range({T0 + D}, {T0 + 29 * D} + 1, {3 * D})) AS t)),
st AS (SELECT sp.tok, sp.ts, r.pool, arg_max(r.usd, r.blk) AS usd FROM sp JOIN tape r ON r.tok = sp.tok AND r.ts <= sp.ts AND r.ts >= sp.ts - {2 * D} GROUP BY ALL),
m AS (SELECT tok, ts, min(1.003 * (1 + 0.05 * {S1!r} / (usd + 1))) AS m FROM st GROUP BY ALL), p AS (SELECT tok, count(*) AS moments, median(m) AS buy FROM m GROUP BY tok)""") + """
SELECT tk.tok, moments, round(coalesce(buy, (SELECT median(buy) FROM p)), 9) AS buy, CASE WHEN buy IS NULL THEN 'fallback' ELSE 'token' END AS hop_src FROM tk LEFT JOIN p USING (tok)""")
def _(spark, sf):
    tk = table(spark, sf, "customer").select(F.col("c_custkey").alias("tok"))
    t = tape(spark, sf).withColumn("usd", F.col("usd") + 1)
    return rnd(K.static_route_medians(tk, t, 3 * D, T0 + D, T0 + 29 * D, F.lit(0.003), "usd", 0.05, 2 * D), 9, "buy").select("tok", "moments", "buy", "hop_src")


@query("cst_18_median_with_fallback", """
WITH rc AS (SELECT l_partkey AS pool, p_type AS type, l_tax + l_discount / 7 AS v FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_type <> 'SMALL'),
a AS (SELECT pool, median(v) AS v FROM rc GROUP BY 1), b AS (SELECT type, median(v) AS v FROM rc GROUP BY 1)
SELECT p_partkey AS pool, round(coalesce(a.v, b.v, 0.01), 9) AS value, CASE WHEN a.v IS NOT NULL THEN 'pool' WHEN b.v IS NOT NULL THEN 'type' ELSE 'constant' END AS value_src
FROM part LEFT JOIN a ON a.pool = p_partkey LEFT JOIN b ON b.type = p_type""")
def _(spark, sf):
    c = F.col
    p = table(spark, sf, "part").select(c("p_partkey").alias("pool"), c("p_type").alias("type"))
    rc = table(spark, sf, "lineitem").select(c("l_partkey").alias("pool"), (c("l_tax") + c("l_discount") / 7).alias("v")).join(p.filter("type <> 'SMALL'"), "pool")
    return rnd(K.median_with_fallback(p, rc, "v", 0.01), 9, "value").select("pool", "value", "value_src")
