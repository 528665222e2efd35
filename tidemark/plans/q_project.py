"""Queries of the projection family and of the tape sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.functions.scalar import DAY
from tidemark.operators import project as P
from tidemark.plans.registry import query
from tidemark.plans.standins import CALLS, TAPE, TRADES, calls, ctes, table, tape, trades
from tidemark.session import ensure_checkpoint_dir
from tidemark.sources import tape as R
from tidemark.sources import verify as V

D = DAY
T0 = 1704067200
END = 1706745600

V4 = """v4 AS (
  SELECT ts, blk, li, tok, pool, side, CAST(CAST(usd AS BIGINT) AS VARCHAR) AS liquidity, usd / 10 AS depth1_eth, px / 2000 AS price_eth,
         px, usd, CASE WHEN pool = 'click' THEN 'ETH' WHEN pool = 'view' THEN 'USDG' ELSE 'WETH' END AS quote,
         CASE WHEN pool IN ('click', 'view') THEN 'v4' ELSE 'v2' END AS kind FROM tape)"""


def v4(spark, sf):
    p = F.col("pool")
    return tape(spark, sf).select(
        "ts", "blk", "li", "tok", "pool", "side", F.col("usd").cast("long").cast("string").alias("liquidity"),
        (F.col("usd") / 10).alias("depth1_eth"), (F.col("px") / 2000).alias("price_eth"), "px", "usd",
        F.when(p == "click", "ETH").when(p == "view", "USDG").otherwise("WETH").alias("quote"),
        F.when(p.isin("click", "view"), "v4").otherwise("v2").alias("kind"))


@query("prj_01_usable_v4", ctes(TAPE, V4) + """
SELECT blk, tok, CASE WHEN quote = 'ETH' THEN 'WETH' ELSE quote END AS quote, liquidity FROM v4
WHERE liquidity <> '0' AND depth1_eth > 0 AND price_eth > 0""")
def _(spark, sf):
    return P.usable_v4(v4(spark, sf)).select("blk", "tok", "quote", "liquidity")


@query("prj_02_size_floor", ctes(TAPE, V4) + "SELECT blk, kind, usd FROM v4 WHERE (kind = 'v4' AND usd >= 1) OR (kind <> 'v4' AND usd >= 10)")
def _(spark, sf):
    return P.size_floor(v4(spark, sf)).select("blk", "kind", "usd")


LABELS = """lab AS (SELECT c_custkey AS tok, CASE WHEN c_mktsegment = 'BUILDING' THEN 'unknown' WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS pad FROM customer),
fb AS (SELECT c_custkey AS tok, n_name AS pad FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1)"""


@query("prj_03_universe", ctes(TAPE, LABELS) + """
SELECT t.blk, t.tok, coalesce(lab.pad, fb.pad) AS pad FROM tape t LEFT JOIN lab USING (tok) LEFT JOIN fb USING (tok)
WHERE coalesce(lab.pad, fb.pad) IS NOT NULL AND coalesce(lab.pad, fb.pad) <> 'unknown'""")
def _(spark, sf):
    c = table(spark, sf, "customer")
    lab = c.select(F.col("c_custkey").alias("tok"), F.when(F.col("c_mktsegment") == "BUILDING", "unknown").when(
        F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("pad"))
    fb = c.join(table(spark, sf, "nation").filter("n_regionkey = 1"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("tok"), F.col("n_name").alias("pad"))
    return P.universe(tape(spark, sf), lab, fb).select("blk", "tok", "pad")


@query("prj_04_label_pool", """
WITH h AS (SELECT p_brand AS hook, min(p_type) AS pad FROM part WHERE p_size > 45 GROUP BY 1),
v AS (SELECT p_type AS venue, count(*)::VARCHAR AS pad FROM part GROUP BY 1)
SELECT p_partkey AS pool, coalesce(h.pad, v.pad) AS pad FROM part LEFT JOIN h ON h.hook = p_brand AND p_size > 40 LEFT JOIN v ON v.venue = p_type""")
def _(spark, sf):
    p = table(spark, sf, "part")
    hooks = p.filter("p_size > 45").groupBy(F.col("p_brand").alias("hook")).agg(F.min("p_type").alias("pad"))
    venues = p.groupBy(F.col("p_type").alias("venue")).agg(F.count("*").cast("string").alias("pad"))
    pools = p.select(F.col("p_partkey").alias("pool"), F.when(F.col("p_size") > 40, F.col("p_brand")).alias("hook"), F.col("p_type").alias("venue"))
    return P.label_pool(pools, hooks, venues).select("pool", "pad")


@query("prj_05_orient", """
WITH pools AS (SELECT p_partkey AS pool, CASE p_type WHEN 'ECONOMY' THEN 'ETH' WHEN 'SMALL' THEN 'WETH' WHEN 'PROMO' THEN 'USDG' ELSE p_brand END AS c0,
    CASE WHEN p_size % 5 = 0 THEN 'USDG' ELSE split_part(p_name, ' ', 2) END AS c1 FROM part),
f AS (SELECT c, count(*) AS n FROM (SELECT c0 AS c FROM pools UNION ALL SELECT c1 FROM pools) GROUP BY c),
named AS (SELECT DISTINCT p_brand AS c FROM part WHERE p_retailprice > 1050),
pins AS (SELECT p_partkey AS pool, split_part(p_name, ' ', 2) AS quote FROM part WHERE p_size > 48),
r AS (SELECT p.*, CASE c0 WHEN 'ETH' THEN 0 WHEN 'WETH' THEN 1 WHEN 'USDG' THEN 2 ELSE 3 END AS r0,
        CASE c1 WHEN 'ETH' THEN 0 WHEN 'WETH' THEN 1 WHEN 'USDG' THEN 2 ELSE 3 END AS r1, f0.n AS n0, f1.n AS n1,
        c0 IN (SELECT c FROM named) AS t0, c1 IN (SELECT c FROM named) AS t1, pins.quote AS pin
      FROM pools p JOIN f f0 ON f0.c = c0 JOIN f f1 ON f1.c = c1 LEFT JOIN pins USING (pool)),
q AS (SELECT *, CASE WHEN pin IN (c0, c1) THEN pin WHEN t0 AND NOT t1 THEN c1 WHEN t1 AND NOT t0 THEN c0
        WHEN r0 < r1 THEN c0 WHEN r1 < r0 THEN c1 WHEN n1 > n0 THEN c1 ELSE c0 END AS quote FROM r)
SELECT pool, quote, CASE WHEN quote = c0 THEN c1 ELSE c0 END AS token FROM q""")
def _(spark, sf):
    p = table(spark, sf, "part")
    word = F.split("p_name", " ")[1]
    ty = F.col("p_type")
    pools = p.select(F.col("p_partkey").alias("pool"), F.when(ty == "ECONOMY", "ETH").when(ty == "SMALL", "WETH").when(
        ty == "PROMO", "USDG").otherwise(F.col("p_brand")).alias("c0"),
        F.when(F.col("p_size") % 5 == 0, "USDG").otherwise(word).alias("c1"))
    named = p.filter("p_retailprice > 1050").select(F.col("p_brand").alias("tok"))
    pins = p.filter("p_size > 48").select(F.col("p_partkey").alias("pool"), word.alias("quote"))
    return P.orient(pools, named, pins).select("pool", "quote", "token")


@query("prj_06_price_from_sqrt", """
WITH s AS (SELECT l_orderkey, l_linenumber, (floor(l_extendedprice) + 1) / 1000.0 AS root, l_returnflag = 'A' AS is0,
   CAST(l_quantity * 1e6 AS BIGINT) AS lq, CASE WHEN l_linestatus = 'O' THEN -1 ELSE 1 END * CAST(l_quantity * 100 AS BIGINT) AS amt FROM lineitem)
SELECT l_orderkey, l_linenumber, round(log10(CASE WHEN is0 THEN root * root ELSE 1 / (root * root) END * 1e2), 8) AS log_price,
  round(lq * CASE WHEN is0 THEN root ELSE 1 / root END * (sqrt(1.01) - 1) / 1e6, 6) AS depth1,
  CASE WHEN amt < 0 THEN 'buy' WHEN amt > 0 THEN 'sell' ELSE 'none' END AS side, round(abs(amt) / 1e8, 8) AS amount_token FROM s""")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    # the root price scaled by 2^96 as text, as raw logs carry it
    root = (F.floor(F.col("l_extendedprice")) + 1) / F.lit(1000.0)
    raw = li.select(
        "l_orderkey", "l_linenumber", (F.col("l_returnflag") == "A").alias("is0"),
        (root * F.pow(F.lit(2.0), F.lit(96))).cast("string").alias("sp"),
        F.round(F.col("l_quantity") * 1e6).cast("long").cast("string").alias("lq"),
        (F.when(F.col("l_linestatus") == "O", -1).otherwise(1) * F.round(F.col("l_quantity") * 100).cast("long")).cast("string").alias("a0"),
        F.lit("5").alias("a1"), F.lit(8).alias("dt"), F.lit(6).alias("dq"))
    out = P.price_from_sqrt(raw, "sp", "lq", "dt", "dq", F.col("is0"), "a0", "a1")
    return out.select("l_orderkey", "l_linenumber", F.round(F.log10("price_quote"), 8).alias("log_price"), F.round("depth1", 6).alias("depth1"),
                      "side", F.round("amount_token", 8).alias("amount_token"))


@query("prj_07_usd_and_eth", """
WITH s AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 977 * l_discount AS pe, l_quantity * l_discount * 1731.7 AS u FROM lineitem)
SELECT l_orderkey, l_linenumber,
  CASE WHEN pe = 0 THEN 0 ELSE floor(pe * pow(10, 6 - floor(log10(pe))) + 0.5) / pow(10, 6 - floor(log10(pe))) END::DOUBLE AS price_eth,
  CASE WHEN u = 0 THEN 0 ELSE floor(u * pow(10, 6 - floor(log10(u))) + 0.5) / pow(10, 6 - floor(log10(u))) END::DOUBLE AS usd FROM s""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 977).alias("price_quote"), F.col("l_discount").alias("quote_eth"),
        F.col("l_quantity").alias("amount_quote"), F.lit(1731.7).alias("eth_usd"))
    return P.usd_and_eth(li).select("l_orderkey", "l_linenumber", "price_eth", "usd")


@query("prj_08_signif", ctes(TAPE) + """
SELECT blk, CASE WHEN px = 0 THEN 0 ELSE floor(px * pow(10, 1 - floor(log10(px))) + 0.5) / pow(10, 1 - floor(log10(px))) END::DOUBLE AS px2 FROM tape""")
def _(spark, sf):
    return tape(spark, sf).select("blk", S.signif(F.col("px"), 2).alias("px2"))


@query("prj_09_band", ctes(TAPE) + """
SELECT CAST(CASE WHEN px < 1 THEN 0 WHEN px < 10 THEN 1 WHEN px < 25 THEN 2 WHEN px < 100 THEN 3 ELSE 4 END AS INT) AS band, count(*) AS n, max(px) AS hi
FROM tape GROUP BY 1""")
def _(spark, sf):
    return tape(spark, sf).groupBy(S.band(F.col("px"), [1, 10, 25, 100]).alias("band")).agg(F.count("*").alias("n"), F.max("px").alias("hi"))


@query("prj_10_halves_eras", ctes(TAPE) + f"""
SELECT CASE WHEN ts < {T0 + 15 * D} THEN 'FIT' ELSE 'JUDGE' END AS half,
  CASE WHEN ts >= {T0 + 20 * D} THEN 'late' WHEN ts >= {T0 + 7 * D} THEN 'mid' ELSE 'pre' END AS era, (ts // {D}) * {D} AS day,
  strftime(make_timestamp(ts * 1000000), '%Y-%m') AS month, count(*) AS n FROM tape GROUP BY ALL""")
def _(spark, sf):
    t = F.col("ts")
    return tape(spark, sf).groupBy(
        S.half_of(t, T0 + 15 * D).alias("half"), S.era_of(t, [(T0 + 7 * D, "mid"), (T0 + 20 * D, "late")]).alias("era"),
        S.day_of("ts").alias("day"), S.month_of("ts").alias("month")).agg(F.count("*").alias("n"))


@query("prj_12_person_creators", """
WITH t AS (SELECT o_orderkey AS tok, o_custkey AS creator FROM orders), m AS (SELECT creator, count(*) AS made FROM t GROUP BY 1 HAVING count(*) <= 9)
SELECT tok, creator, made FROM t JOIN m USING (creator)""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("tok"), F.col("o_custkey").alias("creator"))
    return P.person_creators(o, 9).select("tok", "creator", "made")


@query("prj_13_quote_class_filter", ctes(TAPE, V4) + """
, q AS (SELECT blk, CASE WHEN pool = 'error' THEN 'XYZ' WHEN pool = 'signup' THEN NULL ELSE quote END AS eQ FROM v4)
SELECT 'eq' AS view, blk, eQ FROM q WHERE eQ IS NULL OR eQ IN ('ETH', 'WETH', 'USDG') UNION ALL SELECT 'full', blk, eQ FROM q""")
def _(spark, sf):
    q = v4(spark, sf).select("blk", F.when(F.col("pool") == "error", "XYZ").when(F.col("pool") != "signup", F.col("quote")).alias("eQ"))
    one = lambda m: P.quote_class_filter(q, m).select(F.lit(m).alias("view"), "blk", "eQ")
    return one("eq").unionByName(one("full"))


CALL_CELLS = [
    {"cell": 1, "delay": 60, "want_tier": None, "want_first": None, "want_age": None, "want_mcap": None},
    {"cell": 2, "delay": 3600, "want_tier": "good", "want_first": None, "want_age": "old", "want_mcap": None},
    {"cell": 3, "delay": 86400, "want_tier": None, "want_first": True, "want_age": None, "want_mcap": "low,mid"},
]


@query("prj_14_cell_filter", ctes(TAPE, CALLS, f"""
c AS (SELECT id, ts, CASE WHEN caller < 3 THEN 'good' ELSE 'other' END AS tier,
   row_number() OVER (PARTITION BY tok ORDER BY ts, id) = 1 AS first, CASE WHEN ts >= {T0 + 10 * D} THEN 'old' ELSE 'new' END AS age_band,
   CASE WHEN call_px < 5 THEN 'low' WHEN call_px < 20 THEN 'mid' ELSE 'high' END AS mcap_band, ts + chat * 30000 AS mcap_ts FROM calls)""") + """
SELECT 1 AS cell, id FROM c UNION ALL SELECT 2, id FROM c WHERE tier = 'good' AND age_band = 'old'
UNION ALL SELECT 3, id FROM c WHERE first AND mcap_band IN ('low', 'mid') AND mcap_ts <= ts + 86400""")
def _(spark, sf):
    from tidemark.operators.features import rank_on_key
    c = rank_on_key(calls(spark, sf), "tok", "rk")
    px = F.col("call_px")
    c = c.select("id", "ts", F.when(F.col("caller") < 3, "good").otherwise("other").alias("tier"), (F.col("rk") == 1).alias("first"),
                 F.when(F.col("ts") >= T0 + 10 * D, "old").otherwise("new").alias("age_band"),
                 F.when(px < 5, "low").when(px < 20, "mid").otherwise("high").alias("mcap_band"),
                 (F.col("ts") + F.col("chat") * 30000).alias("mcap_ts"))
    return P.cell_filter(P.with_cells(c, CALL_CELLS)).select("cell", "id")


@query("prj_15_split_cells", ctes(TRADES) + """
, f AS (SELECT * FROM (VALUES ('1-URGENT', 'u_dip', 90, NULL), ('1-URGENT', 'u_sells', NULL, 4), ('2-HIGH', 'h_both', 30, 2)) v(base, cell, d, s)),
x AS (SELECT pair, cell AS base, CASE WHEN reason <> 'O' THEN tok % 200 END AS dip_sec, (SELECT count(*) FROM lineitem WHERE l_orderkey = pair) AS n_sells FROM trades)
SELECT f.cell, x.pair FROM x JOIN f USING (base) WHERE (d IS NULL OR dip_sec >= d) AND (s IS NULL OR n_sells >= s)""")
def _(spark, sf):
    n = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("pair")).agg(F.count("*").alias("n_sells"))
    t = trades(spark, sf).join(n, "pair", "left").select(
        "pair", "cell", F.when(F.col("reason") != "O", F.col("tok") % 200).alias("dip_sec"), F.coalesce("n_sells", F.lit(0)).alias("n_sells"))
    f = spark.createDataFrame([("1-URGENT", "u_dip", 90, None), ("1-URGENT", "u_sells", None, 4), ("2-HIGH", "h_both", 30, 2)],
                              "base string, cell string, min_dip_sec int, min_sells int")
    return P.split_cells(t, f).select("cell", "pair")


@query("prj_16_static_fee", """
SELECT p_partkey, CASE WHEN p_size <> 50 AND p_size * 20500 < 1000000 THEN round(p_size * 20500 / 1e6, 9) END AS fee FROM part""")
def _(spark, sf):
    p = table(spark, sf, "part")
    pips = F.when(F.col("p_size") == 50, F.lit(8388608)).otherwise(F.col("p_size") * 20500)
    return p.select("p_partkey", F.round(S.static_fee(pips), 9).alias("fee"))


@query("prj_18_depth_band", ctes(TRADES) + """
, x AS (SELECT pair, half, CASE WHEN reason <> 'O' THEN ret + 100 END AS depth FROM trades),
c AS (SELECT quantile_cont(depth, 1.0 / 3) AS c1, quantile_cont(depth, 2.0 / 3) AS c2 FROM x WHERE half = 'FIT')
SELECT half, CASE WHEN depth IS NULL THEN 'v23' WHEN depth < c1 THEN 'low' WHEN depth < c2 THEN 'mid' ELSE 'high' END AS depth_band, count(*) AS n
FROM x, c GROUP BY ALL""")
def _(spark, sf):
    x = trades(spark, sf).select("half", F.when(F.col("reason") != "O", F.col("ret") + 100).alias("depth"))
    return P.depth_band(x, "depth", "half").groupBy("half", "depth_band").agg(F.count("*").alias("n"))


# ---- sources ------------------------------------------------------------------------------------------------

def _json_tape(spark, sf):
    """The tape written as line JSON by event type, error rows cut short, in the shared folder; returns the path."""
    path = f"{ensure_checkpoint_dir(spark)}/tape-{uuid.uuid4().hex}"
    t = v4(spark, sf)
    line = F.to_json(F.struct("ts", "blk", "li", F.col("tok").cast("string").alias("tok"), "pool", "quote", F.col("px").alias("price_usd"),
                              "price_eth", "usd", "side", "liquidity", "depth1_eth"))
    t.select("pool", F.when(F.col("pool") == "error", F.substring(line, 1, 40)).otherwise(line).alias("value")).write.partitionBy("pool").text(path)
    return path


@query("src_01_read_tape", ctes(TAPE) + """
SELECT pool, count(*) AS lines, CAST(sum(CASE WHEN pool = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS bad,
       CASE WHEN pool = 'error' THEN NULL ELSE CAST(sum(ts) AS BIGINT) END AS ts_sum FROM tape GROUP BY pool""")
def _(spark, sf):
    df = R.read_tape(spark, _json_tape(spark, sf), "v4").withColumn("pool", F.regexp_extract("file", r"pool=([a-z]+)", 1))
    bad = (F.col("_corrupt_record").isNotNull() | F.col("ts").isNull()).cast("int")
    return df.groupBy("pool").agg(F.count("*").alias("lines"), F.sum(bad).alias("bad"),
                                  F.sum(F.when(F.col("_corrupt_record").isNull(), F.col("ts"))).alias("ts_sum"))


@query("src_02_conform_v4", ctes(TAPE, V4) + "SELECT blk, px, 'v4' AS kind, 'v4:' || pool AS pk, depth1_eth FROM v4")
def _(spark, sf):
    return R.conform_v4(v4(spark, sf).withColumnRenamed("px", "price_usd")).select("blk", "px", "kind", "pk", "depth1_eth")


@query("src_03_merge_rails", ctes(TAPE, V4) + """
SELECT blk, ts, tok, kind, CASE WHEN kind = 'v4' THEN depth1_eth END AS depth1_eth, lag(blk) OVER (PARTITION BY tok ORDER BY ts, blk) AS prev_blk FROM v4""")
def _(spark, sf):
    from tidemark.operators.slicing import running
    t = v4(spark, sf)
    m = R.merge_rails(t.filter("kind = 'v2'").drop("depth1_eth"), t.filter("kind = 'v4'"))
    out = running(m, ["tok"], ["ts", "blk", "li"], {"prev_blk": ("last", F.col("blk"))}, S.bucket("ts", 5 * D), False)
    return out.select("blk", "ts", "tok", "kind", "depth1_eth", "prev_blk")


@query("src_04_dedupe_union", """
WITH u AS (SELECT l_orderkey AS k, 0 AS s, l_extendedprice AS v, l_linenumber AS o FROM lineitem WHERE l_returnflag = 'R'
  UNION ALL SELECT l_orderkey, 1, l_extendedprice, l_linenumber FROM lineitem
  UNION ALL SELECT o_orderkey, 2, o_totalprice, 0 FROM orders)
SELECT k, arg_min(v, (s, o, v)) AS v, count(*) AS copies FROM u GROUP BY k""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_extendedprice").alias("v"), F.col("l_linenumber").alias("o"), "l_returnflag")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), F.lit(0).alias("o"))
    out = R.dedupe_union([li.filter("l_returnflag = 'R'").drop("l_returnflag"), li.drop("l_returnflag"), o], ["k"], ["o", "v"])
    return out.select("k", "v", "copies")


@query("src_05_time_cut", ctes(TAPE) + f"SELECT blk, ts FROM tape WHERE ts >= {T0 + 3 * D} AND ts < {T0 + 20 * D}")
def _(spark, sf):
    return R.time_cut(tape(spark, sf), T0 + 3 * D, T0 + 20 * D).select("blk", "ts")


@query("src_05_time_cut_report", f"""
WITH o AS (SELECT o_orderkey AS k, epoch_us(o_orderdate) // 1000000 AS ts FROM orders),
w AS (SELECT *, lag(ts) OVER (ORDER BY k) AS p, max(ts) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM o)
SELECT count(*) FILTER (ts >= 820454400 AND ts < 946684800) AS kept, count(*) FILTER (ts < 820454400) AS before,
  count(*) FILTER (ts >= 946684800) AS after, count(*) FILTER (ts < p) AS inversions, max(greatest(coalesce(m - ts, 0), 0)) AS max_late FROM w""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), S.epoch_s("o_orderdate").alias("ts"))
    return R.time_cut_report(o, 820454400, 946684800, "k", slice_len=4000)


@query("src_06_assert_sealed", ctes(TAPE) + "SELECT count(*) AS n, max(ts) AS last_ts FROM tape")
def _(spark, sf):
    return R.assert_sealed(tape(spark, sf), ["ts"], END).agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))


@query("src_07_file_inventory")
def _(spark, sf):
    path = _json_tape(spark, sf)
    found = V.inventory(spark, path, r"pool=([a-z]+)/")
    reg = found.filter("name <> 'view'").withColumn(
        "sha256", F.when(F.col("name") == "click", F.lit("0")).otherwise(F.col("sha256"))).dropDuplicates(["name"])
    return V.compare_inventory(found, reg)


LINES = """lines AS (SELECT event_type AS file, CASE WHEN k < 5 THEN '  ' WHEN k < 10 THEN '{"ts": ' WHEN k < 15 THEN '[1, 2]'
   WHEN k < 20 THEN '{"x": 1}' WHEN k < 25 THEN '{"ts": "12"}' WHEN k < 30 THEN '{"ts": true, "x": 2}'
   ELSE '{"ts": ' || ts || ', "k": ' || k || '}' END AS line
 FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, epoch_us(ts) // 1000000 AS ts FROM events))"""


def _lines(spark, sf):
    k = F.col("usd").cast("long")
    txt = F.concat(F.lit('{"ts": '), F.col("ts"), F.lit(', "k": '), k, F.lit("}"))
    return tape(spark, sf).select(F.col("pool").alias("file"), F.when(k < 5, "  ").when(k < 10, '{"ts": ').when(k < 15, "[1, 2]").when(
        k < 20, '{"x": 1}').when(k < 25, '{"ts": "12"}').when(k < 30, '{"ts": true, "x": 2}').otherwise(txt).alias("line"))


@query("src_08_profile_lines", "WITH " + LINES + f"""
, c AS (SELECT file, CASE WHEN trim(line) = '' THEN 'empty' WHEN NOT json_valid(line) THEN 'unparsable' WHEN json_type(line) <> 'OBJECT' THEN 'not_object'
   WHEN coalesce(json_type(line, '$.ts'), 'NULL') NOT IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN 'no_time' ELSE 'fine' END AS cls, line FROM lines),
t AS (SELECT *, CASE WHEN cls = 'fine' THEN CAST(json_extract_string(line, '$.ts') AS DOUBLE) END AS t FROM c)
SELECT file, count(*) AS lines, count(*) FILTER (cls = 'empty') AS empty, count(*) FILTER (cls = 'unparsable') AS unparsable,
  count(*) FILTER (cls = 'not_object') AS not_object, count(*) FILTER (cls = 'no_time') AS no_time, count(*) FILTER (cls = 'fine') AS fine,
  min(t) AS min_t, max(t) AS max_t, count(*) FILTER (t >= {T0 + 25 * D}) AS sealed FROM t GROUP BY file""")
def _(spark, sf):
    return V.profile_lines(_lines(spark, sf), "file", "line", T0 + 25 * D)


@query("src_08_key_sets", "WITH " + LINES + """
SELECT array_to_string(list_sort(json_keys(line)), ',') AS key_set, count(*) AS n FROM lines
WHERE json_valid(line) AND json_type(line) = 'OBJECT' GROUP BY 1""")
def _(spark, sf):
    return V.key_sets(_lines(spark, sf).filter("trim(line) like '{%}'"), "line")


@query("src_09_kv_json", ctes(TAPE) + "SELECT pool AS key, usd AS a, px AS b, count(*) AS n FROM tape GROUP BY ALL")
def _(spark, sf):
    t = tape(spark, sf).select(F.to_json(F.create_map(F.col("pool"), F.array("usd", "px"))).alias("value"))
    got = V.explode_kv(t, "value", "array<double>")
    return got.groupBy("key", F.col("value")[0].alias("a"), F.col("value")[1].alias("b")).agg(F.count("*").alias("n"))


@query("src_09_read_kv_json", ctes(TAPE) + f"""
SELECT CAST(blk AS VARCHAR) AS key, usd AS a, px AS b FROM tape""")
def _(spark, sf):
    path = f"{ensure_checkpoint_dir(spark)}/kv-{uuid.uuid4().hex}"
    by = F.floor(F.col("blk") / 1000)  # an object a file, of at most a thousand keys
    pairs = F.map_from_entries(F.collect_list(F.struct(F.col("blk").cast("string"), F.array("usd", "px"))))
    objects = tape(spark, sf).groupBy(by.alias("f")).agg(F.to_json(pairs).alias("value"))
    objects.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return V.read_kv_json(spark, path, "array<double>").select("key", F.col("value")[0].alias("a"), F.col("value")[1].alias("b"))


@query("src_10_min_birth", """
SELECT tok, min(b) AS birth_ts FROM (SELECT o_custkey AS tok, epoch_us(o_orderdate) // 1000000 AS b FROM orders
  UNION ALL SELECT user_id, epoch_us(ts) // 1000000 FROM events
  UNION ALL SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 900000000 + CAST(floor(c_acctbal) AS BIGINT) END FROM customer) WHERE b IS NOT NULL GROUP BY tok""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("tok"), S.epoch_s("o_orderdate").alias("birth_ts"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("tok"), F.when(
        F.col("c_acctbal") > 0, 900000000 + F.floor("c_acctbal").cast("long")).alias("birth_ts"))
    return R.min_birth(o, tape(spark, sf).select("tok", F.col("ts").alias("birth_ts")), c)


@query("src_11_write_trades", ctes(TRADES) + "SELECT cell, count(*) AS n, round(sum(ret), 4) AS ret_sum FROM trades GROUP BY cell")
def _(spark, sf):
    path = f"{ensure_checkpoint_dir(spark)}/trades-{uuid.uuid4().hex}"
    R.write_trades(trades(spark, sf), path)
    return spark.read.parquet(path).groupBy("cell").agg(F.count("*").alias("n"), F.round(F.sum("ret"), 4).alias("ret_sum"))


@query("src_11_write_results", ctes(TRADES) + "SELECT cell, half, count(*) AS n, count(DISTINCT tok) AS coins FROM trades GROUP BY ALL")
def _(spark, sf):
    path = f"{ensure_checkpoint_dir(spark)}/results-{uuid.uuid4().hex}"
    R.write_results(trades(spark, sf).groupBy("cell", "half").agg(F.count("*").alias("n"), F.count_distinct("tok").alias("coins")), path, ["cell", "half"])
    doc = F.from_json("value", "cell string, half string, result struct<n: bigint, coins: bigint>").alias("d")
    return spark.read.text(path).select(doc).select("d.cell", "d.half", "d.result.n", "d.result.coins")


@query("src_12_upsert_store", """
WITH n AS (SELECT o_custkey AS fam, o_orderkey AS row, o_orderpriority AS batch FROM orders WHERE o_orderstatus = 'F'),
l AS (SELECT n.fam, n.row FROM n JOIN (SELECT fam, max(batch) AS b FROM n GROUP BY fam) m ON m.fam = n.fam AND n.batch = m.b)
SELECT fam, row FROM l UNION ALL SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_custkey NOT IN (SELECT fam FROM n)""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("fam"), F.col("o_orderkey").alias("row"), F.col("o_orderpriority").alias("batch"), "o_orderstatus")
    out = R.upsert_store(o.filter("o_orderstatus <> 'F'").drop("o_orderstatus"), o.filter("o_orderstatus = 'F'").drop("o_orderstatus"), ["fam"], "batch")
    return out.select("fam", "row")
