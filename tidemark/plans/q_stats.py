"""Queries of the aggregation and inference families over trades (orders), twins (line items) and calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalar import DAY, band
from tidemark.operators import aggregate as A
from tidemark.operators import joins as J
from tidemark.operators import stats as S
from tidemark.operators.clean import order_audit, stream_holes
from tidemark.plans.registry import query
from tidemark.plans.standins import CALLS, SPLIT, TAPE, TRADES, TWINS, calls, ctes, table, tape, trades, twins

D = DAY
T0 = 1704067200

T2 = """t AS (SELECT *, day // 30 AS mon, CAST(tok % 11 AS BIGINT) AS caller, CASE reason WHEN 'F' THEN 'XYZ' WHEN 'O' THEN 'WETH' END AS quote FROM trades)"""


def t2(spark, sf):
    r = F.col("reason")
    return trades(spark, sf).withColumn("mon", F.floor(F.col("day") / 30)).withColumn("caller", F.col("tok") % 11).withColumn(
        "quote", F.when(r == "F", "XYZ").when(r == "O", "WETH"))


TW = """w AS (SELECT pair, avg(CASE WHEN tw = 'A' THEN twin_ret END) AS twin_a FROM twins GROUP BY pair),
tp AS (SELECT t.*, w.twin_a FROM t JOIN w USING (pair))"""


def tp(spark, sf):
    return J.twin_pairs(t2(spark, sf), twins(spark, sf), "pair", "tw", "twin_ret", ["A"]).withColumnRenamed("twin_A", "twin_a")


def rnd(df, digits, *cols):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("agg_11_concentration", ctes(TRADES, T2, """
c AS (SELECT cell, tok, sum(ret) AS s, max(ret) AS m FROM t GROUP BY ALL), d AS (SELECT cell, mon, sum(ret) AS s FROM t GROUP BY ALL),
z AS (SELECT cell, sum(s) AS total, count(*) AS coins, count(*) FILTER (m >= 90) AS hit_coins, arg_max(tok, (s, -tok)) AS top_coin, max(s) AS ts FROM c GROUP BY cell)""") + """
SELECT cell, round(total, 4) AS total, coins, hit_coins, top_coin, CASE WHEN total > 0 THEN round(ts / total, 6) END AS top_coin_share,
  (SELECT arg_max(mon, (s, -mon)) FROM d WHERE d.cell = z.cell) AS best_day, CASE WHEN total > 0 THEN round((SELECT max(s) FROM d WHERE d.cell = z.cell) / total, 6) END AS best_day_share FROM z""")
def _(spark, sf):
    return rnd(A.concentration(t2(spark, sf), ["cell"], "tok", "mon", "ret", 90), 6, "top_coin_share", "best_day_share").withColumn("total", F.round("total", 4))


@query("agg_12_shares", ctes(TRADES) + """
SELECT cell, count(*) AS n, round(avg((ret > 0)::INT), 9) AS win, round(avg((ret <= -50)::INT), 9) AS crash, round(avg((reason = 'P')::INT), 9) AS stop FROM trades GROUP BY cell""")
def _(spark, sf):
    out = A.shares(trades(spark, sf), ["cell"], {"win": F.col("ret") > 0, "crash": F.col("ret") <= -50, "stop": F.col("reason") == "P"})
    return rnd(out, 9, "win", "crash", "stop")


@query("agg_13_reason_counts", ctes(TRADES) + "SELECT cell, reason, count(*) AS n FROM trades GROUP BY ALL")
def _(spark, sf):
    m = A.reason_counts(trades(spark, sf), ["cell"], "reason")
    return m.select("cell", F.explode("counts").alias("reason", "n"))


@query("agg_14_coverage", ctes(TRADES, T2, """
r AS (SELECT half, caller::VARCHAR AS lane, CASE WHEN reason = 'F' THEN 'v4' ELSE 'v23' END AS rail, (ret > -80)::INT AS f, (ret > -60)::INT AS p FROM t),
u AS (SELECT 'ALL' AS scope, * FROM r UNION ALL SELECT 'half=' || half, * FROM r UNION ALL SELECT 'lane=' || lane, * FROM r
      UNION ALL SELECT 'ex-outage', * FROM r WHERE lane <> '3')""") + """
SELECT scope, count(*) AS n, CAST(sum(f) AS BIGINT) AS filled, CAST(sum(p) AS BIGINT) AS priced, CAST(sum(CASE WHEN rail = 'v4' THEN p ELSE 0 END) AS BIGINT) AS priced_v4,
  round(avg(p), 9) AS priced_share FROM u GROUP BY scope""")
def _(spark, sf):
    d = t2(spark, sf).withColumn("lane", F.col("caller").cast("string")).withColumn("rail", F.when(F.col("reason") == "F", "v4").otherwise("v23"))
    return rnd(A.coverage(d, ["half", "lane"], F.col("ret") > -80, F.col("ret") > -60, "rail", F.col("lane") == "3"), 9, "priced_share")


@query("agg_15_unpriced_reason", ctes(TRADES, T2) + """
SELECT cell, CASE WHEN quote = 'XYZ' THEN 'other quote' WHEN quote IS NULL THEN 'no quote' WHEN ret < -80 THEN 'thin' ELSE 'unexplained' END AS why, count(*) AS n
FROM t WHERE ret < -20 GROUP BY ALL""")
def _(spark, sf):
    d = t2(spark, sf).filter("ret < -20")
    return A.unpriced_reason(d, ["cell"], [("other quote", F.col("quote") == "XYZ"), ("no quote", F.col("quote").isNull()), ("thin", F.col("ret") < -80)])


GATE = """g AS (SELECT cell, half, CASE WHEN caller < 5 THEN 'S' WHEN caller < 8 THEN 'WR' ELSE 'WA' END AS role,
   CASE WHEN ret > -85 THEN 'booked' WHEN ret > -90 THEN 'nofill' WHEN ret > -93 THEN 'trunc' ELSE 'skip' END AS status, (ret > 80)::INT AS fb,
   (ret BETWEEN 0 AND 20)::INT + (reason = 'F' AND ret > 0)::INT AS small, (ret > 103.9)::INT AS g5 FROM t),
p AS (SELECT cell, half, role, count(*) FILTER (status = 'booked') AS bk, count(*) FILTER (status IN ('booked', 'nofill', 'trunc')) AS dr,
   coalesce(sum(fb) FILTER (status = 'booked'), 0) AS fb, coalesce(sum(small) FILTER (status = 'booked'), 0) AS sm, sum(g5) AS g5 FROM g GROUP BY ALL),
k AS (SELECT *, CASE WHEN dr > 0 THEN (bk - fb) / dr END AS ps, CASE WHEN bk > 0 THEN sm / (2 * bk) END AS ss FROM p)"""


@query("agg_16_data_gate", ctes(TRADES, T2, GATE) + """
SELECT cell, half, CAST(sum(dr) AS BIGINT) AS draws, CAST(sum(bk) AS BIGINT) AS booked, round(max(ps) FILTER (role = 'S'), 9) AS priced_share,
  CASE WHEN coalesce(max(ps) FILTER (role = 'S'), 0) >= 0.6 THEN 'PASS' ELSE 'FAIL' END AS G1, CASE WHEN coalesce(max(ss) FILTER (role = 'S'), 0) < 0.2 THEN 'PASS' ELSE 'FAIL' END AS G4,
  CASE WHEN sum(g5) = 0 THEN 'PASS' ELSE 'FAIL' END AS G5, CASE WHEN count(*) FILTER (role <> 'S' AND dr > 0 AND NOT (coalesce(ps, 0) >= 0.6 AND coalesce(ss, 0) < 0.2)) = 0 THEN 'PASS' ELSE 'FAIL' END AS G10
FROM k GROUP BY cell, half""")
def _(spark, sf):
    c, r = F.col("caller"), F.col("ret")
    d = t2(spark, sf).select(
        "cell", "half", F.when(c < 5, "S").when(c < 8, "WR").otherwise("WA").alias("role"),
        F.when(r > -85, "booked").when(r > -90, "nofill").when(r > -93, "trunc").otherwise("skip").alias("status"), (r > 80).alias("fallback"),
        (r.between(0, 20).cast("int") + ((F.col("reason") == "F") & (r > 0)).cast("int")).alias("small"), (r > 103.9).cast("int").alias("g5_fail"))
    return rnd(A.data_gate(d, ["cell", "half"], "role"), 9, "priced_share")


@query("agg_17_gate_meta", ctes(TAPE, "a AS (SELECT *, lag(ts) OVER (PARTITION BY pool ORDER BY blk) AS p FROM tape)", "o AS (SELECT ts, lag(ts) OVER (ORDER BY ts) AS p FROM (SELECT DISTINCT ts FROM tape))") + f"""
SELECT (SELECT count(*) FROM a WHERE ts < p) AS inversions, (SELECT max(ts) FROM tape) AS last_ts, (SELECT count(*) FROM o WHERE ts - p >= 21600) AS holes,
  (SELECT count(DISTINCT ts // {D}) FROM tape) AS days, (SELECT max(ts // {D}) - min(ts // {D}) + 1 - count(DISTINCT ts // {D}) FROM tape) AS empty_days,
  CASE WHEN (SELECT count(*) FROM a WHERE ts < p) = 0 AND (SELECT count(*) FROM o WHERE ts - p >= 21600) = 0
    AND (SELECT max(ts // {D}) - min(ts // {D}) + 1 - count(DISTINCT ts // {D}) FROM tape) = 0 AND (SELECT max(ts) FROM tape) >= {T0 + 30 * D} - 3600 THEN 'PASS' ELSE 'FAIL' END AS G2""")
def _(spark, sf):
    t = tape(spark, sf)
    days = t.select(F.floor(F.col("ts") / D).alias("day")).distinct()
    return A.gate_meta(order_audit(t, "pool", "blk"), stream_holes(t, 21600), days, T0 + 30 * D)


@query("agg_18_slices", ctes(TRADES) + """
SELECT half, cell, reason, count(ret) AS n, round(avg(ret), 6) AS mean, round(stddev_samp(ret), 6) AS sd FROM trades
GROUP BY GROUPING SETS ((half), (cell), (reason), (half, cell), (half, reason), (cell, reason), ())""")
def _(spark, sf):
    return rnd(A.slices(trades(spark, sf), ["half", "cell", "reason"], "ret"), 6, "mean", "sd")


@query("agg_19_top_k_drop", ctes(TRADES, """
r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY ret DESC, pair) AS rk FROM trades),
c AS (SELECT cell, tok, sum(ret) AS s, avg(ret) AS m FROM trades GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY s DESC, tok) AS rs, row_number() OVER (PARTITION BY cell ORDER BY m DESC, tok) AS rm FROM c)""") + """
SELECT r.cell, count(*) AS n, round(avg(ret) FILTER (rk > 5), 6) AS drop_trades, round(avg(ret) FILTER (rs > 5), 6) AS drop_coins_sum, round(avg(ret) FILTER (rm > 5), 6) AS drop_coins_mean
FROM r JOIN k ON k.cell = r.cell AND k.tok = r.tok GROUP BY r.cell""")
def _(spark, sf):
    return rnd(A.top_k_drop(trades(spark, sf), ["cell"], "ret", 5, "tok", "pair"), 6, "drop_trades", "drop_coins_sum", "drop_coins_mean")


@query("agg_20_no_repeats", ctes(TRADES) + """
SELECT cell, tok, pair, ts, round(ret, 6) AS ret FROM (SELECT *, row_number() OVER (PARTITION BY cell, tok ORDER BY ts, pair) AS rk FROM trades) WHERE rk = 1""")
def _(spark, sf):
    return A.no_repeats(trades(spark, sf), ["cell"], "tok", "ts", "pair").select("cell", "tok", "pair", "ts", F.round("ret", 6).alias("ret"))


@query("agg_21_eq_view", ctes(TRADES, T2, "u AS (SELECT 'full' AS view, * FROM t UNION ALL SELECT 'eq', * FROM t WHERE quote IS NULL OR quote IN ('ETH', 'WETH', 'USDG'))") + """
SELECT cell, view, count(ret) AS n, count(DISTINCT tok) AS coins, round(avg(ret), 6) AS mean, round(median(ret), 6) AS median FROM u GROUP BY cell, view""")
def _(spark, sf):
    return rnd(A.eq_view(t2(spark, sf), ["cell"], "ret", "quote", "tok", ("ETH", "WETH", "USDG")), 6, "mean", "median")


@query("agg_22_distincts", ctes(TRADES, T2) + "SELECT cell, count(*) AS n, count(DISTINCT tok) AS n_tok, count(DISTINCT day) AS n_day, count(DISTINCT caller) AS n_caller FROM t GROUP BY cell")
def _(spark, sf):
    return A.distincts(t2(spark, sf), ["cell"], ["tok", "day", "caller"])


@query("agg_23_outliers", ctes(TRADES, """
r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY ret DESC, pair) AS b, row_number() OVER (PARTITION BY cell ORDER BY ret, pair) AS w FROM trades)""") + """
SELECT cell, 'best' AS side, CAST(b AS INT) AS rank, pair, tok FROM r WHERE b <= 10 UNION ALL SELECT cell, 'worst', CAST(w AS INT), pair, tok FROM r WHERE w <= 10""")
def _(spark, sf):
    return A.outliers(trades(spark, sf), ["cell"], "ret", "pair", 10).select("cell", "side", "rank", "pair", "tok")


@query("agg_24_overlap_share", ctes(TRADES, f"x AS (SELECT *, ts + (pair % 40) * {D} AS e, lead(ts) OVER (PARTITION BY cell, tok ORDER BY ts, pair) AS nx FROM trades)") + """
SELECT cell, count(*) AS n, round(avg(coalesce(nx < e, false)::INT), 9) AS overlap FROM x GROUP BY cell""")
def _(spark, sf):
    d = trades(spark, sf).withColumn("e", F.col("ts") + (F.col("pair") % 40) * D)
    return rnd(A.overlap_share(d, ["cell"], "tok", "ts", "e", "pair", 400 * D), 9, "overlap")


@query("agg_25_funnel", ctes(TRADES) + """
SELECT cell, half, count(*) FILTER (reason = 'F') AS F, count(*) FILTER (reason = 'O') AS O, count(*) FILTER (reason = 'P') AS P, count(*) FILTER (reason = 'X') AS X FROM trades GROUP BY ALL""")
def _(spark, sf):
    return A.funnel(trades(spark, sf), ["cell", "half"], "reason", ["F", "O", "P", "X"])


@query("agg_26_prepass_histograms", ctes(TAPE, f"""
g AS (SELECT tok, ts // {D} AS d, count(DISTINCT usd) AS b, sum(usd) AS v FROM tape GROUP BY ALL)""") + """
SELECT 'buyers' AS feature, CASE WHEN b < 2 THEN '0' WHEN b < 4 THEN '1' ELSE '2' END AS class, count(*) AS n FROM g GROUP BY ALL
UNION ALL SELECT 'volume', CASE WHEN v < 50 THEN '0' WHEN v < 100 THEN '1' WHEN v < 200 THEN '2' ELSE '3' END, count(*) FROM g GROUP BY ALL""")
def _(spark, sf):
    g = tape(spark, sf).groupBy("tok", F.floor(F.col("ts") / D).alias("d")).agg(F.count_distinct("usd").alias("b"), F.sum("usd").alias("v"))
    return A.prepass_histograms(g, {"buyers": band(F.col("b"), [2, 4]), "volume": band(F.col("v"), [50, 100, 200])})


@query("agg_27_lag_cdf", ctes(TAPE, CALLS, "l AS (SELECT c.chat, (SELECT min(t.ts) FROM tape t WHERE t.tok = c.tok AND t.ts >= c.ts) - c.ts AS lag FROM calls c)") + f"""
SELECT chat, count(*) AS n, round(avg(coalesce(lag <= {D}, false)::INT), 9) AS within_{D}, round(avg(coalesce(lag <= {3 * D}, false)::INT), 9) AS within_{3 * D},
  round(avg((lag IS NULL)::INT), 9) AS never FROM l GROUP BY chat""")
def _(spark, sf):
    c = J.asof_forward(calls(spark, sf), tape(spark, sf), ["tok"], columns=["ts"]).withColumn("lag", F.col("r.ts") - F.col("ts"))
    return rnd(A.lag_cdf(c, ["chat"], "lag", [D, 3 * D]), 9, f"within_{D}", f"within_{3 * D}", "never")


@query("agg_28_median_series", ctes(TAPE) + "SELECT ts // 21600 AS b, count(px) AS n, round(median(px), 6) AS median FROM tape GROUP BY 1")
def _(spark, sf):
    return rnd(A.median_series(tape(spark, sf), "ts", "px", 21600), 6, "median")


@query("agg_29_holdout_error", ctes(TAPE, f"""
a AS (SELECT min(blk) AS b, min_by(ts, blk) AS t FROM tape GROUP BY ts // {D}),
n AS (SELECT b, t, lead(b) OVER (ORDER BY b) AS b1, lead(t) OVER (ORDER BY b) AS t1, lag(b) OVER (ORDER BY b) AS b0, lag(t) OVER (ORDER BY b) AS t0 FROM a),
x AS (SELECT l.pool, abs(floor(CASE WHEN n.b1 IS NULL THEN n.t0 + (n.t - n.t0) * (l.blk - n.b0) / (n.b - n.b0) ELSE n.t + (n.t1 - n.t) * (l.blk - n.b) / (n.b1 - n.b) END + 0.5) - l.ts) AS e
      FROM tape l ASOF JOIN n ON l.blk >= n.b)""") + """
SELECT pool, count(*) AS n, round(quantile_cont(e, 0.5), 4) AS err_p50, round(quantile_cont(e, 0.9), 4) AS err_p90, CAST(max(e) AS DOUBLE) AS err_max FROM x GROUP BY pool""")
def _(spark, sf):
    t = tape(spark, sf)
    anchors = t.groupBy(F.floor(F.col("ts") / D).alias("d")).agg(F.min("blk").alias("blk"), F.min_by("ts", "blk").alias("ts"))
    est = J.block_time(t.select("blk", "ts", "pool"), anchors.select("blk", "ts"), step=300)
    return rnd(A.holdout_error(est, "block_ts", "ts", ["pool"]), 4, "err_p50", "err_p90")


@query("agg_30_drift", ctes(TRADES, T2, "x AS (SELECT half || caller AS era, tok, (ret + 100) AS size, day % 3 AS level FROM t)") + """
SELECT era, count(*) AS n, count(DISTINCT tok) AS coins, round(avg(level), 9) AS mean_level, round((list_sort(list(size)))[count(*) // 2 + 1], 6) AS twin_median FROM x GROUP BY era""")
def _(spark, sf):
    d = t2(spark, sf).select(F.concat("half", F.col("caller").cast("string")).alias("era"), "tok", (F.col("ret") + 100).alias("size"), (F.col("day") % 3).alias("level"))
    return rnd(rnd(A.drift(d, "era", "tok", "size", "level"), 9, "mean_level"), 6, "twin_median")


# ---- inference ----------------------------------------------------------------------------------------------

#: Resamples, as the rule has them: day blocks; blocks of trades, coins times days; coins; maximum over cells.
B, B_TRADES, B_COINS, B_MAX = 10_000, 4000, 5000, 5000


def _cl(key: str, name: str, src: str = "t", x: str = "ret") -> str:
    return f"""{name} AS (SELECT cell, sqrt(sum(q * q) * count(*) / (count(*) - 1)) / sum(c) AS se FROM (
  SELECT s.cell, {key}, sum({x} - m) AS q, count(*) AS c FROM {src} s JOIN (SELECT cell, avg({x}) AS m FROM {src} GROUP BY cell) USING (cell) GROUP BY ALL) GROUP BY cell)"""


BOOT = f"""u AS (SELECT cell, mon, sum(ret) AS s, count(*) AS c, row_number() OVER (PARTITION BY cell ORDER BY mon) - 1 AS i, count(*) OVER (PARTITION BY cell) AS D FROM t GROUP BY cell, mon),
dr AS (SELECT cell, D, b, (('0x' || substr(md5('bb|' || b || '|' || (p // 2)), 1, 8))::BIGINT % D + p % 2) % D AS i FROM (SELECT DISTINCT cell, D FROM u), range({B}) x(b), LATERAL (SELECT unnest(range(D)) AS p)),
bm AS (SELECT cell, b, sum(s) / greatest(sum(c), 1) AS m, any_value(dr.D) AS D FROM dr JOIN u USING (cell, i) GROUP BY cell, b),
bb AS (SELECT cell, stddev_samp(m) AS se_boot, quantile_cont(m, 0.025) AS boot_lo, quantile_cont(m, 0.975) AS boot_hi, any_value(D) AS units FROM bm GROUP BY cell)"""

PHI = """(1 - 0.5 * (1 + CASE WHEN {z} >= 0 THEN 1 ELSE -1 END * (1 - ((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t} * exp(-({z}) * ({z}) / 2))))"""


def _p(z: str) -> str:
    """Upper normal tail by numeric integration of the density over [z, z + 12], Simpson's rule."""
    y = f"({z} + i * 0.005)"
    return f"(SELECT sum((CASE WHEN i IN (0, 2400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-{y} * {y} / 2)) * 0.005 / 3 / sqrt(2 * pi()) FROM range(2401) s(i))"


@query("sta_01_mean_se", ctes(TRADES) + "SELECT cell, half, count(ret) AS n, round(avg(ret), 6) AS mean, round(stddev_samp(ret) / sqrt(count(ret)), 6) AS se_iid FROM trades GROUP BY ALL")
def _(spark, sf):
    return rnd(S.mean_se(trades(spark, sf), ["cell", "half"], "ret"), 6, "mean", "se_iid")


@query("sta_02_cluster_se", ctes(TRADES, T2, _cl("tok", "a")) + "SELECT cell, round(se, 6) AS se_cluster FROM a")
def _(spark, sf):
    return rnd(S.cluster_se(t2(spark, sf), ["cell"], "ret", "tok"), 6, "se_cluster")


@query("sta_03_block_bootstrap", ctes(TRADES, T2, BOOT) + "SELECT cell, round(se_boot, 6) AS se_boot, round(boot_lo, 6) AS boot_lo, round(boot_hi, 6) AS boot_hi, units FROM bb")
def _(spark, sf):
    return rnd(S.block_bootstrap(t2(spark, sf), ["cell"], "ret", "mon", B), 6, "se_boot", "boot_lo", "boot_hi")


MB = f"""o AS (SELECT cell, ret, row_number() OVER (PARTITION BY cell ORDER BY ts, pair) AS i FROM t), nn AS (SELECT cell, count(*) AS n FROM t GROUP BY cell),
pf AS (SELECT cell, i, sum(ret) OVER (PARTITION BY cell ORDER BY i) AS P FROM o UNION ALL SELECT cell, 0, 0 FROM nn),
bl AS (SELECT cell, n, L, b, k, ('0x' || substr(md5('mb|' || b || '|' || k), 1, 8))::BIGINT % (n - L + 1) AS st, least(L, n - k * L) AS len
  FROM (SELECT cell, n, CAST(ceil(sqrt(n)) AS BIGINT) AS L FROM nn) q, range({B_TRADES}) x(b), LATERAL (SELECT unnest(range(CAST(ceil(n / L) AS BIGINT))) AS k)),
mm AS (SELECT bl.cell, b, sum(z.P - a.P) / any_value(n) AS m FROM bl JOIN pf a ON a.cell = bl.cell AND a.i = st JOIN pf z ON z.cell = bl.cell AND z.i = st + len GROUP BY ALL),
mb AS (SELECT cell, stddev_samp(m) AS se FROM mm GROUP BY cell)"""


@query("sta_04_moving_block_se", ctes(TRADES, T2, MB) + "SELECT cell, round(se, 6) AS se_block FROM mb")
def _(spark, sf):
    return rnd(S.moving_block_se(t2(spark, sf), ["cell"], "ret", ["ts", "pair"], B_TRADES), 6, "se_block")


def _pois(expr: str) -> str:
    cdf = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253]
    u = f"(('0x' || substr(md5({expr}), 1, 8))::BIGINT / 4294967296.0)"
    return "CASE " + " ".join(f"WHEN {u} < {c}::DOUBLE THEN {i}" for i, c in enumerate(cdf)) + " ELSE 8 END"


PG = f"""pw AS (SELECT tok, b, {_pois("'pg|c|' || b || '|' || tok")} AS w FROM (SELECT DISTINCT tok FROM t), range({B_TRADES}) x(b)),
pd AS (SELECT mon, b, {_pois("'pg|d|' || b || '|' || mon")} AS w FROM (SELECT DISTINCT mon FROM t), range({B_TRADES}) x(b)),
pm AS (SELECT cell, b, sum(pw.w * pd.w * ret) / sum(pw.w * pd.w) AS m FROM t JOIN pw USING (tok) JOIN pd USING (mon, b) GROUP BY cell, b HAVING sum(pw.w * pd.w) > 0),
pg AS (SELECT cell, stddev_samp(m) AS se FROM pm GROUP BY cell)"""


@query("sta_05_pigeonhole_se", ctes(TRADES, T2, PG) + "SELECT cell, round(se, 6) AS se_pigeon FROM pg")
def _(spark, sf):
    return rnd(S.pigeonhole_se(t2(spark, sf), ["cell"], "ret", "tok", "mon", B_TRADES), 6, "se_pigeon")


CB = f"""cu AS (SELECT cell, tok, sum(ret) AS s, count(*) AS c, row_number() OVER (PARTITION BY cell ORDER BY tok) - 1 AS i, count(*) OVER (PARTITION BY cell) AS D FROM t GROUP BY cell, tok),
cd AS (SELECT cell, b, ('0x' || substr(md5('cb|' || b || '|' || i), 1, 8))::BIGINT % D AS i FROM cu, range({B_COINS}) x(b)),
cm AS (SELECT cd.cell, b, sum(s) / greatest(sum(c), 1) AS m FROM cd JOIN cu ON cu.cell = cd.cell AND cu.i = cd.i GROUP BY ALL)"""


@query("sta_06_coin_bootstrap", ctes(TRADES, T2, CB) + "SELECT cell, round(quantile_cont(m, 0.025), 6) AS coin_lo, round(quantile_cont(m, 0.975), 6) AS coin_hi FROM cm GROUP BY cell")
def _(spark, sf):
    return rnd(S.coin_bootstrap(t2(spark, sf), ["cell"], "ret", "tok", B_COINS), 6, "coin_lo", "coin_hi")


@query("sta_07_inference", ctes(TRADES, T2, _cl("tok", "sc"), _cl("mon", "sd"), BOOT, """
k AS (SELECT t.cell, count(*) AS n, avg(ret) AS m, greatest(stddev_samp(ret) / sqrt(count(*)), any_value(sc.se), any_value(sd.se), any_value(bb.se_boot)) AS se, any_value(boot_lo) AS bl, any_value(boot_hi) AS bh
  FROM t JOIN sc ON sc.cell = t.cell JOIN sd ON sd.cell = t.cell JOIN bb ON bb.cell = t.cell GROUP BY t.cell)""") + f"""
SELECT cell, n, round(m, 6) AS mean, round(se, 6) AS se, round(CASE WHEN m - 1.96 * se <= bl THEN m - 1.96 * se ELSE bl END, 6) AS ci_lo,
  round(CASE WHEN m - 1.96 * se <= bl THEN m + 1.96 * se ELSE bh END, 6) AS ci_hi, round({_p('(m / se)')}, 6) AS p, round(2.487 * se, 6) AS mde80, round(m + 1.645 * se, 6) AS upper95 FROM k""")
def _(spark, sf):
    out = S.inference(t2(spark, sf), ["cell"], "ret", "tok", "mon", B)
    return rnd(out, 6, "mean", "se", "ci_lo", "ci_hi", "p", "mde80", "upper95").select("cell", "n", "mean", "se", "ci_lo", "ci_hi", "p", "mde80", "upper95")


@query("sta_08_summarize_calls", ctes(TRADES, T2, _cl("caller", "s1"), _cl("tok", "s2"), _cl("mon", "s3"), PG, MB, """
k AS (SELECT t.cell, count(*) AS n, avg(ret) AS m, stddev_samp(ret) / sqrt(count(*)) AS s0, any_value(s1.se) AS s1, any_value(s2.se) AS s2, any_value(s3.se) AS s3, any_value(pg.se) AS s4, any_value(mb.se) AS s5
  FROM t JOIN s1 ON s1.cell = t.cell JOIN s2 ON s2.cell = t.cell JOIN s3 ON s3.cell = t.cell JOIN pg ON pg.cell = t.cell JOIN mb ON mb.cell = t.cell GROUP BY t.cell),
g AS (SELECT *, greatest(s0, s1, s2, s3, s4, s5) AS se FROM k)""") + """
SELECT cell, n, round(m, 6) AS mean, round(se, 6) AS se, CASE se WHEN s0 THEN 'iid' WHEN s1 THEN 'caller' WHEN s2 THEN 'coin' WHEN s3 THEN 'day' WHEN s4 THEN 'pigeon' ELSE 'block' END AS se_winner,
  round(m - 1.96 * se, 6) AS ci_lo, round(m + 1.96 * se, 6) AS ci_hi FROM g""")
def _(spark, sf):
    out = S.summarize_calls(t2(spark, sf), ["cell"], "ret", "caller", "tok", "mon", ["ts", "pair"], B_TRADES)
    return rnd(out, 6, "mean", "se", "ci_lo", "ci_hi").select("cell", "n", "mean", "se", "se_winner", "ci_lo", "ci_hi")


@query("sta_09_paired_delta", ctes(TRADES, T2, TWINS, TW, "dd AS (SELECT *, ret - twin_a AS d FROM tp WHERE twin_a IS NOT NULL)", _cl("tok", "sc", "dd", "d")) + """
SELECT dd.cell, count(*) AS n, count(DISTINCT tok) AS coins, round(avg(d), 6) AS d_mean, round(avg(twin_a), 6) AS twin_mean, round(avg((twin_a <= -50)::INT), 6) AS twin_crash,
  round(median(d), 5) AS d_median, round(any_value(sc.se), 6) AS se_coin FROM dd JOIN sc ON sc.cell = dd.cell GROUP BY dd.cell""")
def _(spark, sf):
    return rnd(S.paired_delta(tp(spark, sf), ["cell"], "ret", "twin_a", "tok"), 6, "d_mean", "twin_mean", "twin_crash", "se_coin").withColumn("d_median", F.round("d_median", 5))


@query("sta_10_reality_check", ctes(TRADES, T2, f"""
st AS (SELECT cell, avg(ret) AS m, stddev_samp(ret) / sqrt(count(*)) AS se FROM t GROUP BY cell),
di AS (SELECT mon, row_number() OVER (ORDER BY mon) - 1 AS i, count(*) OVER () AS D FROM (SELECT DISTINCT mon FROM t)),
ci AS (SELECT tok, row_number() OVER (ORDER BY tok) - 1 AS i, count(*) OVER () AS D FROM (SELECT DISTINCT tok FROM t)),
wd AS (SELECT b, (('0x' || substr(md5('rc|' || b || '|' || (i // 2)), 1, 8))::BIGINT % D + i % 2) % D AS i, count(*) AS w FROM di, range({B_MAX}) x(b) GROUP BY ALL),
wc AS (SELECT b, ('0x' || substr(md5('rc|c|' || b || '|' || i), 1, 8))::BIGINT % D AS i, count(*) AS w FROM ci, range({B_MAX}) x(b) GROUP BY ALL),
bd AS (SELECT cell, b, sum(w * ret) AS s, sum(w) AS c FROM t JOIN di USING (mon) JOIN wd USING (i) GROUP BY ALL),
bc AS (SELECT cell, b, sum(w * ret) AS s, sum(w) AS c FROM t JOIN ci USING (tok) JOIN wc USING (i) GROUP BY ALL),
gr AS (SELECT cell, m, se, b FROM st, range({B_MAX}) x(b)),
md AS (SELECT gr.b, max((coalesce(s, 0) / greatest(coalesce(c, 0), 1) - m) / se) AS mx FROM gr LEFT JOIN bd ON bd.cell = gr.cell AND bd.b = gr.b GROUP BY gr.b),
mc AS (SELECT gr.b, max((coalesce(s, 0) / greatest(coalesce(c, 0), 1) - m) / se) AS mx FROM gr LEFT JOIN bc ON bc.cell = gr.cell AND bc.b = gr.b GROUP BY gr.b)""") + """
SELECT cell, round(m / se, 6) AS t, round((SELECT avg((mx >= m / se)::INT) FROM md), 6) AS p_day, round((SELECT avg((mx >= m / se)::INT) FROM mc), 6) AS p_coin FROM st""")
def _(spark, sf):
    return rnd(S.reality_check(t2(spark, sf), "cell", "ret", "tok", "mon", B_MAX), 6, "t", "p_day", "p_coin").select("cell", "t", "p_day", "p_coin")


CELLP = f"""cp AS (SELECT mon AS cell, count(*) AS n, avg(ret) AS m, stddev_samp(ret) / sqrt(count(*)) AS se FROM t GROUP BY mon),
pp AS (SELECT cell, n, m, se, CASE WHEN n >= 180 THEN {_p('(m / se)')} END AS p FROM cp)"""


def _cellp(spark, sf):
    from tidemark.functions.scalar import normal_sf
    m = S.mean_se(t2(spark, sf), ["mon"], "ret").withColumnRenamed("mon", "cell")
    return m.withColumn("p", F.when(F.col("n") >= 180, normal_sf(F.col("mean") / F.col("se_iid"))))


@query("sta_11_holm", ctes(TRADES, T2, CELLP, """
r AS (SELECT *, row_number() OVER (ORDER BY p IS NULL, p, cell) AS rk, count(*) OVER () AS k FROM pp),
f AS (SELECT min(rk) AS first_fail FROM r WHERE NOT coalesce(p < 0.9 / (k - rk + 1), false))""") + """
SELECT cell, n, coalesce(rk < (SELECT first_fail FROM f), true) AS holm_pass, coalesce(p < 0.9 / k, false) AS bonferroni_pass FROM r""")
def _(spark, sf):
    return S.holm(_cellp(spark, sf), "p", 0.9).select("cell", "n", "holm_pass", "bonferroni_pass")


@query("sta_12_verdict", ctes(TRADES, T2, CELLP) + """
SELECT cell, CASE WHEN p IS NULL THEN 'cannot tell' WHEN p < 0.05 AND m - 1.96 * se > 0 THEN 'shown' WHEN p < 0.3 THEN 'weak' ELSE 'not shown' END AS verdict FROM pp""")
def _(spark, sf):
    p, lo = F.col("p"), F.col("mean") - 1.96 * F.col("se_iid")
    return S.verdict(_cellp(spark, sf), [(p.isNull(), "cannot tell"), ((p < 0.05) & (lo > 0), "shown"), (p < 0.3, "weak")], "not shown").select("cell", "verdict")


@query("sta_13_seed_agreement", ctes(TRADES, T2, "sr AS (SELECT cell AS rule, caller AS seed, avg(ret) AS d, count(*) AS n FROM t GROUP BY ALL)") + """
SELECT rule, count(*) AS seeds, round(avg((d > 0 AND n >= 270)::INT), 6) AS all_pass, round(avg((d > 0)::INT), 6) AS share_d_pos, round(avg((n >= 270)::INT), 6) AS share_n_ok,
  round(min(d), 6) AS d_min, round(quantile_cont(d, 0.05), 6) AS d_p5, round(quantile_cont(d, 0.5), 6) AS d_p50, round(quantile_cont(d, 0.95), 6) AS d_p95, round(max(d), 6) AS d_max FROM sr GROUP BY rule""")
def _(spark, sf):
    runs = t2(spark, sf).groupBy(F.col("cell").alias("rule"), F.col("caller").alias("seed")).agg(F.avg("ret").alias("d"), F.count("*").alias("n"))
    out = S.seed_agreement(runs, "rule", {"d_pos": F.col("d") > 0, "n_ok": F.col("n") >= 270}, ["d"])
    return rnd(out, 6, *[c for c in out.columns if c not in ("rule", "seeds")])


@query("sta_14_smoothness", ctes(TRADES, T2, """
g AS (SELECT cell, caller, count(*) AS n, avg(ret) AS v, stddev_samp(ret) / sqrt(count(*)) AS se FROM t GROUP BY ALL),
w AS (SELECT *, lag(n) OVER x AS n0, lag(v) OVER x AS v0, lead(v) OVER x AS v1 FROM g WINDOW x AS (PARTITION BY cell ORDER BY caller))""") + """
SELECT cell, caller, n, coalesce(n > 1.05 * n0, false) AS count_rise, coalesce(abs(v - (v0 + v1) / 2) > 2 * se, false) AS kink FROM w""")
def _(spark, sf):
    g = S.mean_se(t2(spark, sf), ["cell", "caller"], "ret")
    return S.smoothness(g, ["cell"], "caller", "n", "mean", "se_iid").select("cell", "caller", "n", "count_rise", "kink")


@query("sta_15_crash_decomposition", ctes(TRADES, T2, TWINS, TW, "dd AS (SELECT *, ret - twin_a AS d FROM tp)") + """
SELECT cell, count(d) AS n, count(*) FILTER (ret <= -50 AND d IS NOT NULL) AS n_crash, round(avg(d), 6) AS d_mean, round(coalesce(sum(d) FILTER (ret <= -50), 0) / count(d), 6) AS d_from_crash,
  round(coalesce(sum(d) FILTER (ret > -50), 0) / count(d), 6) AS d_from_rest FROM dd GROUP BY cell""")
def _(spark, sf):
    d = tp(spark, sf).withColumn("d", F.col("ret") - F.col("twin_a"))
    return rnd(S.crash_decomposition(d, ["cell"], "ret", "d"), 6, "d_mean", "d_from_crash", "d_from_rest")


POINTS = """pt AS (SELECT l_partkey % 12 AS a, l_suppkey % 9 AS b, CAST(floor(l_quantity / 10) AS BIGINT) AS c, count(*) AS n, avg(l_extendedprice - 51000) AS m
   FROM lineitem GROUP BY ALL),
pp AS (SELECT *, CASE WHEN n % 2 = 0 THEN 'model' ELSE 'real' END AS cost, CASE WHEN n % 3 = 0 THEN 't1' ELSE 't2' END AS test, CASE WHEN n % 7 > 0 THEN m END AS mean FROM pt)"""


def _points(spark, sf):
    li = table(spark, sf, "lineitem")
    n = F.col("n")
    pt = li.groupBy((F.col("l_partkey") % 12).alias("a"), (F.col("l_suppkey") % 9).alias("b"), F.floor(F.col("l_quantity") / 10).alias("c")).agg(
        F.count("*").alias("n"), F.avg(F.col("l_extendedprice") - 51000).alias("m")).withColumn("id", F.col("a") * 1000 + F.col("b") * 10 + F.col("c"))
    return pt.withColumn("cost", F.when(n % 2 == 0, "model").otherwise("real")).withColumn("test", F.when(n % 3 == 0, "t1").otherwise("t2")).withColumn(
        "mean", F.when(n % 7 > 0, F.col("m"))).drop("m")


NB = """nb AS (SELECT p.a, p.b, p.c, count(q.a) FILTER (q.test = p.test) AS ns, count(q.a) FILTER (q.test = p.test AND q.mean > 0) AS ps,
   count(q.a) FILTER (q.test <> p.test) AS na, count(q.a) FILTER (q.test <> p.test AND q.mean > 0) AS pa
 FROM pp p LEFT JOIN pp q ON q.cost = p.cost AND q.mean IS NOT NULL AND abs(q.a - p.a) + abs(q.b - p.b) + abs(q.c - p.c) = 1 GROUP BY p.a, p.b, p.c)"""


@query("sta_16_neighbour_check", "WITH " + POINTS + ", " + NB + """
SELECT a, b, c, CASE WHEN ns > 0 THEN ns ELSE na END AS neighbours, CASE WHEN ns > 0 THEN ps ELSE pa END AS positive,
  CASE WHEN ns > 0 THEN 'same test' WHEN na > 0 THEN 'any test' END AS scope, CASE WHEN ns > 0 THEN ps >= ns * 0.5 ELSE na > 0 AND pa >= na * 0.5 END AS a3_pass FROM nb""")
def _(spark, sf):
    out = S.neighbour_check(_points(spark, sf), ["a", "b", "c"], "cost", "test", "mean", "id")
    return out.select("a", "b", "c", "neighbours", "positive", "scope", F.coalesce("a3_pass", F.lit(False)).alias("a3_pass"))


@query("sta_17_screen", ctes(TRADES, T2, CELLP, """
k AS (SELECT pp.cell, pp.n, m - 1.96 * se AS lower, m - 1.5 * se AS coin_lo, x.coins, x.days, pp.cell % 5 = 0 AS posthoc, pp.cell % 3 > 0 AS a3 FROM pp
  JOIN (SELECT mon, count(DISTINCT tok) AS coins, count(DISTINCT day) AS days FROM t GROUP BY mon) x ON x.mon = pp.cell)""") + """
SELECT cell, n >= 185 AND lower > -6 AND NOT posthoc AS S1, coin_lo > -6 AS A1, coins >= 150 AND days >= 30 AS A2, a3 AS A3,
  array_to_string(list_filter([CASE WHEN n < 185 THEN 'n' END, CASE WHEN lower <= -6 THEN 'lower' END, CASE WHEN posthoc THEN 'posthoc' END, CASE WHEN coin_lo <= -6 THEN 'A1' END,
    CASE WHEN NOT (coins >= 150 AND days >= 30) THEN 'A2' END, CASE WHEN NOT a3 THEN 'A3' END], lambda x: x IS NOT NULL), ',') AS fails FROM k""")
def _(spark, sf):
    d = t2(spark, sf)
    x = d.groupBy(F.col("mon").alias("cell")).agg(F.count_distinct("tok").alias("coins"), F.count_distinct("day").alias("days"))
    p = _cellp(spark, sf).join(x, "cell").withColumn("lower", F.col("mean") - 1.96 * F.col("se_iid") + 6).withColumn(
        "coin_lo", F.col("mean") - 1.5 * F.col("se_iid") + 6).withColumn("posthoc", F.col("cell") % 5 == 0).withColumn("a3_pass", F.col("cell") % 3 > 0)
    return S.screen(p, 185, 150, 30).select("cell", "S1", "A1", "A2", "A3", "fails")


@query("sta_18_robust_score", ctes(TRADES, T2, """
c AS (SELECT mon, tok, sum(ret) AS s FROM t GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY mon ORDER BY s DESC, tok) AS rs FROM c),
z AS (SELECT t.mon AS cell, count(*) AS n, count(DISTINCT t.tok) AS coins, avg(ret) - 1.96 * stddev_samp(ret) / sqrt(count(*)) AS lower, avg(ret) FILTER (rs > 5) AS dc
      FROM t JOIN k ON k.mon = t.mon AND k.tok = t.tok GROUP BY t.mon)""") + "SELECT cell, n, CASE WHEN n >= 185 AND coins >= 8 THEN round(least(lower, dc), 6) END AS J FROM z")
def _(spark, sf):
    d = t2(spark, sf)
    drop = A.top_k_drop(d, ["mon"], "ret", 5, "tok", "pair").select(F.col("mon").alias("cell"), "drop_coins_sum")
    coins = d.groupBy(F.col("mon").alias("cell")).agg(F.count_distinct("tok").alias("coins"))
    p = _cellp(spark, sf).join(drop, "cell").join(coins, "cell").withColumn("lower", F.col("mean") - 1.96 * F.col("se_iid"))
    return rnd(S.robust_score(p, 185, 8), 6, "J").select("cell", "n", "J")


@query("sta_19_tp_gap", """
WITH g AS (SELECT l_returnflag AS cell, 100 * (l_extendedprice * (1 - l_discount) / (l_quantity * 1993.7) - 1) AS g FROM lineitem)
SELECT cell, count(g) AS n, round(avg((g < 0)::INT), 6) AS below, round(avg(g), 6) AS gap_mean, round(min(g), 6) AS gap_worst, round(median(g), 6) AS gap_median FROM g GROUP BY cell""")
def _(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("cell"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("bk"), (F.col("l_quantity") * 1993.7).alias("ln"))
    return rnd(S.tp_gap(d, ["cell"], "bk", "ln"), 6, "below", "gap_mean", "gap_worst", "gap_median")


@query("sta_20_subset_views", ctes(TRADES, T2, """
u AS (SELECT 'all' AS view, * FROM t UNION ALL SELECT 'tight', * FROM t WHERE ret BETWEEN -50 AND 50 UNION ALL SELECT 'ex_g5', * FROM t WHERE ret <= 95
  UNION ALL SELECT 'ex_outage', * FROM t WHERE mon <> 330 UNION ALL SELECT 'lane_eq', * FROM t WHERE quote IS NULL OR quote <> 'XYZ')""") + """
SELECT cell, view, count(ret) AS n, round(avg(ret), 6) AS mean, round(stddev_samp(ret) / sqrt(count(ret)), 6) AS se_iid FROM u GROUP BY cell, view""")
def _(spark, sf):
    r, q = F.col("ret"), F.col("quote")
    flags = {"all": F.lit(True), "tight": r.between(-50, 50), "ex_g5": r <= 95, "ex_outage": F.col("mon") != 330, "lane_eq": q.isNull() | (q != "XYZ")}
    return rnd(S.subset_views(t2(spark, sf), flags, "ret", ["cell"]), 6, "mean", "se_iid")


@query("sta_21_per_day_mean", ctes(TRADES) + f"SELECT cell, day, count(ret) AS n, round(avg(ret), 6) AS mean, CASE WHEN day * {D} < {SPLIT} THEN 'early' ELSE 'late' END AS part FROM trades GROUP BY ALL")
def _(spark, sf):
    return rnd(S.per_day_mean(trades(spark, sf), ["cell"], "day", "ret", SPLIT), 6, "mean")


@query("sta_22_reconcile", ctes(TRADES, T2, """
pub AS (SELECT mon AS cell, count(*) AS n, count(DISTINCT tok) AS coins, round(avg(ret), 2) + CASE WHEN mon % 4 = 0 THEN 0.02 ELSE 0 END AS mean FROM t WHERE ret < 103 GROUP BY mon),
got AS (SELECT mon AS cell, count(*) AS n, count(DISTINCT tok) AS c, avg(ret) AS m FROM t GROUP BY mon)""") + """
SELECT cell, pub.n = got.n AS n_ok, coins = c AS coins_ok, abs(mean - m) <= greatest(0.006, 1e-6 * abs(m)) AS mean_ok FROM pub JOIN got USING (cell)""")
def _(spark, sf):
    d = t2(spark, sf).withColumn("cell", F.col("mon"))
    pub = d.filter("ret < 103").groupBy("cell").agg(F.count("*").alias("n"), F.count_distinct("tok").alias("coins"), (
        F.round(F.avg("ret"), 2) + F.when(F.col("cell") % 4 == 0, 0.02).otherwise(0.0)).alias("mean"))
    return S.reconcile(pub, d, ["cell"], "ret", "tok")
