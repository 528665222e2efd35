"""Queries of the cleaning family."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalar import DAY
from tidemark.operators import clean as C
from tidemark.operators import features as W
from tidemark.plans.registry import query
from tidemark.plans.standins import CALLS, TAPE, calls, ctes, tape

D = DAY
T0 = 1704067200
BAND = 6.0


def guard_sql(key: str, absorbing: bool) -> str:
    held = "NULL" if absorbing else "side"
    return f"""WITH RECURSIVE {TAPE},
n AS (SELECT blk, {key} AS k, px, usd, row_number() OVER (PARTITION BY {key} ORDER BY ts, blk) AS i FROM tape),
r AS (SELECT k, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS blk, false AS accepted, CAST([] AS DOUBLE[]) AS seen, CAST(NULL AS VARCHAR) AS hs, CAST(NULL AS DOUBLE) AS hp
      FROM (SELECT DISTINCT k FROM n)
  UNION ALL
  SELECT k, i, blk, ok, CASE WHEN NOT valid THEN seen WHEN conf THEN [px, px, px, px, px] WHEN ok THEN list_append(seen, px)[-15:] ELSE seen END,
         CASE WHEN NOT valid THEN hs WHEN ok THEN NULL ELSE {held} END, CASE WHEN NOT valid THEN hp WHEN ok THEN NULL ELSE px END
  FROM (SELECT *, valid AND (side IS NULL OR conf) AS ok FROM (
    SELECT *, valid AND coalesce(hs = side AND px BETWEEN hp / 2 AND hp * 2, false) AS conf FROM (
      SELECT n.k, n.i, n.blk, n.px, r.seen, r.hs, r.hp, n.px > 0 AND n.usd >= 1 AS valid,
        CASE WHEN len(r.seen) >= 5 AND n.px > list_sort(r.seen)[len(r.seen) // 2 + 1] * {BAND} THEN 'up'
             WHEN len(r.seen) >= 5 AND n.px < list_sort(r.seen)[len(r.seen) // 2 + 1] / {BAND} THEN 'down' END AS side
      FROM r JOIN n ON n.k = r.k AND n.i = r.i + 1))))
SELECT blk, accepted FROM r WHERE i > 0"""


@query("cln_01_bad_print_guard", guard_sql("tok", False))
def _(spark, sf):
    return C.bad_print_guard(tape(spark, sf), ["tok"], band=BAND).select("blk", "accepted")


@query("cln_02_bad_print_guard_absorbing", guard_sql("tok", True))
def _(spark, sf):
    return C.bad_print_guard_absorbing(tape(spark, sf), ["tok"], band=BAND).select("blk", "accepted")


MAIN_GUARD = f"""WITH RECURSIVE {TAPE},
n AS (SELECT blk, tok AS k, pool, ts, px, usd, row_number() OVER (PARTITION BY tok ORDER BY ts, blk) AS i FROM tape),
r AS (SELECT k, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS blk, false AS accepted, CAST(NULL AS BOOLEAN) AS checked, CAST([] AS DOUBLE[]) AS seen, CAST(NULL AS VARCHAR) AS hs,
         CAST(NULL AS DOUBLE) AS hp, CAST([] AS STRUCT(pk VARCHAR, v DOUBLE, t BIGINT, px DOUBLE)[]) AS pools FROM (SELECT DISTINCT k FROM n)
  UNION ALL
  SELECT k, i, blk, ok, chk, CASE WHEN NOT valid THEN seen WHEN conf THEN [px, px, px, px, px] WHEN ok THEN list_append(seen, px)[-15:] ELSE seen END,
         CASE WHEN NOT valid THEN hs WHEN ok THEN NULL ELSE side END, CASE WHEN NOT valid THEN hp WHEN ok THEN NULL ELSE px END,
         CASE WHEN ok THEN list_append(list_filter(pools, lambda e: e.pk <> pool), {{'pk': pool, 'v': coalesce(list_sum(list_transform(list_filter(pools, lambda e: e.pk = pool),
           lambda e: e.v * pow(2.0, -(ts - e.t) / 432000.0))), 0) + usd, 't': ts, 'px': px}}) ELSE pools END
  FROM (SELECT *, valid AND (side IS NULL OR conf) AS ok FROM (
    SELECT *, valid AND coalesce(hs = side AND px BETWEEN hp / 2 AND hp * 2, false) AS conf FROM (
      SELECT *, fits AND px > 0 AND usd >= 1 AS valid, CASE WHEN len(seen) >= 5 AND px > list_sort(seen)[len(seen) // 2 + 1] * {BAND} THEN 'up'
             WHEN len(seen) >= 5 AND px < list_sort(seen)[len(seen) // 2 + 1] / {BAND} THEN 'down' END AS side FROM (
        SELECT *, CASE WHEN m.pk <> pool THEN ts - m.t <= {3 * D} END AS chk, coalesce(m.pk = pool OR ts - m.t > {3 * D} OR px / m.px BETWEEN 0.25 AND 4, true) AS fits FROM (
          SELECT n.*, r.seen, r.hs, r.hp, r.pools, list_max(list_transform(r.pools, lambda e: {{'d': e.v * pow(2.0, -(n.ts - e.t) / 432000.0), 'pk': e.pk, 't': e.t, 'px': e.px}})) AS m
          FROM r JOIN n ON n.k = r.k AND n.i = r.i + 1))))))
SELECT blk, accepted, checked FROM r WHERE i > 0"""


@query("cln_03_guard_with_main_pool", MAIN_GUARD)
def _(spark, sf):
    out = C.guard_with_main_pool(tape(spark, sf), ratio=4.0, ref_age=3 * D, half_life=5 * D, band=BAND)
    return out.select("blk", "accepted", "checked")


@query("cln_03_main_pool_consistency", ctes(TAPE, """
p AS (SELECT l.blk, r.pool, sum(r.usd * pow(2.0, (r.ts - l.ts) / 432000.0)) AS v, min(r.blk) AS seen FROM tape l JOIN tape r ON r.tok = l.tok AND r.blk < l.blk GROUP BY ALL),
m AS (SELECT t.*, (SELECT arg_max(p.pool, (round(p.v, 9), -p.seen)) FROM p WHERE p.blk = t.blk) AS main FROM tape t),
x AS (SELECT m.*, l.px AS mpx, l.ts AS mts FROM m LEFT JOIN tape l ON l.blk = (SELECT max(blk) FROM tape r WHERE r.tok = m.tok AND r.pool = m.main AND r.ts <= m.ts))""") + f"""
SELECT blk, coalesce(main <> pool AND ts - mts <= {3 * D} AND mpx > 0, false) AS checked,
  CASE WHEN main <> pool AND ts - mts <= {3 * D} AND mpx > 0 THEN px / mpx BETWEEN 0.25 AND 4 ELSE true END AS keep FROM x""")
def _(spark, sf):
    m = W.main_pool(tape(spark, sf), 5 * D)
    return C.main_pool_consistency(m, ratio=4.0, ref_age=3 * D).select("blk", F.coalesce("checked", F.lit(False)).alias("checked"), "keep")


@query("cln_04_mislabelled_pools", ctes(TAPE, f"""
q AS (SELECT *, CAST(floor(usd / 10) AS BIGINT) AS liq FROM tape),
s AS (SELECT l.blk, l.liq, l.px > 10 AS truth, r.pool = l.pool AS own, arg_max(r.liq, r.blk) AS last_liq FROM q l JOIN q r ON r.tok = l.tok AND r.ts < l.ts AND r.ts >= l.ts - {8 * D}
      WHERE l.pool = 'purchase' GROUP BY l.blk, l.liq, l.px, r.pool, l.pool),
g AS (SELECT blk, max(own::INT) AS own, max((own AND last_liq = liq)::INT) AS own_same, max((NOT own AND last_liq = liq)::INT) AS sib FROM s GROUP BY blk),
j AS (SELECT q.blk, q.px > 10 AS truth, coalesce(own, 0) AS own, own_same = 0 AND sib = 1 AS sus FROM q LEFT JOIN g USING (blk) WHERE q.pool = 'purchase')""") + """
SELECT CASE WHEN own = 0 THEN 'unjudgeable' WHEN sus AND truth THEN 'tp' WHEN sus THEN 'fp' WHEN truth THEN 'miss' ELSE 'tn' END AS judgement, count(*) AS n FROM j GROUP BY 1""")
def _(spark, sf):
    q = tape(spark, sf).withColumn("liq", F.floor(F.col("usd") / 10)).withColumn("truth", F.col("px") > 10)
    rows = q.filter("pool = 'purchase'").select("blk", "tok", "pool", "ts", "liq", "truth")
    out = C.mislabelled_pools(rows, q, "blk", "liq", "truth", 8 * D)
    return out.groupBy("judgement").agg(F.count("*").alias("n"))


@query("cln_05_quote_ref_jump", ctes(TAPE, CALLS, f"""
w AS (SELECT c.id, max(t.px) / nullif(c.call_px, 0) AS a, max(t.px / (t.usd + 1)) / nullif(c.call_px / 10, 0) AS b FROM calls c LEFT JOIN tape t ON t.tok = c.tok AND t.ts > c.ts AND t.ts <= c.ts + {6 * D} GROUP BY c.id, c.call_px)""") + """
SELECT id, round(a, 6) AS mult_a, round(b, 6) AS mult_b, greatest(a / nullif(b, 0), b / nullif(a, 0)) > 3 AS jump FROM w""")
def _(spark, sf):
    t = tape(spark, sf).withColumn("pxq", F.col("px") / (F.col("usd") + 1))
    c = calls(spark, sf).withColumn("base_a", F.col("call_px")).withColumn("base_b", F.col("call_px") / 10)
    out = C.quote_ref_jump(c, t, ["tok"], "id", "px", "pxq", 6 * D, 3.0, 21600, 4 * D)
    return out.select("id", F.round("mult_a", 6).alias("mult_a"), F.round("mult_b", 6).alias("mult_b"), "jump")


HOLES = "h AS (SELECT p AS from_ts, ts AS to_ts FROM (SELECT ts, lag(ts) OVER (ORDER BY ts) AS p FROM (SELECT DISTINCT ts FROM tape)) WHERE ts - p >= 900)"


def _holes(spark, sf):
    return C.stream_holes(tape(spark, sf), 900)


@query("cln_06_stream_holes", ctes(TAPE, HOLES) + "SELECT from_ts, to_ts FROM h")
def _(spark, sf):
    return _holes(spark, sf)


@query("cln_06_truncate_at_holes", ctes(TAPE, HOLES, """
p AS (SELECT blk, ts, ts + CAST(usd AS BIGINT) * 600 AS e FROM tape WHERE pool = 'view'),
x AS (SELECT p.*, (SELECT min(from_ts) FROM h WHERE from_ts >= p.ts) AS f FROM p)""") + """
SELECT blk, CASE WHEN f < e THEN 'trunc' ELSE 'ok' END AS status, CASE WHEN f < e THEN f ELSE e END AS end_ts FROM x""")
def _(spark, sf):
    pos = tape(spark, sf).filter("pool = 'view'").select("blk", "ts", (F.col("ts") + F.col("usd").cast("long") * 600).alias("e"))
    return C.truncate_at_holes(pos, _holes(spark, sf), "ts", "e").select("blk", "status", "end_ts")


@query("cln_07_order_audit", """
WITH o AS (SELECT o_orderpriority AS file, o_orderkey AS k, epoch_us(o_orderdate) // 1000000 AS ts FROM orders),
w AS (SELECT *, lag(ts) OVER x AS p, max(ts) OVER (PARTITION BY file ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM o WINDOW x AS (PARTITION BY file ORDER BY k))
SELECT file, count(*) AS rows, CAST(sum(coalesce((ts < p)::INT, 0)) AS BIGINT) AS inversions, max(greatest(coalesce(m - ts, 0), 0)) AS max_late, min(ts) AS first_ts, max(ts) AS last_ts FROM w GROUP BY file""")
def _(spark, sf):
    from tidemark.functions.scalar import epoch_s
    from tidemark.plans.standins import table
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("file"), F.col("o_orderkey").alias("k"), epoch_s("o_orderdate").alias("ts"))
    return C.order_audit(o, "file", "k", slice_len=4000)


@query("cln_08_coverage_flags", ctes(TAPE, CALLS) + f"""
SELECT id, array_to_string(list_filter([CASE WHEN call_px < 2 THEN 'no_price' END, CASE WHEN ts < {T0 + 8 * D} THEN 'partial_v23' END, CASE WHEN chat = 3 THEN 'lock_pool' END,
  CASE WHEN ts >= {T0 + 25 * D} THEN 'v23_tail' END], lambda x: x IS NOT NULL), ',') AS flags FROM calls""")
def _(spark, sf):
    t = F.col("ts")
    out = C.coverage_flags(calls(spark, sf), {"no_price": F.col("call_px") < 2, "partial_v23": t < T0 + 8 * D, "lock_pool": F.col("chat") == 3, "v23_tail": t >= T0 + 25 * D})
    return out.select("id", F.array_join("flags", ",").alias("flags"))
