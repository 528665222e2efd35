"""Queries of the comparison and grid families. The two versions of a table are the orders as stored and as implied by
their line items or by their status."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalar import DAY, bucket, epoch_s
from tidemark.operators import compare as C
from tidemark.operators import grid as G
from tidemark.plans.registry import query
from tidemark.plans.standins import TAPE, TRADES, ctes, table, tape, trades

D = DAY
T0 = 1704067200

VERS = """a AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, o_totalprice AS p, epoch_us(o_orderdate) // 86400000000 AS day FROM orders WHERE o_totalprice < 470000),
b AS (SELECT o_orderkey AS k, o_custkey AS c, CASE WHEN o_orderpriority = '5-LOW' THEN 'Z' ELSE o_orderstatus END AS s, CASE WHEN o_orderstatus = 'P' AND o_totalprice > 300000 THEN o_totalprice + 1 ELSE o_totalprice END AS p,
  epoch_us(o_orderdate) // 86400000000 AS day FROM orders WHERE o_totalprice > 8000)"""


def versions(spark, sf):
    c = F.col
    o = table(spark, sf, "orders").withColumn("day", F.floor(epoch_s("o_orderdate") / D))
    a = o.filter("o_totalprice < 470000").select(c("o_orderkey").alias("k"), c("o_custkey").alias("c"), c("o_orderstatus").alias("s"), c("o_totalprice").alias("p"), "day")
    b = o.filter("o_totalprice > 8000").select(
        c("o_orderkey").alias("k"), c("o_custkey").alias("c"), F.when(c("o_orderpriority") == "5-LOW", "Z").otherwise(c("o_orderstatus")).alias("s"),
        F.when((c("o_orderstatus") == "P") & (c("o_totalprice") > 300000), c("o_totalprice") + 1).otherwise(c("o_totalprice")).alias("p"), "day")
    return a, b


DIFF = """j AS (SELECT coalesce(a.k, b.k) AS k, coalesce(a.day, b.day) AS day, a.k IS NOT NULL AND b.k IS NOT NULL AS bo, a.k IS NULL AS oa, b.k IS NULL AS ob, a.s IS DISTINCT FROM b.s AS ds, a.p IS DISTINCT FROM b.p AS dp,
  a.p AS ap, b.p AS bp, b.s AS bs FROM a FULL JOIN b ON a.k = b.k),
df AS (SELECT *, CASE WHEN oa THEN 'only_b' WHEN ob THEN 'only_a' WHEN ds OR dp THEN 'differ' ELSE 'same' END AS status FROM j)"""


@query("set_02_top_k_per_group", """
SELECT o_custkey, o_orderkey, CAST(rk AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rk FROM orders) WHERE rk <= 3""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return C.top_k_per_group(o, ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3).drop("o_totalprice")


@query("set_03_multiset_compare", "WITH " + VERS + """
, x AS (SELECT c, s, p, count(*) AS na FROM a GROUP BY ALL), y AS (SELECT c, s, p, count(*) AS nb FROM b GROUP BY ALL), z AS (SELECT coalesce(na, 0) AS na, coalesce(nb, 0) AS nb FROM x FULL JOIN y USING (c, s, p))
SELECT CAST(sum(na) AS BIGINT) AS rows_a, CAST(sum(nb) AS BIGINT) AS rows_b, CAST(sum(greatest(na - nb, 0)) AS BIGINT) AS only_a, CAST(sum(greatest(nb - na, 0)) AS BIGINT) AS only_b FROM z""")
def _(spark, sf):
    return C.multiset_compare(*versions(spark, sf), ["c", "s", "p"])


@query("set_04_keyed_diff", "WITH " + VERS + ", " + DIFF + """
SELECT k, status, CASE WHEN bo THEN array_to_string(list_filter([CASE WHEN ds THEN 's' END, CASE WHEN dp THEN 'p' END], lambda x: x IS NOT NULL), ',') ELSE '' END AS fields FROM df""")
def _(spark, sf):
    return C.keyed_diff(*versions(spark, sf), ["k"], ["s", "p"]).select("k", "status", F.array_join("fields", ",").alias("fields"))


@query("set_04_diff_summary", "WITH " + VERS + ", " + DIFF + """
SELECT status AS what, count(*) AS n FROM df GROUP BY 1 UNION ALL SELECT 'field:s', count(*) FILTER (bo AND ds) FROM df UNION ALL SELECT 'field:p', count(*) FILTER (bo AND dp) FROM df""")
def _(spark, sf):
    return C.diff_summary(C.keyed_diff(*versions(spark, sf), ["k"], ["s", "p"]))


@query("set_05_carry_forward_table", "WITH " + VERS + """
SELECT k, s, p, 'old' AS origin FROM a UNION ALL SELECT k, s, p, 'new' FROM b WHERE k NOT IN (SELECT k FROM a) AND day < 10300""")
def _(spark, sf):
    a, b = versions(spark, sf)
    return C.carry_forward_table(b, a, "k", "day", 10300).select("k", "s", "p", "origin")


@query("set_05_table_changes", "WITH " + VERS + """
, o AS (SELECT k, CASE WHEN s = 'O' THEN NULL ELSE s END AS s FROM a)
SELECT CASE WHEN b.k IS NULL THEN 'absent' WHEN o.s IS NULL AND b.s IS NOT NULL THEN 'unknown->known' WHEN o.s IS DISTINCT FROM b.s THEN 'changed' ELSE 'same' END AS kind, count(*) AS n FROM o LEFT JOIN b ON b.k = o.k GROUP BY 1""")
def _(spark, sf):
    a, b = versions(spark, sf)
    return C.table_changes(b, a.withColumn("s", F.when(F.col("s") != "O", F.col("s"))), "k", "s")


FAM = """st AS (SELECT DISTINCT l_orderkey AS pt, l_partkey AS it FROM lineitem), n AS (SELECT pt, count(*) AS n FROM st GROUP BY pt),
cm AS (SELECT x.pt AS a, y.pt AS b, count(*) AS c FROM st x JOIN st y ON x.it = y.it AND x.pt < y.pt GROUP BY ALL),
e AS (SELECT a, b FROM cm JOIN n na ON na.pt = a JOIN n nb ON nb.pt = b WHERE c / greatest(na.n, nb.n) >= 0.8)"""


def _sets(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("pt"), F.col("l_partkey").alias("it"))


@query("set_06_overlap_families", "WITH RECURSIVE " + FAM + """,
nd AS (SELECT DISTINCT pt FROM st),
ed AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r AS (SELECT pt, pt AS root FROM nd UNION SELECT ed.b, r.root FROM r JOIN ed ON ed.a = r.pt)
SELECT pt, min(root) AS family FROM r GROUP BY pt""")
def _(spark, sf):
    return C.overlap_families(_sets(spark, sf), "pt", "it", 0.8).select("pt", "family")


@query("set_07_merge_keys", """
SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 UNION ALL
SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def _(spark, sf):
    new = table(spark, sf, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
    return C.merge_keys(table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v")), new, "k")


@query("set_07_split_known", ctes(TAPE) + """
SELECT tok IN (SELECT c_custkey FROM customer WHERE c_acctbal < 5000) AS known, count(*) AS keys, CAST(sum(n) AS BIGINT) AS weight FROM (SELECT tok, count(*) AS n FROM tape GROUP BY tok) GROUP BY 1""")
def _(spark, sf):
    want = tape(spark, sf).groupBy("tok").agg(F.count("*").alias("n"))
    return C.split_known(want, table(spark, sf, "customer").filter("c_acctbal < 5000").select(F.col("c_custkey").alias("tok")), "tok", "n")


@query("set_08_fingerprint", ctes(TAPE) + """
SELECT pool, count(*) AS n, CAST(sum(('0x' || substr(md5(blk || '|' || tok || '|' || CAST(usd AS BIGINT)), 1, 8))::BIGINT) AS BIGINT) AS hash FROM tape GROUP BY pool""")
def _(spark, sf):
    return C.fingerprint(tape(spark, sf).withColumn("usd", F.col("usd").cast("long")), ["blk", "tok", "usd"], ["pool"])


@query("set_09_attribute_diff", "WITH " + VERS + ", " + DIFF + """
SELECT CASE WHEN oa THEN 'cut at the top' WHEN ob THEN 'cut at the bottom' WHEN ds AND bs = 'Z' THEN 'relabelled' WHEN dp AND bp = ap + 1 THEN 'repriced' ELSE 'unexplained' END AS why, count(*) AS n
FROM df WHERE status <> 'same' GROUP BY 1""")
def _(spark, sf):
    d = C.keyed_diff(*versions(spark, sf), ["k"], ["s", "p"])
    return C.attribute_diff(d, [("cut at the top", F.col("status") == "only_b"), ("cut at the bottom", F.col("status") == "only_a"),
                                ("relabelled", F.array_contains("fields", "s") & (F.col("_b.s") == "Z")), ("repriced", F.array_contains("fields", "p") & (F.col("_b.p") == F.col("_a.p") + 1))])


@query("set_10_seam_check", "WITH " + VERS + """
, q AS (SELECT a.k, a.day, a.s IS DISTINCT FROM b.s AS ds, a.p IS DISTINCT FROM b.p AS dp FROM a JOIN b ON a.k = b.k AND a.day = b.day),
g AS (SELECT count(*) FILTER (day <= 10000) AS first_diffs, count(*) FILTER (day <= 10000 AND ds) AS first_stray, count(*) FILTER (day > 10000) AS later_diffs FROM q WHERE ds OR dp)
SELECT *, CASE WHEN first_diffs <= 5878 AND first_stray = 0 AND later_diffs = 0 THEN 'PASS' ELSE 'REFUSE' END AS verdict FROM g""")
def _(spark, sf):
    a, b = versions(spark, sf)
    keys = a.select("k").join(b.select("k"), "k", "left_semi")
    d = C.keyed_diff(a.join(keys, "k", "left_semi"), b.join(keys, "k", "left_semi"), ["k", "day"], ["s", "p"])
    return C.seam_check(d, "day", 10000, ["p"], 5878)


@query("set_11_clock_offset", ctes(TAPE, f"""
a AS (SELECT tok, pool, px, usd, min(ts) AS ta FROM tape GROUP BY tok, pool, px, usd HAVING count(*) = 1), j AS (SELECT ta, CAST(3600 * (1 + tok % 2) + CASE WHEN usd > 90 THEN 60 ELSE 0 END AS BIGINT) AS off FROM a),
c AS (SELECT ta // {D} AS b, off, count(*) AS n FROM j GROUP BY ALL)""") + """
SELECT b, CAST(sum(n) AS BIGINT) AS matched, arg_min(off, (-n, off)) AS "offset", max(n) AS votes FROM c GROUP BY b""")
def _(spark, sf):
    t = tape(spark, sf)
    late = t.withColumn("ts", F.col("ts") + 3600 * (1 + F.col("tok") % 2) + F.when(F.col("usd") > 90, 60).otherwise(0))
    return C.clock_offset(t, late, ["tok", "pool", "px", "usd"], 10800, D)


@query("set_12_warmup_diff", ctes(TAPE, f"""
f AS (SELECT blk, ts, lag(px) OVER (PARTITION BY tok, pool ORDER BY blk) AS p FROM tape), c AS (SELECT blk, lag(px) OVER (PARTITION BY tok, pool ORDER BY blk) AS p FROM tape WHERE ts >= {T0 + 15 * D})""") + f"""
SELECT CASE WHEN f.p IS DISTINCT FROM c.p THEN 'differ' ELSE 'same' END AS status, count(*) AS n, count(*) FILTER (c.p IS NULL) AS null_only FROM f JOIN c USING (blk) WHERE f.ts >= {T0 + 15 * D} GROUP BY 1""")
def _(spark, sf):
    from tidemark.operators.slicing import running, width_or_layout
    op = lambda d: running(d, ["tok", "pool"], ["ts", "blk", "li"], {"p": ("last", F.col("px"))}, bucket("ts", width_or_layout(None)), False)
    d = C.warmup_diff(op, tape(spark, sf), T0 + 15 * D, "ts", ["blk"], ["p"])
    return d.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("_b.p").isNull()).alias("null_only"))


DIALS = {"dip": [10, 20, 40], "hold": [900, 3600, 86400], "tp": ["1.25", "1.5"]}
LABEL = "'dip=' || dip || '|hold=' || hold || '|tp=' || tp"


@query("grd_01_cell_grid", ctes(TRADES) + f"""
, g AS (SELECT dip, hold, tp, {LABEL} AS cell FROM (VALUES (10), (20), (40)) a(dip), (VALUES (900), (3600), (86400)) b(hold), (VALUES ('1.25'), ('1.5')) c(tp))
SELECT g.cell, count(*) FILTER (ret <= -dip) AS n FROM g, trades GROUP BY g.cell""")
def _(spark, sf):
    cells = [r.asDict() for r in G.cell_grid(spark, DIALS).collect()]  # a fixed parameter list of 18 rows
    from tidemark.operators.project import with_cells
    t = with_cells(trades(spark, sf).select("ret"), [{"cell": c["cell"], "dip": c["dip"]} for c in cells])
    return t.groupBy("cell").agg(F.count_if(F.col("ret") <= -F.col("dip")).alias("n"))


@query("grd_01_stack_grids", ctes(TRADES) + f"""
, a AS (SELECT 0 AS list, dip, {LABEL} AS cell FROM (VALUES (10), (20), (40)) a(dip), (VALUES (900), (3600), (86400)) b(hold), (VALUES ('1.25'), ('1.5')) c(tp)),
b AS (SELECT 1 AS list, dip, {LABEL} AS cell FROM (VALUES (20), (30)) a(dip), (VALUES (3600)) b(hold), (VALUES ('1.5'), ('2.0')) c(tp)), s AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT s.cell, list, list > (SELECT min(list) FROM s f WHERE f.cell = s.cell) AS reread, count(*) FILTER (ret <= -dip) AS n FROM s, trades GROUP BY s.cell, list""")
def _(spark, sf):
    from tidemark.operators.project import with_cells
    more = {"dip": [20, 30], "hold": [3600], "tp": ["1.5", "2.0"]}
    stacked = G.stack_grids(G.cell_grid(spark, DIALS), G.cell_grid(spark, more)).select("cell", "list", "reread", "dip")
    cells = [r.asDict() for r in stacked.collect()]  # a fixed parameter list of 22 rows
    t = with_cells(trades(spark, sf).select("ret"), cells)
    return t.groupBy("cell", "list", "reread").agg(F.count_if(F.col("ret") <= -F.col("dip")).alias("n"))


MEAS = f"""lg AS (SELECT p_size AS dip, p_type AS hold, 'dip=' || p_size || '|hold=' || p_type AS cell FROM part GROUP BY ALL),
ms AS (SELECT DISTINCT 'dip=' || p_size || '|hold=' || p_type AS cell FROM part WHERE p_retailprice > 1065), lr AS (SELECT DISTINCT 'dip=' || p_size || '|hold=' || p_type AS cell FROM part WHERE p_brand = 'Brand#7'),
th AS (SELECT 'dip' AS dial, p_size::VARCHAR AS level FROM part GROUP BY p_size HAVING count(*) < 33 UNION ALL SELECT 'hold', p_type FROM part GROUP BY p_type HAVING count(*) < 330),
sk AS (SELECT lg.cell, CASE WHEN cell IN (SELECT cell FROM ms) THEN 'measured' WHEN cell IN (SELECT cell FROM lr) THEN 'ledger'
  WHEN dip::VARCHAR IN (SELECT level FROM th WHERE dial = 'dip') OR hold IN (SELECT level FROM th WHERE dial = 'hold') THEN 'thin level' END AS skip FROM lg)"""


def _open(spark, sf):
    p = table(spark, sf, "part").withColumn("cell", F.concat(F.lit("dip="), F.col("p_size"), F.lit("|hold="), F.col("p_type")))
    legal = p.select(F.col("p_size").alias("dip"), F.col("p_type").alias("hold"), "cell").distinct()
    thin = p.groupBy(F.col("p_size").cast("string").alias("level")).count().filter("count < 33").select(F.lit("dip").alias("dial"), "level").unionByName(
        p.groupBy(F.col("p_type").alias("level")).count().filter("count < 330").select(F.lit("hold").alias("dial"), "level"))
    return G.unmeasured_cells(legal, p.filter("p_retailprice > 1065"), p.filter("p_brand = 'Brand#7'"), thin, ["dip", "hold"])


@query("grd_03_unmeasured_cells", "WITH " + MEAS + " SELECT cell, skip FROM sk")
def _(spark, sf):
    return _open(spark, sf).select("cell", "skip")


@query("grd_04_random_arm", "WITH " + MEAS + """
SELECT cell FROM sk WHERE skip IS NULL ORDER BY ('0x' || substr(md5('arm|' || cell), 1, 8))::BIGINT, cell LIMIT 12""")
def _(spark, sf):
    return G.random_arm(_open(spark, sf).filter("skip is null").select("cell"), "cell", 12, "arm")
