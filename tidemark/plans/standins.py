"""The given tables seen as the shapes the operators work on, in Spark and as SQL text for the oracle.

print  = event: ts in seconds, blk = event_id, li = 0, coin = user, pool = event type, px = value, usd = props.k
trade  = order: coin = customer, ret from the price, day = order date, cell = priority; twins = its line items
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import epoch_s
from tidemark.operators.slicing import use_layout
from tidemark.session import use_utc

SPLIT = 883612800  # 1998-01-01, first second of the second half


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    use_utc(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tape(spark: SparkSession, sf: str) -> DataFrame:
    """The prints; operators that are not told a slice width take the one measured on them, once a session."""
    e = table(spark, sf, "events")
    out = e.select(
        epoch_s("ts").alias("ts"), F.col("event_id").alias("blk"), F.lit(0).alias("li"),
        F.col("user_id").alias("tok"), F.col("event_type").alias("pool"), F.col("value").alias("px"),
        F.get_json_object("props", "$.k").cast("double").alias("usd"),
        F.when(F.col("event_type").isin("error", "view"), "sell").otherwise("buy").alias("side"),
    )
    use_layout(out, ["tok"], "ts")
    return out


TAPE = """tape AS (
  SELECT epoch_us(ts) // 1000000 AS ts, event_id AS blk, 0 AS li, user_id AS tok, event_type AS pool, value AS px,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS usd,
         CASE WHEN event_type IN ('error', 'view') THEN 'sell' ELSE 'buy' END AS side
  FROM events)"""


def calls(spark: SparkSession, sf: str) -> DataFrame:
    """Calls: the signup events; the coin is the user, the caller and its chat come from the size field."""
    return tape(spark, sf).filter(F.col("pool") == "signup").select(
        F.col("blk").alias("id"), "ts", "tok", (F.col("usd") % 7).cast("long").alias("caller"),
        (F.col("usd") % 5).cast("long").alias("chat"), F.col("px").alias("call_px"))


CALLS = """calls AS (
  SELECT blk AS id, ts, tok, CAST(usd % 7 AS BIGINT) AS caller, CAST(usd % 5 AS BIGINT) AS chat, px AS call_px
  FROM tape WHERE pool = 'signup')"""


def trades(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    t = epoch_s("o_orderdate")
    return o.select(
        F.col("o_orderkey").alias("pair"), F.col("o_custkey").alias("tok"), F.col("o_orderpriority").alias("cell"),
        t.alias("ts"), F.floor(t / 86400).cast("long").alias("day"),
        F.when(t < SPLIT, "FIT").otherwise("JUDGE").alias("half"),
        F.col("o_orderstatus").alias("reason"), ((F.col("o_totalprice") - 240000.0) / 2503.0).alias("ret"))


TRADES = f"""trades AS (
  SELECT o_orderkey AS pair, o_custkey AS tok, o_orderpriority AS cell, epoch_us(o_orderdate) // 1000000 AS ts,
         epoch_us(o_orderdate) // 86400000000 AS day,
         CASE WHEN epoch_us(o_orderdate) // 1000000 < {SPLIT} THEN 'FIT' ELSE 'JUDGE' END AS half,
         o_orderstatus AS reason, (o_totalprice - 240000.0) / 2503.0 AS ret
  FROM orders)"""


def twins(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("pair"), F.col("l_linenumber").alias("rep"), F.col("l_partkey").alias("twin_tok"),
        F.col("l_returnflag").alias("tw"), ((F.col("l_extendedprice") - 50000.0) / 617.0).alias("twin_ret"))


TWINS = """twins AS (
  SELECT l_orderkey AS pair, l_linenumber AS rep, l_partkey AS twin_tok, l_returnflag AS tw,
         (l_extendedprice - 50000.0) / 617.0 AS twin_ret
  FROM lineitem)"""


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
