"""Reading, conforming and merging tapes (SRC-1..6, SRC-10..13)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

V23_SCHEMA = (
    "ts long, blk long, li int, tx string, tok string, sym string, w string, side string, usd double, px double, "
    "kind string, quote string, _corrupt_record string")
V4_SCHEMA = (
    "ts long, blk long, li int, tx string, tok string, pool string, quote string, quote_addr string, price_quote double, "
    "price_eth double, price_usd double, side string, amount_token double, amount_quote double, usd double, eth_usd double, "
    "liquidity string, tick int, depth1_eth double, depth5_eth double, pad string, pad_key string, hook string, "
    "launcher string, birth_ts long, src string, dec_assumed boolean, sealed boolean, _corrupt_record string")
SCHEMAS = {"v23": V23_SCHEMA, "v4": V4_SCHEMA}


def read_tape(spark: SparkSession, path: str, rail: str) -> DataFrame:
    """SRC-1: one rail's line-JSON files. Malformed lines stay visible in ``_corrupt_record``."""
    return (spark.read.schema(SCHEMAS[rail]).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
            .withColumn("file", F.col("_metadata.file_path")))


def good_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col("_corrupt_record").isNull() & F.col("ts").isNotNull()).drop("_corrupt_record")


def bad_rows(df: DataFrame) -> DataFrame:
    """Malformed lines per file."""
    bad = (F.col("_corrupt_record").isNotNull() | F.col("ts").isNull()).cast("int")
    return df.groupBy("file").agg(F.count("*").alias("lines"), F.sum(bad).alias("bad"))


def conform_v4(df: DataFrame) -> DataFrame:
    """SRC-2: the V4 row in the common print shape, its extra columns kept."""
    return df.withColumnsRenamed({"price_usd": "px"}).withColumn("kind", F.lit("v4")).withColumn(
        "pk", F.concat(F.lit("v4:"), F.col("pool")))


def conform_v23(df: DataFrame) -> DataFrame:
    return df.withColumn("pk", F.concat_ws(":", "kind", "quote"))


def merge_rails(*rails: DataFrame) -> DataFrame:
    """SRC-3: union of the rails. Order is imposed by windows over (ts, blk, li) where it matters, so how the files
    are cut into days is of no consequence."""
    out = rails[0]
    for r in rails[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out.withColumn("blk", F.coalesce("blk", F.lit(0))).withColumn("li", F.coalesce("li", F.lit(0)))


def dedupe_union(sources: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """SRC-4: union on the keys; the first source in the list wins, then the first row in ``order``.

    An aggregate that keeps one row per key combines before the shuffle, so a key with any number of copies is cheap.
    """
    keys, order = list(keys), list(order)
    ranked = None
    for i, s in enumerate(sources):
        one = s.withColumn("_src", F.lit(i))
        ranked = one if ranked is None else ranked.unionByName(one, allowMissingColumns=True)
    cols = [c for c in ranked.columns if c not in (*keys, "_src")]
    pick = F.min_by(F.struct(*cols), F.struct("_src", *order))
    return ranked.groupBy(*keys).agg(pick.alias("_r"), F.count("*").alias("copies")).select(*keys, "_r.*", "copies")


def time_cut(df: DataFrame, lo: int, hi: int, ts: str = "ts") -> DataFrame:
    """SRC-5: rows with lo <= ts < hi."""
    return df.filter((F.col(ts) >= lo) & (F.col(ts) < hi))


def time_cut_report(df: DataFrame, lo: int, hi: int, seq: str, ts: str = "ts", slice_len: int = 1_000_000) -> DataFrame:
    """SRC-5, report: kept, before and after the cut, order inversions and the largest lateness in file order."""
    from tidemark.operators.slicing import running
    got = running(df.withColumn("_k", F.lit(0)), ["_k"], [seq], {"_p": ("last", F.col(ts)), "_m": ("max", F.col(ts))},
                  F.floor(F.col(seq) / slice_len), include_current=False)
    t = F.col(ts)
    return got.agg(
        F.count_if((t >= lo) & (t < hi)).alias("kept"), F.count_if(t < lo).alias("before"), F.count_if(t >= hi).alias("after"),
        F.count_if(F.coalesce(t < F.col("_p"), F.lit(False))).alias("inversions"),
        F.max(F.greatest(F.coalesce(F.col("_m") - t, F.lit(0)), F.lit(0))).alias("max_late"))


def assert_sealed(df: DataFrame, cols: Sequence[str], seal: int) -> DataFrame:
    """SRC-6: the job fails when any of the time columns reaches the seal."""
    late = F.lit(False)
    for c in cols:
        late = late | F.coalesce(F.col(c) >= seal, F.lit(False))
    check = F.when(late, F.raise_error(F.concat(F.lit("row at or after the seal: "), F.to_json(F.struct(*cols))))).otherwise(F.lit(True))
    return df.filter(check.cast("boolean"))


def min_birth(*sources: DataFrame) -> DataFrame:
    """SRC-10: earliest birth per token over several ledgers with columns tok, birth_ts."""
    out = sources[0].select("tok", "birth_ts")
    for s in sources[1:]:
        out = out.unionByName(s.select("tok", "birth_ts"))
    return out.filter("birth_ts is not null").groupBy("tok").agg(F.min("birth_ts").alias("birth_ts"))


def write_trades(df: DataFrame, path: str, by: str = "cell") -> None:
    """SRC-11: trade rows as parquet by cell."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def write_results(df: DataFrame, path: str, key: Sequence[str]) -> None:
    """SRC-11: result blocks as one JSON document per key."""
    body = [c for c in df.columns if c not in key]
    df.select(F.to_json(F.struct(*key, F.struct(*body).alias("result"))).alias("value")).write.mode("overwrite").text(path)


def upsert_store(store: DataFrame, new: DataFrame, key: Sequence[str], batch: str | None = None) -> DataFrame:
    """SRC-12: families present in ``new`` replace the stored ones; with ``batch`` the later batch wins per key."""
    if batch:
        last = new.groupBy(*key).agg(F.max(batch).alias("_b"))
        new = new.join(last, list(key)).filter(F.col(batch) == F.col("_b")).drop("_b")
    kept = store.join(new.select(*key).distinct(), list(key), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)
