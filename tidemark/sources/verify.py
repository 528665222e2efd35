"""Verification of inputs (SRC-7..9): inventories, line profiles, big JSON objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def inventory(spark: SparkSession, path: str, pattern: str = r"([^/]+)$") -> DataFrame:
    """Name, size and sha256 of every file below ``path``; hashing runs where the files are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", pattern, 1).alias("name"), F.col("length").alias("bytes"),
                        F.sha2("content", 256).alias("sha256"))


def compare_inventory(found: DataFrame, registry: DataFrame) -> DataFrame:
    """SRC-7: one row per name with ok / missing / unregistered / ambiguous / mismatch."""
    have = found.groupBy("name").agg(F.count("*").alias("n"), F.min("bytes").alias("bytes"), F.min("sha256").alias("sha256"))
    reg = registry.select("name", F.col("bytes").alias("want_bytes"), F.col("sha256").alias("want_sha256"))
    both = have.join(reg, "name", "full")
    same = (F.col("bytes") == F.col("want_bytes")) & (F.col("sha256") == F.col("want_sha256"))
    return both.select("name", F.when(F.col("n").isNull(), "missing").when(F.col("want_sha256").isNull(), "unregistered")
                       .when(F.col("n") > 1, "ambiguous").when(same, "ok").otherwise("mismatch").alias("status"))


def profile_lines(lines: DataFrame, file: str, line: str, seal: int, ts_field: str = "ts") -> DataFrame:
    """SRC-8: per file, lines by fault class, first and last time, and rows at or after the seal.

    A line is empty, unparsable, not an object, without a numeric time, or fine; the classes exclude each other.
    """
    s = F.trim(F.col(line))
    doc = F.try_parse_json(s)
    kind, t_kind = F.schema_of_variant(doc), F.schema_of_variant(F.try_variant_get(doc, f"$.{ts_field}", "variant"))
    numeric = F.coalesce(t_kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), F.lit(False))
    cls = (F.when(F.length(s) == 0, "empty").when(doc.isNull(), "unparsable").when(~kind.startswith("OBJECT"), "not_object")
           .when(~numeric, "no_time").otherwise("fine"))
    got = lines.select(file, cls.alias("cls"), F.when(cls == "fine", F.try_variant_get(doc, f"$.{ts_field}", "double")).alias("t"))
    n = lambda c: F.count_if(F.col("cls") == c).alias(c)
    return got.groupBy(file).agg(F.count("*").alias("lines"), n("empty"), n("unparsable"), n("not_object"), n("no_time"),
                                 n("fine"), F.min("t").alias("min_t"), F.max("t").alias("max_t"),
                                 F.count_if(F.col("t") >= seal).alias("sealed"))


def key_sets(lines: DataFrame, line: str) -> DataFrame:
    """SRC-8: how often each set of top-level keys occurs."""
    keys = F.array_join(F.sort_array(F.json_object_keys(line)), ",")
    return lines.select(keys.alias("key_set")).groupBy("key_set").agg(F.count("*").alias("n"))


def read_kv_json(spark: SparkSession, path: str, value_ddl: str) -> DataFrame:
    """SRC-9: one JSON object per file as (key, value) rows."""
    text = spark.read.option("wholetext", "true").text(path)
    return explode_kv(text, "value", value_ddl)


def explode_kv(df: DataFrame, col: str, value_ddl: str) -> DataFrame:
    """SRC-9: rows of a JSON object column; each line may hold its own object, so large tables stay splittable."""
    parsed = F.from_json(F.col(col), f"map<string,{value_ddl}>")
    return df.select(F.explode(parsed).alias("key", "value"))
