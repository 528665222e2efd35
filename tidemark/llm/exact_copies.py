"""Exact copies by progressive refinement: group by length, then by the hash of a prefix, then by the hash of the whole text.

Lowering A-Z keeps the number of bytes, so the first step needs no text to be lowered. Only rows whose length occurs twice have their prefix
lowered and hashed; only rows whose length and prefix hash occur twice have the whole text lowered and hashed (SHA-256) to be grouped. All
of it is DataFrame work. Every grouping is combined before it is shuffled; a key with a large share of the rows (one length, one boilerplate
prefix, one group of copies) is joined without shuffling its rows (``counted.join_counted``).

Defined results: a null text counts as empty; of equal texts the row with the largest doc_id stays, a null doc_id being less than any other;
of rows with equal text and doc_id exactly one stays; an empty table gives no rows. Columns of the input are carried, and those named like a
result get the suffix ``_in``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import make_room, query, table
from tidemark.llm.counted import ascii_lower, join_counted
from tidemark.session import cut_lineage

PREFIX = 64
RESULTS = ("keep_id", "group_size", "kept", "text_sha256")


def candidates(docs: DataFrame, prefix: int = PREFIX) -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``_len`` and ``_pre``, and the table (_len, _pre, _n) of those pairs that two rows or more have."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumn("_len", F.octet_length(text))
    lengths = cut_lineage(rows.groupBy("_len").agg(F.count("*").alias("_n")).filter("_n > 1"))
    start = F.substring(text, 1, prefix)
    hashed = lambda c: F.xxhash64(ascii_lower(c)).alias("_pre")
    repeated = join_counted(rows.select("_len", start.alias("_start")), lengths, ["_len"], "_n").select("_len", hashed(F.col("_start")))
    pairs = cut_lineage(repeated.groupBy("_len", "_pre").agg(F.count("*").alias("_n")).filter("_n > 1"))
    return rows.withColumn("_pre", hashed(start)), pairs


def mark_copies(docs: DataFrame, prefix: int = PREFIX, all_digests: bool = False, carry: list[str] | None = None) -> DataFrame:
    """The columns of ``docs`` (or those of ``carry``), without the text unless carried, with keep_id, group_size, kept and text_sha256.

    The digest is null for texts that no step found a partner for, as they are never read whole; ``all_digests`` fills it in the same
    task for reports that want one for every row. It has no part in the grouping of those rows.
    """
    docs = make_room(docs, RESULTS)
    keep = [c for c in docs.columns if c != "text"] if carry is None else carry
    rows, pairs = candidates(docs, prefix)
    rows = join_counted(rows.select(*dict.fromkeys([*keep, "text", "_len", "_pre"])), pairs, ["_len", "_pre"], "_n", "left")
    survives = F.col("_n").isNotNull()
    digest = F.sha2(ascii_lower(F.coalesce("text", F.lit(""))).cast("binary"), 256)
    read = cut_lineage(rows.select(*dict.fromkeys([*keep, "doc_id"]), survives.alias("_met"), F.monotonically_increasing_id().alias("_row"),
                                   (digest if all_digests else F.when(survives, digest)).alias("text_sha256")))
    met = read.filter("_met")
    best = F.max(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "_row")).alias("best")
    found = cut_lineage(met.groupBy("text_sha256").agg(best, F.count("*").alias("group_size")))
    copies = join_counted(met, found, ["text_sha256"], "group_size").select(
        *keep, F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("best._row") == F.col("_row")).alias("kept"), "text_sha256")
    single = read.filter("not _met").select(
        *keep, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return copies.unionByName(single)


def drop_copies(docs: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    renamed = make_room(docs, RESULTS)
    out = mark_copies(docs, prefix, carry=renamed.columns).filter("kept").select(*renamed.columns)
    return out.withColumnsRenamed(dict(zip(renamed.columns, docs.columns, strict=True)))


SQL = """
with d as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as h from documents)
select doc_id, max(doc_id) over (partition by h) as keep_id, count(*) over (partition by h) as group_size,
  doc_id = max(doc_id) over (partition by h) as kept, h as text_sha256
from d
"""


@query("op11_exact_copies", SQL)
def op11_exact_copies(spark, sf_dir):
    return mark_copies(table(spark, sf_dir, "documents").select("doc_id", "text"), all_digests=True)
