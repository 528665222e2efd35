"""Exact copies against a plain grouping."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

from tidemark.llm import exact_copies as EC
from tidemark.llm.counted import join_counted


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def plain(rows):
    """rows (doc_id, text) to (doc_id, keep_id, group_size, digest) sorted, and the kept (doc_id, text) with their number."""
    g = defaultdict(list)
    for i, t in rows:
        g[lower(t)].append(i)
    most = {t: max((i for i in ids if i is not None), default=None) for t, ids in g.items()}
    out = [(i, most[lower(t)], len(g[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in rows]
    return sorted(out, key=str), sorted(((most[t], t) for t in g), key=str)


def check(spark, df, rows):
    want, kept = plain(rows)
    got = EC.mark_copies(df, all_digests=True).collect()
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], key=str) == want
    assert sorted([(r["doc_id"], r["text_sha256"]) for r in got if r["kept"]], key=str) == sorted([(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in kept], key=str)
    stay = EC.drop_copies(df)
    assert stay.columns == df.columns and sorted([(r["doc_id"], lower(r["text"])) for r in stay.collect()], key=str) == kept


def test_against_plain_grouping(spark):
    """Same length, same prefix, case, letters outside A-Z, a hot group, a hot length, large ids beside nulls, ties."""
    body = "x" * 70
    texts = ["", None, " ", "a", "A", "b", "É", "é", body + "1", body + "2", body.upper() + "1", "ab" * 5000, "AB" * 5000, "ab" * 4999 + "ac", "İ", "i̇"]
    rows = [(2**60 + 7 * i, t) for i, t in enumerate(texts * 2)] + [(None, "a"), (None, "only null"), (None, "only null"), (2**60, "tie"), (2**60, "tie"), (-3, "tie")]
    rows += [(i, "hot Copy" if i % 2 else "HOT copy") for i in range(1500)] + [(10_000 + i, f"{i:08d}") for i in range(1500)]
    check(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(7), rows)


def test_odd_rows_and_clashing_names(spark, odd):
    df, rows = odd
    check(spark, df, [(r[0], r[1]) for r in rows])
    clash = df.withColumnRenamed("size", "group_size").withColumnRenamed("row", "kept")
    out = EC.mark_copies(clash)
    assert {"group_size", "group_size_in", "kept", "kept_in"} <= set(out.columns) and out.count() == len(rows)
    assert sorted(r["group_size_in"] or 0 for r in out.collect()) == sorted(r[6] or 0 for r in rows)
    assert EC.drop_copies(clash).columns == clash.columns
    assert EC.mark_copies(df.limit(0)).count() == 0 and EC.drop_copies(df.limit(0)).count() == 0


def test_whole_texts_are_read_for_survivors_only(spark):
    rows = [(1, "a"), (2, "bb"), (3, "c" * 100 + "d"), (4, "c" * 100 + "e"), (5, "q" * 101)]
    got = {r["doc_id"]: r["text_sha256"] is not None for r in EC.mark_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: False, 2: False, 3: True, 4: True, 5: False}


def test_hot_keys_are_not_shuffled(spark):
    rows = spark.range(6000).selectExpr("id", "case when id % 3 = 0 then -1 else id end as k")
    counted = rows.groupBy("k").count().withColumnRenamed("count", "n")
    for how in ("inner", "left"):
        part = counted.filter("k <> 1")
        got = join_counted(rows, part, ["k"], "n", how)
        assert got.count() == (5999 if how == "inner" else 6000)
        assert got.filter("k = -1 and n = 2000").count() == 2000
