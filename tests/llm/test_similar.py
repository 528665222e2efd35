"""Near-duplicates of the pipeline stage against brute-force Jaccard."""

from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
import pytest
from tidemark.llm import similar
from tidemark.session import cut_lineage
from test_documents import families


def brute(rows):
    sets = [similar.shingles(t) for _, t in rows]
    fam = families(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if similar.jaccard(sets[i], sets[j]) >= similar.SIMILAR])
    return sorted(min(rows[i][0] for i in range(len(rows)) if fam[i] == f) for f in set(fam))


def test_stage_drops_what_jaccard_links(spark):
    """Edited copies on both sides of 0.8, a large group of near copies, texts that share a passage, short and empty texts."""
    r = random.Random(3)
    word = lambda: f"w{r.randrange(5000)}"
    texts = []
    for _ in range(40):
        w = [word() for _ in range(r.choice([50, 200, 900]))]
        texts.append(w)
        for share in (0.005, 0.02, 0.025, 0.04):
            c = list(w)
            for i in r.sample(range(len(w)), max(1, int(share * len(w)))):
                c[i] = word()
            texts.append(c)
    base = [word() for _ in range(150)]
    for _ in range(300):
        c = list(base)
        for i in r.sample(range(150), r.randrange(5)):
            c[i] = word()
        texts.append(c)
    texts += [base + [word() for _ in range(n)] for n in (10, 30, 60, 100, 150, 150)]
    texts = [" ".join(t) for t in texts] + ["", None, " \n", "a b", "A  b", "a b c", "a b c d e", "a b c d e f"]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(x["doc_id"] for x in got.collect()) == brute(rows)


def test_hot_buckets(spark):
    """Thousands of near copies of one text, and a family whose members share half of their words but are no near copies, some of them linked."""
    r = random.Random(9)
    word = lambda: f"w{r.randrange(50000)}"
    base = [word() for _ in range(120)]
    rows = []
    for i in range(3000):
        c = list(base)
        c[r.randrange(120)] = f"own{i}"
        rows.append(c)
    half = [word() for _ in range(100)]
    for i in range(400):
        c = half + [word() for _ in range(60)]
        rows.append(c)
        if i % 4 == 0:
            rows.append(c[:-2] + [word()])
    r.shuffle(rows)
    rows = [(i, " ".join(c)) for i, c in enumerate(rows)]
    copies = [x for x in rows if "own" in x[1]]
    rest = [x for x in rows if "own" not in x[1]]
    got = {x["doc_id"] for x in similar.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, t in copies} & got == {copies[0][0]}
    assert sorted(got - {copies[0][0]}) == brute(rest)


def edited(r, base, edits):
    c = list(base)
    for i in r.sample(range(len(base)), edits):
        c[i] = f"w{r.randrange(50000)}"
    return c


def test_simhash_pairs_join_what_lies_within_two_bits(spark):
    r = random.Random(5)
    texts = []
    for _ in range(8):
        base = [f"w{r.randrange(50000)}" for _ in range(600)]
        texts += [" ".join(edited(r, base, n)) for n in (0, 0, 1, 1, 1, 2, 3, 8)]
    items = cut_lineage(similar.marks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).dropDuplicates(["key"]))
    rows = items.select("doc_id", "key", "fp").collect()
    for x in rows:
        h = [int(v) for v in similar.hashed(texts[x["doc_id"]], {})]
        assert x["fp"] % 2**64 == sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))
    at = {x["key"]: i for i, x in enumerate(rows)}
    far = lambda i, j: ((rows[i]["fp"] ^ rows[j]["fp"]) % 2**64).bit_count()
    got = [(at[p["a"]], at[p["b"]]) for p in similar._fingerprint_pairs(items).collect()]
    assert max(far(i, j) for i, j in got) in (1, 2)
    near = [(i, j) for i in range(len(rows)) for j in range(i) if far(i, j) <= 2]
    assert families(len(rows), got) == families(len(rows), near)


@pytest.mark.parametrize("two", [False, True])
def test_forest_joins_what_brute_force_joins(two):
    r = random.Random(11)
    base = [f"w{i}" for i in range(80)]
    sets = [similar.hashed(" ".join(edited(r, base, r.randrange(4))), {}).view(np.int64) for _ in range(120)]
    at, side = np.array([i if i % 3 else 0 for i in range(120)]), np.array([i % 2 if two else 0 for i in range(120)])
    true = [(i, j) for i in range(120) for j in range(i) if similar.jaccard({*sets[i]}, {*sets[j]}) >= 0.8 and (not two or side[i] != side[j])]
    known = [(i, 0) for i in range(0, 120, 3)]
    got = similar.forest(at, side, sets, 0.8)
    assert 0 < len(got) < len({*at}) and {(max(p), min(p)) for p in got} <= {*true}
    assert families(120, known + got) == families(120, known + true)


@pytest.mark.parametrize("block", [similar.BLOCK, 4000])
def test_family_just_below_the_similarity(spark, monkeypatch, block):
    """Hundreds of texts of one family, few of them linked: rows stay below the number of texts, also if a bucket takes several blocks."""
    r, made = random.Random(13), []
    base = [f"b{i}" for i in range(150)]
    rows = [(i, " ".join(edited(r, base, r.randrange(1, 5)))) for i in range(400)]
    later = similar._later_links

    def counted(*args):
        made.append(cut_lineage(later(*args)))
        return made[-1]

    monkeypatch.setattr(similar, "_later_links", counted)
    monkeypatch.setattr(similar, "BLOCK", block)
    got = similar.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(x["doc_id"] for x in got.collect()) == brute(rows)
    assert made[0].count() < len(rows)


def test_stage_on_the_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(x["doc_id"], x["text"]) for x in docs.collect()]
    assert sorted(x["doc_id"] for x in corpus_pipeline.near_dedup(spark, docs, sf).collect()) == brute(rows)


def test_odd_rows(spark, odd):
    df, rows = odd
    got = similar.keep_first(df)
    assert got.columns == df.columns
    out = [tuple(x) for x in got.collect()]
    assert len(out) == len(set(out)) and all(x in rows for x in out)
    assert similar.keep_first(df.limit(0)).count() == 0
