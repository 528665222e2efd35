"""64-bit integers beside nulls pass unchanged, as ids and as columns carried along; draws beyond numpy's range."""

from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import mixing, packing, quality_rules

BIG = 2**60
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ref long, kept long"


@pytest.fixture(scope="module")
def rows(spark):
    text = " ".join(f"w{(7 * i) % 83}" for i in range(90)) + "."
    data = [(BIG + 1, text + " one", "en", "a", 5, BIG + 9, 1), (None, text + " two", "en", "a", 5, None, None), (BIG + 3, text + " three", "en", None, 5, BIG + 7, 3),
            (2**53 + 1, "short", "en", "b", None, BIG + 5, 4)]
    return spark.createDataFrame(data, SCHEMA).coalesce(1), data


def ids(df):
    return sorted({r["doc_id"] for r in df.select("doc_id").collect()}, key=str)


def test_ids_pass_unchanged(rows):
    df, data = rows
    want = sorted((r[0] for r in data), key=str)
    assert ids(packing.pack(df)) == want and ids(quality_rules.cascade(df)) == want and ids(mixing.mixed_documents(df)) == want
    good = quality_rules.keep_good(df)
    assert good.columns == df.columns
    assert sorted(map(tuple, good.collect()), key=str) == sorted((d for d in data if d[1] != "short"), key=str)
    mixed = {(r["doc_id"], r["ref"], r["kept"]) for r in mixing.mixed_documents(df).collect()}
    assert mixed == {(d[0], d[5], d[6]) for d in data}


def test_clashing_names_stay(rows):
    df, data = rows
    out = quality_rules.cascade(df)
    assert sorted((r["doc_id"], r["kept_in"]) for r in out.filter("doc_id is not null").collect()) == sorted((d[0], d[6]) for d in data if d[0])


def test_stages_keep_ids(spark, rows):
    df, data = rows
    for name in ("quality_rules", "near_dedup", "secret_scan", "mix_sources"):
        got = dict(corpus_pipeline.STAGES)[name](spark, df, "")
        assert set(ids(got)) <= {d[0] for d in data} and got.columns == df.columns


def test_large_draws_follow_the_distribution(monkeypatch):
    """The same draws by numpy and by the sampler for large urns agree in mean, spread and shape."""
    cases = [(60_000, 50_000, 40_000), (9_000, 200_000, 100_000), (300_000, 5_000, 8_000), (40, 10_000, 5_000), (10_000, 30, 6_000)]
    for good, bad, sample in cases:
        plain = np.random.default_rng(1).hypergeometric(good, bad, sample, 20_000)
        monkeypatch.setattr(mixing, "EXACT", 0)
        rng = np.random.default_rng(2)
        own = np.array([mixing._hypergeometric(rng, good, bad, sample) for _ in range(20_000)])
        monkeypatch.undo()
        sd = plain.std()
        assert abs(own.mean() - plain.mean()) < 0.05 * sd + 1e-9 and abs(own.std() - sd) < 0.03 * sd
        q = np.linspace(0.01, 0.99, 25)
        assert np.abs(np.quantile(own, q) - np.quantile(plain, q)).max() <= max(2, 0.12 * sd)


def test_draws_at_any_size():
    rng = np.random.default_rng(3)
    for good, bad, sample in [(10**12, 3 * 10**12, 10**12), (10**15, 10**15, 10**15), (5, 10**12, 10**11), (10**12, 7, 10**12)]:
        n = good + bad
        draws = [mixing._hypergeometric(rng, good, bad, sample) for _ in range(400)]
        assert all(max(0, sample - bad) <= d <= min(good, sample) for d in draws)
        sd = (sample * (good / n) * (bad / n) * ((n - sample) / (n - 1))) ** 0.5
        mean = sum(d * n - sample * good for d in draws) / len(draws) / n
        assert abs(mean) < 0.25 * sd + 0.01
    split = mixing.split_quotas(np.array([10**13, 5 * 10**12, 3]), 16, 5)
    assert split.sum(axis=1).tolist() == [10**13, 5 * 10**12, 3] and np.ptp(split.sum(axis=0)) <= 1


def test_shards_follow_the_quotas(spark):
    """The words of each source in a shard are its blocks of ``split_quotas``, also where a document lies over many blocks."""
    long = [(i, " ".join(f"{s}{i}x{k}" for k in range(3000)), "en", s, 0) for i, s in enumerate("aabbc")]
    short = [(100 + i, f"q{i} " * 20, "en", "abc"[i % 3], 0) for i in range(300)]
    df = spark.createDataFrame(long + short, "doc_id long, text string, lang string, source string, n_chars long")
    opts = dict(shards=4, block=50, min_blocks=1)
    plan = {r["_k"][1:]: r for r in mixing._plan(spark, mixing.source_targets(df.selectExpr("source", "size(split(trim(text), ' +')) as n").groupBy("source").agg(
        {"n": "sum"}).withColumnRenamed("sum(n)", "source_size")), 4, 50, 1, mixing.SEED).collect()}
    out = mixing.by_shard(df, **opts).selectExpr("_shard", "source", "size(split(trim(text), '[ \n]+')) as n").groupBy("_shard", "source").sum("n").collect()
    for r in out:
        cuts = [0, *plan[r["source"]]["_cuts"]]
        want = (cuts[r["_shard"] + 1] - cuts[r["_shard"]]) * 50
        assert abs(r["sum(n)"] - want) <= 2 * 50, (r, want)
    assert len(out) == 12


def test_equal_rows_are_separate_and_spread(spark):
    df = spark.createDataFrame([(1, "a b c d", "en", "s", 7)] * 500, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert mixing.mix(df, slice_rows=10).count() == 500
