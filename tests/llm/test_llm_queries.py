"""The registered queries on a whole table: SQL where there is some, else plain versions; the pipeline stage by stage."""

from __future__ import annotations

import re

import pytest
from check import compare
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark import llm
from tidemark.session import cut_lineage
from test_documents import WORD
from test_similar import brute

QUERIES, SQL = llm.load()
COLUMNS = {
    "op1_simhash": {"doc_id", "fingerprint", "component_id"}, "op2_quality_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op3_quality_crf": {"doc_id", "held_out", "score", "predicted"}, "op4_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op5_language_model": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op7_phrases": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op10_mixing": {"doc_id", "size", "source_size", "target", "taken"}}


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert all(n in SQL for n in ("op2_quality_rules", "op8_licenses", "op9_tool_calls", "op11_exact_copies"))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, sf, name):
    df = QUERIES[name](spark, sf)
    cur = con.execute(SQL[name])
    diff = compare([tuple(r) for r in df.collect()], df.columns, cur.fetchall(), [d[0] for d in cur.description])
    assert diff is None, diff


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_covers_every_document(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert COLUMNS[name] <= set(df.columns)
    ids = sorted(r[0] for r in df.select("doc_id").distinct().collect())
    assert ids == sorted(r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect())


def test_pipeline_against_plain_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    stages, out = dict(corpus_pipeline.STAGES), docs
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        out = cut_lineage(stage(spark, out, sf))
        got[name] = out
    assert list(stages) == ["quality_rules", "near_dedup", "secret_scan", "mix_sources", "pack_windows"]
    kept = {r["doc_id"] for r in QUERIES["op2_quality_rules"](spark, sf).filter("kept").collect()}
    assert {r["doc_id"] for r in got["quality_rules"].collect()} == kept
    order = sorted(kept)
    assert sorted(r["doc_id"] for r in got["near_dedup"].collect()) == brute([(i, text[i]) for i in order])
    masked = {r["doc_id"]: r["text"] for r in got["secret_scan"].collect()}
    for i, t in masked.items():
        assert t == re.sub(r'(?<=token = ")[0-9a-f]{40}|(?<=password=)[0-9a-f]{18}|(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])', "<secret>", text[i])
    words = lambda t: len(WORD.findall(t or ""))
    mixed = got["mix_sources"].collect()
    assert sum(words(r["text"]) for r in mixed) == pytest.approx(1.5 * sum(map(words, masked.values())), rel=0.02)
    whole = {i: WORD.findall(t) for i, t in masked.items()}
    for r in mixed:
        assert words(r["text"]) <= len(whole[r["doc_id"]]) and r["n_chars"] == len(r["text"])
    pieces = got["pack_windows"].agg(F.sum("length").alias("n"), F.countDistinct("sequence_id").alias("s")).first()
    assert pieces["s"] <= pieces["n"] / 1024 + got["mix_sources"].rdd.getNumPartitions()
    assert corpus_pipeline.run(spark, sf).count() == got["pack_windows"].count()
