"""Document fingerprints by locally consistent parsing.

The code points of a text are names of level 0. On each level runs of one name are collapsed, then deterministic coin tossing gives every
name a small label from the lowest bit in which it differs from its left neighbour (three rounds bring 64-bit names to labels below 8,
neighbours always distinct), and a phrase begins at every local maximum of the labels. A phrase is named by a hash of its parts. Where a
phrase begins depends on a few neighbours only, so equal substrings get equal interior phrases wherever they stand. The names of
level ``FIRST_LEVEL`` and above, and the last single name, are the text's signature set; the fingerprint keeps for each of ``SLOTS`` bins
the low byte of the least hash in it, and two fingerprints' likeness estimates the resemblance of their sets.

Defined results: null is the empty text; an empty text's fingerprint is all zeros, like only to itself; equal texts have equal
fingerprints; documents with equal ids follow one another in the order of their text's hash; null ids come last; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.common import query, table
from tidemark.session import cut_lineage

SLOTS = 64
FIRST_LEVEL = 2
BATCH_CHARS = 1 << 19
_M1, _M2, _STEP = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))
_EMPTY = np.iinfo(np.uint64).max


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _label_table(size: int) -> np.ndarray:
    """label[left, own] of the next round for labels below ``size``."""
    left, own = np.meshgrid(np.arange(size), np.arange(size), indexing="ij")
    x = left ^ own
    bit = np.bitwise_count((x & -x) - 1)
    return np.where(x == 0, 0, 2 * bit + ((own >> bit) & 1)).astype(np.uint8)


_ROUNDS = (_label_table(128), _label_table(16))


def _labels(names: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Three rounds of coin tossing; a text's first name is compared with itself in the lowest bit flipped."""
    left = np.empty_like(names)
    left[1:] = names[:-1]
    left[starts] = names[starts] ^ np.uint64(1)
    x = names ^ left
    bit = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1))
    label = (2 * bit + ((names >> bit) & np.uint64(1)).astype(np.uint8)).astype(np.uint8)
    for step in _ROUNDS:
        before = np.empty_like(label)
        before[1:] = label[:-1]
        before[starts] = label[starts] ^ 1
        label = step[before, label]
    return label


def _collapse(names: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One name per run of equal names inside a text; ``starts`` follow."""
    first = np.ones(len(names), dtype=bool)
    first[1:] = names[1:] != names[:-1]
    first[starts] = True
    if first.all():
        return names, starts
    at = np.flatnonzero(first)
    run = np.diff(at, append=len(names)).astype(np.uint64)
    kept = names[at]
    long = run > 1
    kept[long] = _mix(kept[long] + run[long] * _STEP)
    return kept, np.searchsorted(at, starts)


def _next_level(names: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases one level up and where each text begins among them."""
    names, starts = _collapse(names, starts)
    label = _labels(names, starts)
    cut = np.zeros(len(names), dtype=bool)
    cut[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    ends = starts[1:] - 1
    cut[ends] = False  # a text's last name has no right neighbour
    cut[starts] = True
    at = np.flatnonzero(cut)
    place = np.arange(len(names)) - np.repeat(at, np.diff(at, append=len(names)))
    parts = _mix(names + (place.astype(np.uint64) + np.uint64(1)) * _STEP)
    return _mix(np.add.reduceat(parts, at)), np.searchsorted(at, starts)


def sketches(texts: Sequence[str | None]) -> np.ndarray:
    """Fingerprints (texts x SLOTS bytes)."""
    codes = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), dtype="<u4") for t in texts]
    out = np.full((len(texts), SLOTS), _EMPTY, dtype=np.uint64)
    doc = np.array([i for i, c in enumerate(codes) if len(c)], dtype=np.int64)
    full = len(doc)
    names = np.concatenate([codes[i] for i in doc]).astype(np.uint64) if full else np.zeros(0, dtype=np.uint64)
    starts = np.concatenate(([0], np.cumsum([len(codes[i]) for i in doc])[:-1])).astype(np.int64) if full else doc
    flat = out.reshape(-1)
    level = 0
    while len(doc):
        length = np.diff(starts, append=len(names))
        single = length == 1
        if level >= FIRST_LEVEL:
            wanted = names
            owner = np.repeat(doc, length)
        else:
            wanted, owner = names[starts[single]], doc[single]
        h = _mix(wanted ^ _STEP)
        np.minimum.at(flat, owner * SLOTS + (h >> np.uint64(58)).astype(np.int64), h & np.uint64((1 << 58) - 1))
        if single.any():
            keep = np.repeat(~single, length)
            names, doc, length = names[keep], doc[~single], length[~single]
            starts = np.concatenate(([0], np.cumsum(length)[:-1])).astype(np.int64) if len(doc) else doc
        if len(doc):
            names, starts = _next_level(names, starts)
        level += 1
    # an empty bin borrows from the next filled one to its right, marked by the distance
    empty = out == _EMPTY
    some = np.flatnonzero(empty.any(axis=1) & ~empty.all(axis=1))
    have, base = out[some], empty[some]
    need, filled = base.copy(), have.copy()
    for step in range(1, SLOTS):
        if not need.any():
            break
        take = need & ~np.roll(base, -step, axis=1)
        filled[take] = _mix(np.roll(have, -step, axis=1)[take] + _mix(np.array([step], dtype=np.uint64)))
        need &= ~take
    out[some] = filled
    out[empty.all(axis=1)] = 0
    return (out & np.uint64(255)).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1: share of equal bins, less what chance alone makes equal (one in 256)."""
    same = (a == b).mean(axis=-1)
    return np.maximum(0.0, (same - 1 / 256) / (1 - 1 / 256))


def _batched(texts: list[str]) -> np.ndarray:
    """``sketches`` in portions of bounded length."""
    parts, lo, size = [], 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > BATCH_CHARS:
            parts.append(sketches(texts[lo:i + 1]))
            lo, size = i + 1, 0
    if lo < len(texts) or not parts:
        parts.append(sketches(texts[lo:]))
    return np.concatenate(parts)


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _pairs(ids: list, texts: list[str], prints: np.ndarray, following: list[str], next_prints: np.ndarray) -> dict[str, list]:
    edited = [_edited(t, f) for t, f in zip(texts, following, strict=True)]
    marks = _batched(edited)
    return {
        "doc_id": ids, "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
        "fingerprint": [x.tobytes().hex() for x in prints], "edited_fingerprint": [x.tobytes().hex() for x in marks],
        "near_edited": likeness(prints, marks).tolist(), "near_next": likeness(prints, next_prints).tolist()}


RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _batch(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    """Columns that are not given are null."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), type=f.type) for f in schema], schema=schema)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and its likeness to this and to the next document's (descending doc_id).

    Texts are shuffled once, into ranges of (doc_id, hash). Within a range each row meets the next as the rows stream by. A range's first
    and last rows are written aside, and the last meets the first of the next range in a join of one row a range.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    order = [F.col("doc_id").desc_nulls_last(), F.col("_h")]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_h", F.xxhash64("text"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    schema = f"doc_id {kind}, {RESULT}, _part int, _edge string, _text string"
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def walk(batches: Iterable[pa.RecordBatch]):
        part = TaskContext.get().partitionId()
        held = None  # last row so far: id, text, fingerprint
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if not ids:
                continue
            prints = _batched(texts)
            if held is None:
                yield _batch({"doc_id": [None], "_part": [part], "_edge": ["first"], "_text": [texts[0]]}, arrow)
            else:
                ids, texts, prints = [held[0], *ids], [held[1], *texts], np.concatenate([held[2][None], prints])
            held = (ids[-1], texts[-1], prints[-1])
            if len(ids) > 1:
                yield _batch(_pairs(ids[:-1], texts[:-1], prints[:-1], texts[1:], prints[1:]), arrow)
        if held is not None:
            yield _batch({"doc_id": [held[0]], "_part": [part], "_edge": ["last"], "_text": [held[1]]}, arrow)

    done = cut_lineage(rows.select("doc_id", "text").mapInArrow(walk, schema))
    edges = done.filter("_edge is not null")
    firsts = edges.filter("_edge = 'first'").select(F.col("_part").alias("_p"), F.col("_text").alias("_next"))
    # the range after each: by number, from the last to the first; one row a range
    around = W.orderBy("_part")
    after = edges.filter("_edge = 'first'").select("_part").withColumn("_least", F.min("_part").over(W.partitionBy(F.lit(0)))).withColumn(
        "_p", F.coalesce(F.lead("_part").over(around), F.col("_least")))
    ends = edges.filter("_edge = 'last'").join(after.select("_part", "_p"), "_part").join(firsts, "_p").select("doc_id", "_text", "_next")

    result = f"doc_id {kind}, {RESULT}"
    narrow = to_arrow_schema(T._parse_datatype_string(result))

    def close(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            ids, texts, following = (c.to_pylist() for c in batch.columns)
            if ids:
                yield _batch(_pairs(ids, texts, _batched(texts), following, _batched(following)), narrow)

    last = ends.mapInArrow(close, result)
    return done.filter("_edge is null").select(*last.columns).unionByName(last)


@query("op7_phrases")
def op7_phrases(spark, sf_dir):
    return compare_with_next(table(spark, sf_dir, "documents"))
