"""Near-duplicates by exact Jaccard similarity of word-shingle sets, for pipeline stages.

Two documents are linked if their sets of five-word shingles have a Jaccard similarity of ``SIMILAR`` or more; components of links are
groups. Texts of equal sets are one item first. Candidates come from two places:

- SimHash and BK-trees (``simhash``, whose own query has another contract: three words, two bits): fingerprints of the shingle hashes, those
  within two bits found by a BK-tree per shard. Equal fingerprints give a star.
- At similarity 0.8 about ten of 64 bits differ, which no tree search of 64 bits narrows down. What the trees cannot reach comes from
  min-hashes: ``BANDS`` bands of ``ROWS`` values. A pair at 0.8 shares no band with probability (1 - 0.8^4)^24 = 3e-6.

Small buckets of a band give all pairs. A large one gives a star, and in one band of ``CHAINED`` chains by size (cut into slices of ``SLICE`` members),
so a large group of near copies costs a few pairs a member. A pair is looked at if its sketches agree in more than ``SKETCH`` of their places (at 0.8,
fewer do so with probability 2e-7). Of a document's pairs the one with the best sketch is checked first; the others only if that leaves the two in
different components. Every link is checked on the sets of 64-bit shingle hashes, in the JVM, pair by pair.

A large bucket whose members are in several components after that is compared in full, on the sets themselves, and gives a spanning forest of the links it
finds, never its pairs. A task holds two blocks of a bucket, of about ``BLOCK`` shingles each. The comparisons inside such a bucket grow with the square of
its members in the worst case (a large family of texts just below the similarity); the rows do not until it is larger than a block.

Defined results: null, empty and blank texts are one group; a text of fewer than five words is one shingle; equal rows give one row; the row kept
is that of the least doc_id, null only if all are; an empty table gives no rows; other columns are carried.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import row_hash, shielded
from tidemark.llm.components import smallest_reachable
from tidemark.llm.counted import join_counted
from tidemark.llm.simhash import links as close_fingerprints
from tidemark.session import cut_lineage

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 24, 4
SKETCH = 0.6
SMALL = 8  # members of a bucket that are paired in full
SLICE = 4096  # members of a slice of a large bucket
CHAINED = 6  # of so many bands one makes chains in its large buckets
BLOCK = 1 << 19  # shingles of a block of a large bucket, on average at most
BATCH = 1 << 15
CACHE = 1 << 16
DOCS = 512  # texts taken out of Arrow at a time
SEED = 42

_draw = np.random.default_rng(SEED)
_MULT = _draw.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _draw.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + _draw.integers(0, 2, BANDS * ROWS, dtype=np.uint64)
_PLACE = _draw.integers(0, 1 << 63, max(SHINGLE, ROWS) + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(text: str | None, shingle: int = SHINGLE) -> set:
    """The set whose Jaccard similarity counts."""
    w = words_of(text)
    return {tuple(w)} if 0 < len(w) < shingle else set(zip(*[w[i:] for i in range(shingle)], strict=False))


def jaccard(a: set, b: set) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashed(text: str | None, known: dict) -> np.ndarray:
    """Sorted 64-bit hashes of a text's shingles. ``known`` holds hashes of words between calls."""
    w = words_of(text)
    if not w:
        return np.zeros(0, np.uint64)
    if len(known) > CACHE:
        known.clear()
    for x in set(w):
        if x not in known:
            known[x] = xxhash.xxh64_intdigest(x, SEED)
    h = np.fromiter(map(known.__getitem__, w), np.uint64, len(w))
    k = min(SHINGLE, len(w))
    total = np.full(len(w) - k + 1, k, np.uint64) * _PLACE[-1]
    for i in range(k):
        total += _mix(h[i:len(h) - k + 1 + i] * _PLACE[i])
    return np.unique(_mix(total))


def min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``BANDS * ROWS`` min-hashes for every (non-empty) set."""
    out = np.empty((len(sets), BANDS * ROWS), np.uint64)
    flat, at = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
    for i in range(BANDS * ROWS):
        out[:, i] = np.minimum.reduceat(flat * _MULT[i] + _ADD[i], at)
    return out


def fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a set of 64-bit hashes: bit i is set if it is in over half of them. An empty set has zero."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BATCH):
        ones += np.unpackbits(hashes[i:i + BATCH].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def marks(docs: DataFrame) -> DataFrame:
    """(doc_id, row, key, n, fp, sketch, bands): ``key`` and ``n`` are hash and size of the shingle set, ``fp`` its SimHash."""
    def read(batches: Iterable[pa.RecordBatch]):
        known: dict = {}
        for b in (whole.slice(at, DOCS) for whole in batches for at in range(0, whole.num_rows, DOCS)):
            sets = [hashed(t, known) for t in b.column(2).to_pylist()]
            key = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            low, bands = [b""] * len(sets), [[]] * len(sets)
            full, lo = [i for i, s in enumerate(sets) if len(s)], 0
            while lo < len(full):
                hi, size = lo, 0
                while hi < len(full) and size < BATCH:
                    size += len(sets[full[hi]])
                    hi += 1
                here = full[lo:hi]
                m = min_hashes([sets[i] for i in here])
                short = _mix(m).astype(np.uint8)
                of = np.zeros((len(here), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64) * _PLACE[-1]
                for r in range(ROWS):
                    of += _mix(m[:, r::ROWS] * _PLACE[r])
                of = _mix(of).view(np.int64)
                for j, i in enumerate(here):
                    low[i], bands[i] = short[j].tobytes(), of[j]
                lo = hi
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(key), pa.array([len(s) for s in sets], pa.int64()),
                                              pa.array([fingerprint(s) for s in sets], pa.int64()), pa.array(low, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                                             ["doc_id", "row", "key", "n", "fp", "sketch", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", row_hash(docs).alias("row"), "text").mapInArrow(
        read, f"doc_id {kind}, row long, key long, n long, fp long, sketch binary, bands array<long>")


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of places in which sketches agree."""
    return (a == b).mean(axis=-1)


def _ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _comparable(n: str, m: str):
    """Sets whose sizes alone do not rule the similarity out."""
    return F.least(n, m) >= SIMILAR * F.greatest(n, m)


def _fingerprint_pairs(items: DataFrame) -> DataFrame:
    """Pairs of items by SimHash: those of one fingerprint with its least key, and the least keys of fingerprints that BK-trees link."""
    some = items.filter("n > 0").select("key", "n", "fp")
    first = cut_lineage(some.groupBy("fp").agg(F.count("*").alias("c"), F.min(F.struct("key", "n")).alias("first")))
    same = join_counted(some, first, ["fp"], "c").select(F.col("first.key").alias("a"), F.col("key").alias("b"), F.col("first.n").alias("n"), F.col("n").alias("m"))
    side = lambda c: first.select(F.col("fp").alias(c), F.col("first").alias(f"_{c}"))
    near = close_fingerprints(first.select("fp"), stars=False).join(side("a"), "a").join(side("b"), "b").select(
        *_ordered("_a.key", "_b.key"), F.col("_a.n").alias("n"), F.col("_b.n").alias("m"))
    return same.filter("a <> b").unionByName(near).filter(_comparable("n", "m")).select("a", "b")


def _small_pairs(seats: DataFrame, bucket: str) -> DataFrame:
    """All pairs of buckets of at most ``SMALL`` members (bucket, key, n)."""
    rows = seats.groupBy(bucket).agg(F.collect_list(F.struct("key", "n")).alias("m"))
    pairs = F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: x["key"] < y["key"]), lambda y: F.struct(
        x["key"].alias("a"), y["key"].alias("b"), x["n"].alias("n"), y["n"].alias("m")))))
    return rows.select(F.explode(pairs).alias("p")).select("p.*").filter(_comparable("n", "m")).select("a", "b")


def _star_and_chain(seats: DataFrame, bucket: str) -> DataFrame:
    """Pairs of large buckets: every member with the least key, and with its neighbour by size in its slice."""
    star = seats.filter((F.col("key") != F.col("first.key")) & _comparable("n", "first.n")).select(F.col("first.key").alias("a"), F.col("key").alias("b"))
    part = F.pmod(F.xxhash64("key"), F.floor(F.col("c") / SLICE) + 1)
    near = Window.partitionBy(bucket, "_part").orderBy("n", "key")
    chain = seats.filter(F.col("chains")).withColumn("_part", part).select("key", "n", F.lag("key").over(near).alias("k2"), F.lag("n").over(near).alias("n2"))
    return star.unionByName(chain.filter(F.col("k2").isNotNull() & _comparable("n", "n2")).select(*_ordered("key", "k2")))


def _seats(deal: DataFrame, bucket: str) -> DataFrame:
    """``deal`` (bucket, key, n, ..) with the number of members ``c`` and the ``first`` of its bucket; buckets of one are left out."""
    sizes = cut_lineage(deal.groupBy(bucket).agg(F.count("*").alias("c"), F.min(F.struct("key", "n")).alias("first")).filter("c > 1"))
    return cut_lineage(join_counted(deal, sizes, [bucket], "c"))


def _scored(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """(a, b, like): the pairs that sketches do not rule out, with the share of places that agree."""
    @F.pandas_udf("double")
    def like(a: pd.Series, b: pd.Series) -> pd.Series:
        u, v = (np.frombuffer(b"".join(x), np.uint8).reshape(len(x), -1) for x in (a, b))
        return pd.Series(_agree(u, v))

    side = lambda c: items.select(F.col("key").alias(c), F.col("sketch").alias(f"_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", like("_a", "_b").alias("like")).filter(F.col("like") >= SKETCH)


def _sets(pairs: DataFrame, docs: DataFrame, items: DataFrame) -> DataFrame:
    """(key, set): the shingle hashes of every item that ``pairs`` names, once."""
    def read(batches: Iterable[pa.RecordBatch]):
        known: dict = {}
        for b in (whole.slice(at, DOCS) for whole in batches for at in range(0, whole.num_rows, DOCS)):
            sets = [hashed(t, known).view(np.int64) for t in b.column(1).to_pylist()]
            at = np.cumsum([0] + [len(x) for x in sets])
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))], ["key", "set"])

    need = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    rows = items.join(need, "key").select("key", F.col("rep.row").alias("row"))
    # shuffled at every size, as the pairs grow with the documents; rows equal in all document columns are read once
    texts = docs.select(row_hash(docs).alias("row"), "text").join(rows.hint("merge"), "row").select("key", "text")
    return cut_lineage(texts.mapInArrow(read, "key long, set array<long>").dropDuplicates(["key"]))


def _true(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity."""
    side = lambda c: sets.select(F.col("key").alias(c), F.col("set").alias(f"_{c}"))
    both = F.size(F.array_intersect("_a", "_b"))
    joined = pairs.select("a", "b").join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    return joined.filter(both / (F.size("_a") + F.size("_b") - both) >= similar).select("a", "b")


def _links(scored: DataFrame, docs: DataFrame, items: DataFrame, similar: float) -> DataFrame:
    """True pairs that connect all that the true pairs of ``scored`` connect: best pairs first, then those between components."""
    sets = _sets(scored, docs, items)
    best = scored.groupBy("b").agg(F.max_by("a", F.struct("like", -F.col("a"))).alias("a")).select("a", "b")
    links = cut_lineage(_true(best, sets, similar))
    rest = scored.join(best, ["a", "b"], "left_anti")
    root = smallest_reachable(links)
    side = lambda c: root.select(F.col("id").alias(c), F.col("root").alias(f"_{c}"))
    apart = rest.join(side("a"), "a", "left").join(side("b"), "b", "left").filter(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")
    return cut_lineage(links.unionByName(_true(apart, sets, similar)))


def forest(at: np.ndarray, side: np.ndarray, sets: list[np.ndarray], similar: float) -> list[tuple[int, int]]:
    """Links (i, j) that join all that have the similarity, of members of different components ``at`` and, if there are two, of different sides."""
    size = np.array([len(x) for x in sets], np.int64)
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    start = np.cumsum(size) - size
    at, two, found = at.copy(), side.min() != side.max(), []
    mark = np.zeros(code.max() + 1, np.int32)
    names, count = np.unique(at, return_counts=True)
    for i in np.flatnonzero(at != names[count.argmax()]):  # of two components, one is not the most frequent
        ok = (at != at[i]) & (np.minimum(size, size[i]) >= similar * np.maximum(size, size[i]))
        if two:
            ok &= side != side[i]
        if not ok.any():
            continue
        own = code[start[i]:start[i] + size[i]]
        mark[own] = 1
        both = np.add.reduceat(mark[code], start)
        mark[own] = 0
        hit = np.flatnonzero(ok & (both / (size + size[i] - both) >= similar))
        other, j = np.unique(at[hit], return_index=True)
        found += [(int(i), int(x)) for x in hit[j]]
        at[np.isin(at, other)] = at[i]
    return found


def _later_links(seats: DataFrame, docs: DataFrame, items: DataFrame, links: DataFrame, similar: float) -> DataFrame:
    """True pairs (a, b) that connect what ``links`` leaves in different components of a large bucket."""
    root = smallest_reachable(links).withColumnsRenamed({"id": "key"})
    large = cut_lineage(seats.filter(F.col("c") > SMALL).join(root, "key", "left").select("band", "key", "n", F.coalesce("root", "key").alias("root")))
    blocks = F.floor(F.sum("n") / BLOCK).cast("int") + 1
    mixed = cut_lineage(large.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c"), blocks.alias("blocks")).filter(
        "lo <> hi").select("band", "c", "blocks"))
    # a member of block x meets those of every block y: in the part (x, x) its own, in (x, y) or (y, x) the others
    own = F.pmod(F.xxhash64("key", F.lit(SEED)), F.col("blocks")).cast("int")
    open_ = join_counted(large, mixed, ["band"], "c").select("band", "key", "root", own.alias("x"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y"))
    open_ = cut_lineage(open_.select("band", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"), "key", "root", F.col("x").alias("side")))
    sets = _sets(open_.select(F.col("key").alias("a"), F.col("key").alias("b")), docs, items)

    def link(f: pd.DataFrame) -> pd.DataFrame:
        key, side = f["key"].to_numpy(np.int64), f["side"].to_numpy(np.int64)
        if f["lo"].iloc[0] != f["hi"].iloc[0] and side.min() == side.max():
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        pairs = forest(f["root"].to_numpy(np.int64), side, f["set"].tolist(), similar)
        return pd.DataFrame({"a": [key[i] for i, _ in pairs], "b": [key[j] for _, j in pairs]}, dtype="int64")

    found = open_.join(sets.hint("merge"), "key").groupBy("band", "lo", "hi").applyInPandas(link, "a long, b long")
    return found.select(*_ordered("a", "b")).distinct()


def groups(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(row, _n): hashes of the rows that stand for their group, and how often each is there. ``similar``: ``SIMILAR`` or more."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row", "n", "fp", "sketch", "bands")).alias("rep")
    marked = cut_lineage(marks(docs))
    items = cut_lineage(marked.groupBy("key").agg(least).select("key", "rep.n", "rep.fp", "rep.sketch", "rep.bands", F.struct("rep.no", "rep.doc_id", "rep.row").alias("rep")))
    deal = items.select("key", "n", F.posexplode("bands").alias("_i", "band")).select("key", "n", "band", (F.col("_i") % CHAINED == 0).alias("chains"))
    seats = _seats(deal, "band")
    pairs = _fingerprint_pairs(items).unionByName(_small_pairs(seats.filter(F.col("c") <= SMALL), "band")).unionByName(
        _star_and_chain(seats.filter(F.col("c") > SMALL), "band"))
    links = _links(cut_lineage(_scored(pairs.distinct(), items)), docs, items, similar)
    links = cut_lineage(links.unionByName(_later_links(seats, docs, items, links, similar)))
    root = smallest_reachable(links).withColumnsRenamed({"id": "key"})
    cls = items.select("key", "rep").join(root, "key", "left").select(F.coalesce("root", "key").alias("root"), "rep")
    times = marked.groupBy("row").agg(F.count("*").alias("_n"))
    return cut_lineage(cls.groupBy("root").agg(F.min("rep").alias("rep")).select("rep.row").join(times.hint("merge"), "row"))


def keep_first(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One document of each group: that with the least doc_id (of rows equal in all document columns, one)."""
    return shielded(docs, lambda d: _first(d, similar))


def _first(docs: DataFrame, similar: float) -> DataFrame:
    # shuffled at every size: the representatives grow with the documents, so they are never sent to all tasks
    kept = docs.withColumn("row", row_hash(docs)).join(groups(docs, similar).hint("merge"), "row")
    single = kept.filter("_n = 1").select(*docs.columns)
    return single.unionByName(kept.filter("_n > 1").dropDuplicates(["row"]).select(*docs.columns))
