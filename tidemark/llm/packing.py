"""Sum-of-squares packing of tokenised documents into windows of fixed length.

Documents are tokenised where they are read and packed within their input partition, so no token is shuffled. Whole windows are cut off
the front of a long document; its rest is placed by the sum-of-squares rule: among the fill levels that have an open window and room,
and the empty level, choose the one after which the sum of the squared counts of windows per level is least (ties: the fullest). The
counts are kept in a level array, with a stack of windows per level. When a partition ends, or ``max_open`` tokens stand in open
windows, what is open is run together and cut freely, so at most one window a partition is not full.

Token ids come from the byte-level BPE vocabulary of ``tokenizer``. Pieces between single spaces never share a token, so each distinct
piece is encoded once per worker and kept in a bounded cache.

Defined results: a null text is empty, an empty text is its end token alone; equal rows are packed separately; a text of any length is
encoded piece by piece; an empty table gives no rows. The layout follows the input's partitions, which a retried task sees again.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import query, table, texts

WINDOW = 1024
END = 0
MAX_OPEN = 1 << 22
CACHE = 400_000
SHARD_BITS = 40
_SPACES = re.compile(r"^ | $|\s\s")
_CUT = re.compile(r"(?<=\S)(?= \S)")
_ENCODERS: dict[str, _Encoder] = {}


class _Encoder:
    """Text to little-endian unsigned 32-bit ids. Rank files and JSON files of the same vocabulary give the same ids."""

    def __init__(self, ranks: str, vocabulary: str, pattern: str):
        import tiktoken
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.vocabulary, self.full, self.cache = vocabulary, None, {}

    def piece(self, piece: str) -> bytes:
        found = self.cache.get(piece)
        if found is None:
            if "<|" in piece or "\ud800" <= max(piece, default="") <= "\udfff":  # may hold a special token: ask the JSON file's tokenizer
                if self.full is None:
                    from tokenizers import Tokenizer
                    self.full = Tokenizer.from_file(self.vocabulary)
                ids = self.full.encode(piece, add_special_tokens=False).ids
            else:
                ids = self.fast.encode_ordinary(piece)
            found = np.array(ids, dtype="<u4").tobytes()
            if len(piece) <= 64:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                self.cache[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        if " " not in text:
            return self.piece(text) if text else b""
        if _SPACES.search(text):
            pieces = _CUT.split(text)
        else:
            first, *rest = text.split(" ")
            pieces = [first, *[" " + x for x in rest]]
        return b"".join(map(self.piece, pieces))


def encoder(ranks: str | None = None, vocabulary: str | None = None) -> _Encoder:
    """The worker's encoder for a vocabulary; the files are a parameter (by default those of the public byte-level BPE)."""
    import public_tokenizers as P
    ranks, vocabulary = ranks or P.path("byte_bpe_50k.tiktoken"), vocabulary or P.path("byte_bpe_50k.json")
    if ranks not in _ENCODERS:
        _ENCODERS[ranks] = _Encoder(ranks, vocabulary, P.PATTERN)
    return _ENCODERS[ranks]


class SumOfSquares:
    """Open windows by fill level. ``add`` and ``settle`` give the pieces of windows that are complete: lists of (document, start, ids)."""

    def __init__(self, window: int = WINDOW, max_open: int = MAX_OPEN):
        self.window, self.max_open = window, max_open
        self.count = np.zeros(window + 1, dtype=np.int64)  # the level array: open windows at each fill
        self.count[1:] = 0
        self.open: list[list[list]] = [[] for _ in range(window + 1)]
        self.held = 0

    def level_for(self, size: int) -> int:
        """Level h to place ``size`` on. Moving a window from h to h + size changes the sum of squares by
        2 * (N[h + size] - N[h]) + 2, a new one (h = 0) by 2 * N[size] + 1; a full window leaves the count."""
        top = self.window - size
        after = self.count[size:self.window + 1].copy()
        change = 2 * (after - self.count[:top + 1]) + 2
        change[top] = 1 - 2 * self.count[top]  # becomes full: only its own level changes
        change[0] = 2 * self.count[size] + 1 if size < self.window else 0
        usable = self.count[:top + 1] > 0
        usable[0] = True
        change = np.where(usable, change, np.iinfo(np.int64).max)
        return int(top - np.argmin(change[::-1]))

    def add(self, doc: int, ids: bytes) -> Iterator[list]:
        n, w = len(ids) // 4, self.window
        whole = n - n % w
        for at in range(0, whole, w):
            yield [(doc, at, ids[4 * at:4 * (at + w)])]
        size = n - whole
        if not size:
            return
        h = self.level_for(size)
        items = [] if h == 0 else self.open[h].pop()
        if h:
            self.count[h] -= 1
            self.held -= h
        items.append((doc, whole, ids[4 * whole:]))
        if h + size == w:
            yield items
        else:
            self.open[h + size].append(items)
            self.count[h + size] += 1
            self.held += h + size
        if self.held > self.max_open:
            yield from self.settle()

    def settle(self) -> Iterator[list]:
        """Run everything open together, fullest windows first, and cut it into windows; only the last may be short."""
        w = self.window
        items, room = [], w
        for h in range(w, 0, -1):
            for pieces in self.open[h]:
                for doc, start, ids in pieces:
                    while ids:
                        part, ids = ids[:4 * room], ids[4 * room:]
                        items.append((doc, start, part))
                        start += len(part) // 4
                        room -= len(part) // 4
                        if not room:
                            yield items
                            items, room = [], w
            self.open[h] = []
        self.count[:] = 0
        self.held = 0
        if items:
            yield items


def pack(docs: DataFrame, window: int = WINDOW, max_open: int = MAX_OPEN, ranks: str | None = None, vocabulary: str | None = None,
         with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]): one row per piece."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids

    def run(batches: Iterable[pa.RecordBatch]):
        encode = encoder(ranks, vocabulary).encode
        end = np.array([END], dtype="<u4").tobytes()
        packer = SumOfSquares(window, max_open)
        sequence = TaskContext.get().partitionId() << SHARD_BITS
        known: dict[int, tuple] = {}  # row number to (doc_id, tokens) of documents that still have open pieces
        row = 0
        out: list[tuple] = []

        def emit(groups):
            nonlocal sequence
            for items in groups:
                offset = 0
                for doc, start, ids in items:
                    doc_id, tokens = known[doc]
                    n = len(ids) // 4
                    out.append((doc_id, start, n, zlib.crc32(ids), tokens, sequence, offset) + ((ids,) if with_ids else ()))
                    offset += n
                    if start + n == tokens:
                        del known[doc]
                sequence += 1

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)
            out.clear()
            return batch

        types = [pa.null(), *[pa.int64()] * 6] + [pa.binary()] * with_ids
        for b in batches:
            types[0] = b.column(0).type
            for doc_id, text in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                ids = encode(text or "") + end
                known[row] = (doc_id, len(ids) // 4)
                emit(packer.add(row, ids))
                row += 1
            if out:
                yield flush()
        emit(packer.settle())
        if out:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


@query("op4_packing")
def op4_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
