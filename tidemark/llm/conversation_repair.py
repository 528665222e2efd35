"""Conversation repair: the cheapest edits that give a legal order of roles, by bidirectional Dijkstra over the edit lattice.

A node of the lattice is (rows consumed, state of the role pattern ``(s?(ua)+)?``). Edges are Keep (K, cost 0), Rerole to user or assistant
(R, 2), Delete (D, 3, the only edge of a blank or duplicate row but for insertions) and Insert of an empty user or assistant row (I, 2);
a truncated row that is not deleted adds 1. A forward and a reverse heap settle nodes until their tops together exceed the best meeting
cost, so that every crossing of equal cost is complete; of the crossings the one with the ASCII-least concatenated audit is taken. Among
paths of equal cost to one node no audit is a prefix of another (the longer one would hold only insertions more), so the least audit of a
node and the least of the rest give the least of the whole.

Rows reach their conversation's task sorted and are streamed. A conversation longer than ``BLOCK`` rows is solved block by block, from every
state that can stand at the block's start to every state at its end; a path kept for each of the four states carries its cost, audit and a
running SHA-256, so memory is one block of texts and one audit byte a row, whatever the length. (The hash of a whole conversation is one
sequential pass by definition, so a conversation is one task's work; its rows are never held together.)

Defined results: null role and text count as one space, and so do null conv_id and turn in the damage hash; rows of one turn are ordered by role
and text; a row whose role is empty has no initial and cannot be kept; a null conv_id is a conversation; repeated rows are duplicates; a
conversation that loses all rows has zeros, an empty audit and the hash of the empty string; an empty table gives no rows; other columns
are ignored. ``gaps`` beyond a long is the largest long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import query, table

BLOCK = 256
BLANK = " \t\n\x0b\x0c\r"
#: State after each role initial: 0 nothing yet, 1 after s, 2 after u, 3 after a. A conversation may end in 0 or 3.
STEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
NAMES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
#: Faults of a row; the first that applies counts.
NONE, IS_BLANK, IS_DUPLICATE, IS_TRUNCATED = range(4)

Row = tuple[str, int]  # role initial and fault


def forward_edges(rows: list[Row], i: int, s: int):
    """(rows consumed, state, cost, letter) of the edges that leave a node."""
    for c, t in STEP[s].items():
        if c in NAMES:
            yield i, t, INSERT, "I"
    if i < len(rows):
        initial, fault = rows[i]
        yield i + 1, s, DELETE, "D"
        if fault not in (IS_BLANK, IS_DUPLICATE):
            extra = CUT if fault == IS_TRUNCATED else 0
            for c, t in STEP[s].items():
                if c == initial:
                    yield i + 1, t, KEEP + extra, "K"
                elif c in NAMES:
                    yield i + 1, t, REROLE + extra, "R"


def reverse_edges(rows: list[Row], i: int, t: int):
    """The edges that enter a node, as (rows consumed, state, cost, letter) of the node they come from."""
    for s in range(4):
        if t in STEP[s].values() and t != 1:
            yield i, s, INSERT, "I"
    if i:
        initial, fault = rows[i - 1]
        yield i - 1, t, DELETE, "D"
        if fault not in (IS_BLANK, IS_DUPLICATE):
            extra = CUT if fault == IS_TRUNCATED else 0
            for s in range(4):
                for c, to in STEP[s].items():
                    if to == t:
                        if c == initial:
                            yield i - 1, s, KEEP + extra, "K"
                        elif c in NAMES:
                            yield i - 1, s, REROLE + extra, "R"


def cheapest(rows: list[Row], start: int, ends: Iterable[int]) -> tuple[int, str, int] | None:
    """(cost, audit, end state) of the best path from (0, start) to (all rows, one of ``ends``): least cost, then ASCII-least audit, then state."""
    n, ends = len(rows), list(ends)
    label = ({(0, start): (0, "")}, {(n, t): (0, "") for t in ends})
    heap = ([(0, 0, start)], [(0, 0, t) for t in ends])
    done: tuple[dict, dict] = ({}, {})
    best = min((c + label[1][v][0] for v, (c, _) in label[0].items() if v in label[1]), default=None)
    while heap[0] and heap[1] and (best is None or heap[0][0][0] + heap[1][0][0] <= best or len(done[1]) < len(ends)):
        side = 0 if heap[0][0][0] <= heap[1][0][0] else 1
        cost, at, s = heappop(heap[side])
        v = (n - at if side else at, s)
        if v in done[side] or label[side][v][0] < cost:
            continue
        audit = label[side][v][1]
        done[side][v] = cost, audit
        # edges without cost consume a row, so among equal costs nodes that are nearer to the heap's own end are settled first
        for j, t, w, letter in (reverse_edges if side else forward_edges)(rows, *v):
            new = cost + w, letter + audit if side else audit + letter
            u = (j, t)
            if u not in label[side] or new < label[side][u]:
                known = label[side].get(u)
                label[side][u] = new
                if known is None or new[0] < known[0]:
                    heappush(heap[side], (new[0], n - j if side else j, t))
            if u in label[1 - side]:
                meet = new[0] + label[1 - side][u][0]
                best = meet if best is None else min(best, meet)
    if best is None:
        return None
    found = None
    for v, (c, a) in done[0].items():  # all crossings: a node that both settled, or an edge from a forward to a reverse node
        around = [(v, 0, "")] + [((j, t), w, letter) for j, t, w, letter in forward_edges(rows, *v)]
        for u, w, letter in around:
            if u in done[1] and c + w + done[1][u][0] == best:
                audit = a + letter + done[1][u][1]
                if found is None or audit < found:
                    found = audit
    return best, found, walk(rows, start, found)[1]


def walk(rows: list[Row], start: int, audit: str) -> tuple[list[tuple[int | None, str | None]], int]:
    """What an audit leaves: (row or None for an insertion, new role initial or None if kept), and the end state. Each letter of a path fixes the role."""
    out, i, s = [], 0, start
    for letter in audit:
        if letter == "D":
            i += 1
            continue
        if letter == "K":
            out.append((i, None))
            s = STEP[s][rows[i][0]]
        else:
            c = next(c for c in STEP[s] if c in NAMES)
            out.append((i if letter == "R" else None, c))
            s = STEP[s][c]
        i += letter != "I"
    return out, s


class Repair:
    """One conversation, fed in order; ``result`` ends it."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        self.rows: list[Row] = []
        self.said: list[tuple[str, str]] = []
        #: for each state the best path so far: cost, audit pieces, running hash, whether anything was written to it
        self.paths: dict[int, tuple[int, str, object, bool]] = {0: (0, "", hashlib.sha256(), False)}
        self.counts = [0, 0, 0, 0]
        self.illegal, self.turns, self.least, self.most = 0, 0, None, None
        self.before: str | None = None

    def add(self, turn: int | None, role: str, text: str, duplicate: bool) -> None:
        body = text.rstrip(BLANK)
        fault = IS_BLANK if not body else IS_DUPLICATE if duplicate else NONE if body[-1] in ".!?" else IS_TRUNCATED
        initial = role[:1]
        self.counts[fault] += 1
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        if turn is not None:
            self.turns += turn != self.most
            self.least, self.most = turn if self.least is None else self.least, turn
        if len(self.rows) == self.block:
            self._close(range(4))
        self.rows.append((initial, fault))
        self.said.append((role, text))

    def _close(self, ends: Iterable[int]) -> None:
        """Extend the paths over the rows held, one path for each end state."""
        new: dict[int, tuple] = {}
        for t in ends:
            found = []
            for s, (cost, audit, _, _) in self.paths.items():
                part = cheapest(self.rows, s, [t])
                if part:
                    found.append((cost + part[0], audit + part[1], s, part[1]))
            if found:
                cost, audit, s, part = min(found)
                new[t] = cost, audit, *self._write(self.paths[s], s, part)
        self.paths, self.rows, self.said = new, [], []

    def _write(self, path: tuple, s: int, audit: str) -> tuple[object, bool]:
        digest, begun = path[2].copy(), path[3]
        for i, c in walk(self.rows, s, audit)[0]:
            role, text = ("", "") if i is None else self.said[i]
            line = f"{NAMES[c] if c else role}:{text}"
            digest.update((("\n" if begun else "") + line).encode("utf-8", "surrogatepass"))
            begun = True
        return digest, begun

    def result(self) -> tuple:
        if len(self.paths) == 1:  # the usual case: one block, one search
            (s, path), = self.paths.items()
            cost, audit, t = cheapest(self.rows, s, FINAL)
            self.paths = {t: (path[0] + cost, path[1] + audit, *self._write(path, s, audit))}
        else:
            self._close(FINAL)
        cost, audit, digest, _ = min(self.paths.values(), key=lambda p: p[:2])
        gaps = 0 if self.least is None else min(self.most - self.least + 1 - self.turns, (1 << 63) - 1)
        return gaps, self.counts[IS_BLANK], self.counts[IS_DUPLICATE], self.counts[IS_TRUNCATED], self.illegal, cost, audit, digest.hexdigest()


RESULTS = (("gaps", "long"), ("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("illegal", "long"), ("cost", "long"), ("audit", "string"), ("repaired_sha256", "string"))


def damage(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) damaged by the hash of ``conv_id:turn``; dropped rows stay with ``dropped`` set."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20))
    text = F.when(how == 1, "").when(how == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    damaged = rows.select("conv_id", "turn", F.when(how == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), (how == 0).alias("dropped"),
                          F.when(how == 3, 2).otherwise(1).alias("_times"))
    return damaged.select("*", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_copy")).drop("_times", "_copy")


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conv_id of ``rows`` (conv_id, turn, role, text, dropped): the counts of its faults, the cost and audit of the repair and its hash.

    Rows with ``dropped`` only make their conversation appear. All rows of a conversation are shuffled once; whether a row's role and text
    were seen earlier is a window that this partitioning serves.
    """
    held = rows.select("conv_id", "turn", "role", "text", "dropped").repartition("conv_id")
    same = Window.partitionBy("conv_id", "role", F.sha2(F.col("text").cast("binary"), 256), "dropped").orderBy(F.col("turn").asc_nulls_first())
    held = held.withColumn("seen", F.row_number().over(same) > 1)
    held = held.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "seen")
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]):
        at, work, out = None, None, []
        id_type = None

        def flush():
            ids = pa.array([o[0] for o in out], id_type)
            rest = [pa.array([o[1][k] for o in out], pa.string() if t == "string" else pa.int64()) for k, (_, t) in enumerate(RESULTS)]
            out.clear()
            return pa.RecordBatch.from_arrays([ids, *rest], ["conv_id", *[c for c, _ in RESULTS]])

        for b in batches:
            id_type = b.column(0).type
            for conv, turn, role, text, dropped, seen in zip(*[b.column(k).to_pylist() for k in range(6)], strict=True):
                if work is None or conv != at:
                    if work is not None:
                        out.append((at, work.result()))
                    at, work = conv, Repair(block)
                if not dropped:
                    work.add(turn, role, text, seen)
            if len(out) >= 1000:
                yield flush()
        if work is not None:
            out.append((at, work.result()))
            yield flush()

    return held.mapInArrow(run, f"conv_id {kind}, " + ", ".join(f"{c} {t}" for c, t in RESULTS))


@query("op12_conversation_repair")
def op12_conversation_repair(spark, sf_dir):
    return repair(damage(table(spark, sf_dir, "conversations")))
