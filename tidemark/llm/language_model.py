"""Language-model scoring with a gated recurrent network in numpy.

Token counts over all training documents give the base: a smoothed unigram model. The network reads the previous token's embedding and its
own state and predicts the next token in two steps, its class and its place in the class (words of like frequency share a class). Its
vocabulary is the most frequent ``vocabulary`` tokens and one entry for all others; another token's probability is that entry's times the
token's smoothed share among those others, so every text has a probability. Training is truncated backpropagation through windows of
``WINDOW`` steps: each partition trains from the common weights on its share of the training documents, the
weights are averaged by tokens seen, and this is done ``rounds`` times; scores depend on how the files are split, within what averaging evens out. In scoring the state is carried from window to window to the end
of the document, so whole texts of any length are scored.

Up to ``head`` of the most frequent tokens (of up to 64 bytes) are known to every task, so they are counted in place and no hot key is shuffled;
the other tokens of a document meet their counts in a join.

Defined results: a null or empty text is the end token alone; equal rows are scored separately; a null doc_id counts as the empty text for
the fold; without training documents every token is unknown and scores as such; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fold, query, table, texts
from tidemark.session import cut_lineage

HELD_OUT = 1
HEAD = 1 << 16
STEPS = 16
VOCABULARY = 1024
WIDTH = 16
CLASSES = 32
WINDOW = 16
SLOTS = 512
SCORE_SLOTS = 1024
SCORE_WINDOW = 32
LENGTHS = (512, 2048, 8192)  # tokens; documents between two of these are scored together
ROUNDS = 1
RATE = 0.01
CHUNK = 1 << 13
PIECE = 512
FAN = 256  # weights averaged in one group
FLUSH = 400_000
END = ""  # no word is empty
FAR = 60.0  # logits are kept within this, far beyond what any text reaches; the exponential is finite there


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def token_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over the documents' tokens, the end token as the empty word. Each task counts before anything is shuffled."""
    def count(batches: Iterable[pa.RecordBatch]):
        def batch():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])

        seen: Counter[bytes] = Counter()
        for b in batches:
            for text in texts(b.column(0)):
                seen.update(words_of(text))
                seen[b""] += 1
                if len(seen) > FLUSH:
                    yield batch()
                    seen.clear()
        if seen:
            yield batch()

    return docs.select("text").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class GRU:
    """Gated recurrent unit with class-factored softmax. Items are ordered by class; class k holds items bounds[k] to bounds[k + 1]."""

    NAMES = ("emb", "wx", "wh", "b", "wc", "bc", "ww", "bw")

    def __init__(self, mass: np.ndarray, width: int = WIDTH, classes: int = CLASSES, seed: int = 5):
        """``mass``: smoothed count of every item, in descending order."""
        rng = np.random.default_rng(seed)
        k, p = len(mass), mass / mass.sum()
        spread = np.cumsum(np.sqrt(p))
        cls = np.minimum((spread / spread[-1] * classes * (1 - 1e-12)).astype(int), classes - 1)
        _, cls = np.unique(cls, return_inverse=True)
        self.cls = cls.astype(np.int32)
        self.bounds = np.concatenate(([0], np.flatnonzero(np.diff(cls)) + 1, [k])).astype(int)
        c = len(self.bounds) - 1
        inside = np.add.reduceat(p, self.bounds[:-1])
        f = lambda *s: (rng.standard_normal(s) / np.sqrt(s[-2] if len(s) > 1 else 1)).astype(np.float32)
        self.p = {
            "emb": f(k, width) * 0.5, "wx": f(width, 3 * width), "wh": f(width, 3 * width), "b": np.zeros(3 * width, np.float32),
            "wc": np.zeros((width, c), np.float32), "bc": np.log(inside).astype(np.float32),
            "ww": np.zeros((k, width), np.float32), "bw": np.log(p / inside[cls]).astype(np.float32)}  # starts as the unigram model

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[n].ravel() for n in self.NAMES])

    def load(self, flat: np.ndarray) -> GRU:
        at = 0
        for n in self.NAMES:
            size = self.p[n].size
            self.p[n] = flat[at:at + size].reshape(self.p[n].shape).astype(np.float32)
            at += size
        return self

    def run(self, ids: np.ndarray, reset: np.ndarray, h: np.ndarray, keep: bool):
        """States after each of T steps for ids (T x B) of previous tokens; where ``reset``, the state starts at zero."""
        p, w = self.p, h.shape[1]
        gx = (p["emb"] @ p["wx"] + p["b"])[ids] if ids.size > len(p["emb"]) else p["emb"][ids] @ p["wx"] + p["b"]
        states = np.empty((*ids.shape, w), np.float32)
        tape = []
        for t in range(len(ids)):
            if reset[t].any():
                h = h.copy() if not t else h
                h[reset[t]] = 0
            gh = h @ p["wh"]
            gates = gx[t, :, :2 * w] + gh[:, :2 * w]
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += np.float32(1)
            np.reciprocal(gates, out=gates)
            r, z = gates[:, :w], gates[:, w:]
            n = np.tanh(gx[t, :, 2 * w:] + r * gh[:, 2 * w:])
            if keep:
                tape.append((h, r, z, n, gh[:, 2 * w:]))
            h = n + z * (h - n)
            states[t] = h
        return states, h, tape

    def log_probs(self, h: np.ndarray, target: np.ndarray, grads: dict | None = None):
        """Natural log probability of each target given state rows h (M x width); with ``grads``, also d(-sum)/dh and parameter gradients."""
        p = self.p
        c = self.cls[target]
        logits = h @ p["wc"] + p["bc"]
        np.clip(logits, -FAR, FAR, out=logits)
        e = np.exp(logits)
        total = e @ np.ones(e.shape[1], np.float32)  # a product is faster than a sum over short rows
        rows = np.arange(len(h))
        out = logits[rows, c] - np.log(total)
        dh = None
        if grads is not None:
            d = e / total[:, None]
            d[rows, c] -= 1.0
            grads["wc"], grads["bc"] = h.T @ d, d.sum(axis=0)
            dh = d @ p["wc"].T
            grads["ww"], grads["bw"] = np.zeros_like(p["ww"]), np.zeros_like(p["bw"])
        # one sort by class, then every class is a run of rows
        order = np.argsort(c, kind="stable")
        cut = np.searchsorted(c[order], np.arange(len(self.bounds)))
        sorted_h, sorted_t, inner = h[order], target[order], np.zeros(len(h), np.float32)
        back = np.zeros_like(h) if grads is not None else None
        for k in range(len(self.bounds) - 1):
            lo, hi, a, z = self.bounds[k], self.bounds[k + 1], cut[k], cut[k + 1]
            if a == z or hi - lo == 1:
                continue
            g = sorted_h[a:z] @ p["ww"][lo:hi].T + p["bw"][lo:hi]
            np.clip(g, -FAR, FAR, out=g)
            j, r = sorted_t[a:z] - lo, np.arange(z - a)
            own = g[r, j]
            e = np.exp(g, out=g)
            total = e @ np.ones(hi - lo, np.float32)
            inner[a:z] = own - np.log(total)
            if grads is not None:
                d = e / total[:, None]
                d[r, j] -= 1.0
                grads["ww"][lo:hi], grads["bw"][lo:hi] = d.T @ sorted_h[a:z], d.sum(axis=0)
                back[a:z] = d @ p["ww"][lo:hi]
        out[order] += inner
        if grads is not None:
            dh[order] += back
        return out, dh

    def gradients(self, ids, target, live, reset, h):
        """Loss, parameter gradients (mean over live targets) and last state of one window, by backpropagation through its steps."""
        p, w = self.p, h.shape[1]
        states, last, tape = self.run(ids, reset, h, True)
        g: dict[str, np.ndarray] = {}
        lp, d_live = self.log_probs(states[live], target[live], g)
        n = max(1, len(lp))
        d_out = np.zeros_like(states)
        d_out[live] = d_live
        g["wh"] = np.zeros_like(p["wh"])
        dgx = np.zeros((*ids.shape, 3 * w), np.float32)
        dh = np.zeros_like(h)
        for t in range(len(ids) - 1, -1, -1):
            prev, r, z, c, ghn = tape[t]
            dh = dh + d_out[t]
            dn = dh * (1 - z) * (1 - c * c)
            dz = dh * (prev - c) * z * (1 - z)
            dr = dn * ghn * r * (1 - r)
            dgx[t] = np.concatenate([dr, dz, dn], axis=1)
            dgh = np.concatenate([dr, dz, dn * r], axis=1)
            g["wh"] += prev.T @ dgh
            dh = dh * z + dgh @ p["wh"].T
            dh[reset[t]] = 0.0
        flat_in, flat_g = ids.ravel(), dgx.reshape(-1, 3 * w)
        g["wx"], g["b"] = p["emb"][flat_in].T @ flat_g, flat_g.sum(axis=0)
        g["emb"] = np.zeros_like(p["emb"])
        order = np.argsort(flat_in, kind="stable")
        first = np.flatnonzero(np.diff(flat_in[order], prepend=-1))
        g["emb"][flat_in[order[first]]] = np.add.reduceat((flat_g @ p["wx"].T)[order], first, axis=0)
        return -float(lp.sum()), {k: v / n for k, v in g.items()}, last


def lay_out(docs: list[np.ndarray], slots: int, end: int):
    """Documents (targets, each closed by the end token) dealt to slots, longest first to the emptiest: inputs, targets, live, reset
    (T x B) and for each document its slot and first step."""
    b = max(1, min(slots, len(docs)))
    load, place = np.zeros(b, dtype=np.int64), [(0, 0)] * len(docs)
    import heapq
    heap = [(0, i) for i in range(b)]
    for d in sorted(range(len(docs)), key=lambda d: -len(docs[d])):
        at, i = heapq.heappop(heap)
        place[d] = (i, at)
        heapq.heappush(heap, (at + len(docs[d]), i))
        load[i] = at + len(docs[d])
    t = int(load.max()) if len(docs) else 0
    target, ids = np.full((t, b), end, np.int32), np.full((t, b), end, np.int32)
    live, reset = np.zeros((t, b), bool), np.zeros((t, b), bool)
    for d, (i, at) in enumerate(place):
        n = len(docs[d])
        target[at:at + n, i], live[at:at + n, i], reset[at, i] = docs[d], True, True
        ids[at + 1:at + n, i] = docs[d][:-1]
    return ids, target, live, reset, place


class Adam:
    """Adam's moments, kept over all the texts of a partition. Embeddings of items that a window does not hold wait."""

    def __init__(self, net: GRU, rate: float = RATE):
        self.rate, self.step = rate, 0
        self.m = {k: np.zeros_like(v) for k, v in net.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in net.p.items()}

    def update(self, net: GRU, grads: dict[str, np.ndarray], held: np.ndarray, share: float = 1.0) -> None:
        """One step; a window of which only a ``share`` of the slots is left takes a step so much shorter."""
        self.step += 1
        norm = np.sqrt(sum(float(np.vdot(x, x)) for x in grads.values()))
        scale = np.float32(min(1.0, 5.0 / (norm + 1e-9)))
        rate, root = np.float32(self.rate * share / (1 - 0.9**self.step)), np.float32(1 / np.sqrt(1 - 0.99**self.step))
        for k, x in grads.items():
            at = held if k == "emb" else slice(None)
            x = x[at] * scale
            m = self.m[k][at] * np.float32(0.9) + x * np.float32(0.1)
            v = self.v[k][at] * np.float32(0.99) + x * x * np.float32(0.01)
            self.m[k][at], self.v[k][at] = m, v
            net.p[k][at] -= rate * m / (np.sqrt(v) * root + np.float32(1e-6))


def train_on(net: GRU, docs: list[np.ndarray], end: int, adam: Adam | None = None, window: int = WINDOW, slots: int = SLOTS) -> int:
    """One pass with truncated backpropagation; returns the tokens seen.

    Texts are laid out in pieces of ``PIECE`` tokens that start from an empty state, so that no slot outlasts the others with a long text and
    the last windows are as full as the first. Every token is a target once.
    """
    adam = adam or Adam(net)
    pieces = [d[i:i + PIECE] for d in docs for i in range(0, len(d), PIECE)]
    ids, target, live, reset, _ = lay_out(pieces, min(slots, max(1, sum(map(len, pieces)) // (8 * window))), end)
    h = np.zeros((ids.shape[1], net.p["wh"].shape[0]), np.float32)
    active = np.arange(ids.shape[1])
    for lo in range(0, len(ids), window):
        s = slice(lo, lo + window)
        some = live[s, active].any(axis=0)  # slots that have run out leave the window; they have no gradient
        active, h = active[some], h[some]
        _, g, h = net.gradients(ids[s, active], target[s, active], live[s, active], reset[s, active], h)
        adam.update(net, g, np.unique(ids[s, active]), len(active) / ids.shape[1])
    return int(live.sum())


def score_all(net: GRU, docs: list[np.ndarray], end: int) -> np.ndarray:
    """log10 probability of every document. Documents of like length are laid out together, so that few steps run with idle slots."""
    out = np.zeros(len(docs))
    size = np.array([len(d) for d in docs], dtype=np.int64)
    for lo, hi in zip((0, *LENGTHS), (*LENGTHS, 1 << 62), strict=True):
        at = np.flatnonzero((size > lo) & (size <= hi))
        if len(at):
            out[at] = _score(net, [docs[i] for i in at], end)
    return out / np.log(10.0)


def _score(net: GRU, docs: list[np.ndarray], end: int) -> np.ndarray:
    """Natural log probability of every document of one layout; the state is carried from block to block."""
    ids, target, live, reset, place = lay_out(docs, SCORE_SLOTS, end)
    lp = np.zeros(ids.shape, np.float64)
    h = np.zeros((ids.shape[1], net.p["wh"].shape[0]), np.float32)
    active = np.arange(ids.shape[1])
    for lo in range(0, len(ids), SCORE_WINDOW):
        hi = min(len(ids), lo + SCORE_WINDOW)
        some = live[lo:hi, active].any(axis=0)  # slots that have run out leave the block
        active, h = active[some], h[some]
        states, h, _ = net.run(ids[lo:hi, active], reset[lo:hi, active], h, False)
        on = live[lo:hi, active]
        part = np.zeros(on.shape)
        part[on], _ = net.log_probs(states[on], target[lo:hi, active][on])
        lp[lo:hi, active] = part
    return np.array([lp[at:at + len(d), i].sum() for d, (i, at) in zip(docs, place, strict=True)])


class Lexicon:
    """The most frequent tokens: their base logarithms, and the network's item for each (0 is the entry for all others)."""

    def __init__(self, head: list[tuple[bytes, int]], total: int, distinct: int, vocabulary: int):
        self.total, self.distinct = total, distinct
        known = {w: c for w, c in head}
        own = [(w, c) for w, c in head if w != b""][:vocabulary]
        end = known.get(b"", 0)
        self.rest = max(0, total - end - sum(c for _, c in own))  # training tokens outside the network's vocabulary
        self.rest_distinct = max(0, distinct - len(own) - (end > 0))
        items = [(b"", end), (None, self.rest), *own]
        items.sort(key=lambda x: -x[1])
        self.mass = np.array([c + 0.5 for _, c in items])
        self.item = {w: i for i, (w, _) in enumerate(items) if w is not None}
        self.other, self.end = next(i for i, (w, _) in enumerate(items) if w is None), self.item[b""]
        self.words = {w: i for i, (w, _) in enumerate(head)}
        self.log_count = np.log10(np.array([c for _, c in head], dtype=np.float64) + 0.5)
        self.items = np.array([self.item.get(w, self.other) for w, _ in head], dtype=np.int32)
        self.base_norm = float(np.log10(total + 0.5 * (distinct + 1)))
        self.rest_norm = float(np.log10(self.rest + 0.5 * (self.rest_distinct + 1)))

    def targets(self, words: list[bytes]) -> np.ndarray:
        get, item, other = self.item.get, self.item, self.other
        out = np.empty(len(words) + 1, np.int32)
        out[:-1] = np.fromiter(map(get, words, repeat(other)), np.int32, len(words))
        out[-1] = item[b""]
        return out


def lexicon(counts: DataFrame, head: int = HEAD, vocabulary: int = VOCABULARY) -> Lexicon:
    """From the counts table. A histogram of counts (``STEPS`` bins an octave) gives the least count that at most ``head`` words of up to
    64 bytes reach; these words and the end token are all that comes to the driver."""
    s = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    short = counts.filter(F.octet_length("word") <= 64).withColumn("bin", F.floor(F.log2("c") * STEPS))
    least, reach = None, 0
    for r in short.groupBy("bin").agg(F.count("*").alias("n")).orderBy(F.desc("bin")).collect():
        if reach + r["n"] > head:
            break
        least, reach = r["bin"], reach + r["n"]
    end = F.octet_length("word") == 0
    chosen = short.filter(end if least is None else end | (F.col("bin") >= least)).collect()
    rows = sorted(((bytes(r["word"]), r["c"]) for r in chosen), key=lambda x: (-x[1], x[0]))
    return Lexicon(rows, s["n"] or 0, s["v"], vocabulary)


def train(docs: DataFrame, lex: Lexicon, rounds: int = ROUNDS) -> np.ndarray:
    """Averaged weights after ``rounds`` rounds over all training documents. Every partition trains from the common weights on its texts, in the
    order and Arrow batches they come in; the optimiser's state lasts for the partition."""
    flat = GRU(lex.mass).flat()
    parts = docs.select("text")

    for _ in range(rounds):
        start = flat

        def fit(batches: Iterable[pa.RecordBatch], start=start):
            net, seen = GRU(lex.mass).load(start), 0
            adam = Adam(net)
            for b in batches:
                docs = [lex.targets(words_of(t)) for t in texts(b.column(0))]
                if docs:
                    seen += train_on(net, docs, lex.end, adam)
            if seen:
                out = net.flat().astype(np.float32)
                parts = [out[i:i + CHUNK].tobytes() for i in range(0, len(out), CHUNK)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([TaskContext.get().partitionId()] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()),
                    pa.array([float(seen)] * len(parts)), pa.array(parts, pa.binary())], ["pid", "chunk", "seen", "part"])

        def average(pdf: pd.DataFrame) -> pd.DataFrame:
            total, weight = 0.0, 0.0
            for seen, part in zip(pdf["seen"], pdf["part"], strict=True):
                total = total + np.frombuffer(part, np.float32).astype(np.float64) * seen
                weight += seen
            return pd.DataFrame({"pid": [int(pdf["pid"].iloc[0]) // FAN], "chunk": [int(pdf["chunk"].iloc[0])], "seen": [weight],
                                 "part": [(total / weight).astype(np.float32).tobytes()]})

        schema = "pid long, chunk int, seen double, part binary"
        weights = cut_lineage(parts.mapInArrow(fit, schema))
        most = weights.agg(F.max("pid").alias("p")).first()["p"]
        while most:  # no group averages the weights of more than ``FAN`` partitions
            weights = cut_lineage(weights.groupBy("chunk", F.expr(f"pid div {FAN}").alias("_g")).applyInPandas(lambda _, pdf: average(pdf), schema))
            most //= FAN
        rows = weights.collect()  # one model
        if rows:
            flat = np.concatenate([np.frombuffer(r["part"], np.float32) for r in sorted(rows, key=lambda r: r["chunk"])])
    return flat


def score(docs: DataFrame, counts: DataFrame, lex: Lexicon, flat: np.ndarray) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    net_weights, total = flat, lex.total

    def read(batches: Iterable[pa.RecordBatch]):
        net = GRU(lex.mass).load(net_weights)
        row = TaskContext.get().partitionId() << 40
        index, other = lex.words.get, lex.other
        lift = lex.log_count - lex.rest_norm  # log10 share of a head word outside the vocabulary among the others
        for b in batches:
            targets, base, known, rest, n, tail_w, tail_n = [], [], [], [], [], [], []
            for text in texts(b.column("text")):
                words = words_of(text)
                words.append(b"")
                at = np.fromiter(map(index, words, repeat(-1)), np.int64, len(words))
                inside = at >= 0
                here = at[inside]
                item = np.full(len(words), other, np.int32)
                item[inside] = lex.items[here]
                item[-1] = lex.end
                base.append(float(lex.log_count[here].sum()))
                known.append(len(here))
                rest.append(float(lift[here[lex.items[here] == other]].sum()))
                n.append(len(words))
                tail = Counter(words[i] for i in np.flatnonzero(~inside))
                tail_w.append(list(tail))
                tail_n.append(list(tail.values()))
                targets.append(item)
            rows = len(n)
            if rows:
                marks = score_all(net, targets, lex.end)
                yield pa.RecordBatch.from_arrays([
                    pa.array(range(row, row + rows), pa.int64()), b.column("doc_id"), b.column("held_out"), pa.array(n, pa.int64()), pa.array(known, pa.int64()),
                    pa.array(base), pa.array(marks + np.array(rest)), pa.array(tail_w, pa.list_(pa.binary())), pa.array(tail_n, pa.list_(pa.int64()))],
                    ["row", "doc_id", "held_out", "n_tokens", "known", "base", "own", "words", "times"])
                row += rows

    schema = f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, own double, words array<binary>, times array<long>"
    rows = cut_lineage(docs.select("doc_id", "text", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out")).mapInArrow(read, schema))
    tail = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("k"))
    met = tail.join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    # a tail word that is the end token's empty word cannot occur: only head words are outside this join otherwise
    per = met.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("k"))).alias("more"), F.sum(F.col("k") * F.log10(F.col("c") + 0.5)).alias("log"), F.sum("k").alias("k"))
    j = rows.drop("words", "times").join(per, "row", "left").fillna(0, ["more", "k"]).fillna(0.0, ["log"])
    return j.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.col("more")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("log") - F.col("n_tokens") * lex.base_norm).alias("base_score"),
        (F.col("own") + F.col("log") - F.col("k") * lex.rest_norm).alias("score"))


def score_documents(docs: DataFrame, head: int = HEAD, vocabulary: int = VOCABULARY, rounds: int = ROUNDS) -> DataFrame:
    """Counts, training and scoring of one table of documents."""
    train_docs = docs.filter(fold(F.col("doc_id")) != HELD_OUT)
    counts = cut_lineage(token_counts(train_docs))
    lex = lexicon(counts, head, vocabulary)
    return score(docs, counts, lex, train(train_docs, lex, rounds))


@query("op5_language_model")
def op5_language_model(spark, sf_dir):
    return score_documents(table(spark, sf_dir, "documents"))
