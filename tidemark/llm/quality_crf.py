"""Document quality by a linear-chain conditional random field over lines.

Every line with a word is a node, described by its own features and those of its two neighbours. The field has one weight per feature
(for label good) and one per pair of adjacent labels. It is trained on a bounded sample of labelled documents, each line carrying its
document's label, and gives by forward-backward every line's marginal of being good; the document's score is the mean of the marginals
weighted by line length. Training sees at most ``per_class`` documents of each label and of each an excerpt of ``excerpt`` lines; scoring
reads whole texts. Ids, languages, sources and labels are no features.

Defined results: a null or empty text, or one without words, is a single line with all features zero; equal texts get equal scores; a
document with several labels counts by the least; labels that are null are left out; without any label every score is 0.5; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES, fold, query, table

PER_CLASS = 1500
EXCERPT = 64
STEPS = 160
RATE = 0.15
PENALTY = 1e-3
CUT = 0.3
CELLS = 1 << 17
OWN = 10  # features of a line alone


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x OWN, line lengths) of the lines that have a word."""
    rows, lengths, before = [], [], None
    for line in (text or "").split("\n"):
        words = line.split()
        if not words:
            continue
        n, chars = len(words), len(line.strip(SPACES)) or 1
        rows.append((
            np.log1p(n), min(2.0, sum(map(line.count, "#*$%&<>~^")) / n), min(2.0, line.count("!") / n), min(2.0, line.count("|") / n),
            sum(w.isupper() for w in words) / n, sum(map(line.count, "0123456789")) / chars, 1.0 - len(set(words)) / n, chars / n / 10.0,
            float(words[-1][-1] in ".?!:"), float(line == before)))
        lengths.append(chars)
        before = line
    if not rows:
        return np.zeros((1, OWN)), np.ones(1)
    return np.array(rows, dtype=np.float64), np.array(lengths, dtype=np.float64)


def with_neighbours(x: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after (zero at the ends), whether there is one, and a constant."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    ends = np.zeros((len(x), 2))
    ends[0, 0] = ends[-1, 1] = 1.0
    return np.hstack([x, before, after, ends, np.ones((len(x), 1))])


WIDTH = 3 * OWN + 3


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def forward_backward(s: np.ndarray, length: np.ndarray, pair: np.ndarray):
    """Marginals of label 1 (N x T), summed pair marginals (2 x 2) and log normalisers of N chains padded to T.

    ``s``: score of label 1 minus that of label 0 per node; ``pair[i, j]``: score of label i followed by j.
    """
    n, t = s.shape
    node = np.stack([np.zeros_like(s), s], axis=2)
    on = np.arange(t)[None, :] < length[:, None]
    a = np.empty_like(node)
    a[:, 0] = node[:, 0]
    for k in range(1, t):
        step = _lse(a[:, k - 1, :, None] + pair, 1) + node[:, k]
        a[:, k] = np.where(on[:, k, None], step, a[:, k - 1])
    z = _lse(a[:, -1], 1)
    b = np.zeros_like(node)
    pairs = np.zeros((2, 2))
    for k in range(t - 2, -1, -1):
        nxt = node[:, k + 1] + b[:, k + 1]
        live = on[:, k + 1]
        b[:, k] = np.where(live[:, None], _lse(pair + nxt[:, None, :], 2), 0.0)
        joint = np.exp(a[:, k, :, None] + pair + nxt[:, None, :] - z[:, None, None])
        pairs += (joint * live[:, None, None]).sum(axis=0)
    return np.exp(a[:, :, 1] + b[:, :, 1] - z[:, None]) * on, pairs, z


class Field:
    """Weights of the conditional random field and the scaling of its features."""

    def __init__(self):
        self.mean, self.scale = np.zeros(WIDTH), np.ones(WIDTH)
        self.weight, self.pair = np.zeros(WIDTH), np.zeros((2, 2))

    def fit(self, documents: list[tuple[np.ndarray, int]], steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY) -> Field:
        """Penalised maximum likelihood by Adam over all ``documents`` (line features, label)."""
        if not documents:
            return self
        xs = [with_neighbours(x) for x, _ in documents]
        flat = np.concatenate(xs)
        self.mean, self.scale = flat.mean(axis=0), flat.std(axis=0)
        self.mean[-1], self.scale[self.scale < 1e-6] = 0.0, 1.0
        length = np.array([len(x) for x in xs])
        t = length.max()
        x = np.zeros((len(xs), t, WIDTH))
        for i, own in enumerate(xs):
            x[i, :len(own)] = (own - self.mean) / self.scale
        y = np.array([label for _, label in documents], dtype=np.float64)
        on = np.arange(t)[None, :] < length[:, None]
        want = y[:, None] * on
        steps_in = (length - 1).sum(where=y == 1), (length - 1).sum(where=y == 0)
        have = np.array([[steps_in[1], 0.0], [0.0, steps_in[0]]])
        total = float(length.sum())
        theta = np.zeros(WIDTH + 4)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for i in range(1, steps + 1):
            marginal, pairs, _ = forward_backward(x @ theta[:WIDTH], length, theta[WIDTH:].reshape(2, 2))
            grad = np.concatenate([np.einsum("nt,ntf->f", want - marginal, x), (have - pairs).ravel()]) / total - penalty * theta
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            theta += rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
        self.weight, self.pair = theta[:WIDTH], theta[WIDTH:].reshape(2, 2)
        return self

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        """Length-weighted mean marginal of every text; texts of like length share a padded block of bounded size."""
        described = [line_features(t) for t in texts]
        out = np.empty(len(described))
        order = sorted(range(len(described)), key=lambda i: len(described[i][1]))
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and (hi - lo + 1) * len(described[order[hi]][1]) <= CELLS:
                hi += 1
            block = order[lo:hi]
            length = np.array([len(described[i][1]) for i in block])
            s, w = np.zeros((len(block), length[-1])), np.zeros((len(block), length[-1]))
            for k, i in enumerate(block):
                x, size = described[i]
                s[k, :len(size)] = ((with_neighbours(x) - self.mean) / self.scale) @ self.weight
                w[k, :len(size)] = size
            marginal, _, _ = forward_backward(s, length, self.pair)
            out[block] = (marginal * w).sum(axis=1) / w.sum(axis=1)
            lo = hi
        return np.clip(out, 0.0, 1.0)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, excerpt: int = EXCERPT) -> Field:
    """Field from labelled documents outside the held-out fold; the sample is the ``per_class`` least hashes of each label."""
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).filter(fold(F.col("doc_id")) != 0)
    parts = [known.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for q in (0, 1)]
    sample = parts[0].unionByName(parts[1])
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # 2 * per_class rows at most

    def describe(frames: Iterable[pd.DataFrame]):
        for pdf in frames:
            rows = []
            for doc_id, text, q in zip(pdf["doc_id"], pdf["text"], pdf["quality"], strict=True):
                x, _ = line_features(text)
                at = zlib.crc32(str(doc_id).encode()) % max(1, len(x) - excerpt + 1)
                rows.append((int(doc_id), int(q), np.ascontiguousarray(x[at:at + excerpt]).tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "quality", "x"])

    found = chosen.mapInPandas(describe, "doc_id long, quality int, x binary").orderBy("doc_id", "x").collect()
    return Field().fit([(np.frombuffer(r["x"]).reshape(-1, OWN), int(r["quality"] > 0)) for r in found])


def classify(docs: DataFrame, field: Field, cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(field.scores(text))

    scored = docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))


@query("op3_quality_crf")
def op3_quality_crf(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return classify(docs, train(docs, table(spark, sf_dir, "labels")))
