"""Whitening of embeddings by a weighted covariance over distinct vectors.

Identical vectors are grouped first (``x`` = floor(64 * entry) + 1000000, so equality is exact); each group is one row of the fit with its
count or one as weight. Sums are exact integers; the covariance is a weighted GEMM of centred blocks, one partial matrix a task, added up
cell by cell. Only the sums and the covariance pass the driver (the square of the dimension, whatever the number of rows), where they give
the components. Each distinct vector is whitened once, and the rows are joined back to it; a vector with a large share of the rows is joined
without a shuffle (``counted.join_counted``).

Defined results: rows whose vector is null, empty or holds a null, NaN or infinity are left out; if vectors differ in length, those of the most frequent
length (the longest of ties) are whitened and the others left out; a component whose eigenvalue is below ``FLAT`` of the largest has no
inverse root and is left out, so a table with one distinct vector gives no rows; repeated rows and null vec_ids are rows of their own; an
empty table gives no rows; other columns are ignored. Entries beyond a long are the nearest long, and so is ``deviation``.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import query, table
from tidemark.llm.counted import join_counted
from tidemark.session import cut_lineage

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
FLAT = 1e-12
LIMIT = (1 << 63) - 1


@dataclass
class Fit:
    """What whitening needs: number of fit rows (by weight), exact sums, components (rows), eigenvalues and total variance."""
    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float


def integer_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows whose vector can be used."""
    c = F.transform("embedding", lambda e: e.cast("double"))
    fit = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    low = F.lit(-float(1 << 62))
    x = F.transform(c, lambda e: F.floor(F.least(F.greatest(e * SCALE, low), -low)) + SHIFT)
    good = rows.filter(F.coalesce(fit, F.lit(False)) & (F.size("embedding") > 0)).select("vec_id", x.alias("x"))
    sizes = good.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    return good if most is None else good.filter(F.size("x") == most["d"])


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """(x, n): each vector once, with the number of its rows."""
    return cut_lineage(vectors.groupBy("x").agg(F.count("*").alias("n")))


def _block(b: pa.RecordBatch, k: int, width: int) -> np.ndarray:
    return b.column(k).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _sums(distinct: DataFrame, width: int, counts: bool) -> tuple[int, list[int]]:
    """Weights and exact weighted sums of every dimension; each task adds its own in integers of any size."""
    def add(batches: Iterable[pa.RecordBatch]):
        n, total = 0, np.zeros(width, dtype=object)
        for b in batches:
            if not b.num_rows:
                continue
            x, w = _block(b, 0, width), b.column(1).to_numpy() if counts else np.ones(b.num_rows, np.int64)
            n += int(w.sum())
            small = abs(x).max() < (1 << 62) // max(int(w.sum()), 1)
            total = total + ((x * w[:, None]).sum(axis=0).astype(object) if small else (x.astype(object) * w.astype(object)[:, None]).sum(axis=0))
        if n:
            yield pa.RecordBatch.from_pydict({"i": list(range(-1, width)), "s": [str(n), *map(str, total)]})

    parts = distinct.mapInArrow(add, "i long, s string")
    got = {r["i"]: int(r["s"]) for r in parts.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}  # a row a dimension
    return got.get(-1, 0), [got.get(i, 0) for i in range(width)]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """n * x - S, exact where it fits a long (else as objects), and x - S/n."""
    top = max(abs(int(x.max())), abs(int(x.min())))
    if top * n + max(map(abs, sums)) < LIMIT:
        exact = x * n - np.array(sums, dtype=np.int64)
    else:
        exact = x.astype(object) * n - np.array(sums, dtype=object)
    return exact, (exact / n).astype(np.float64)


def _gemm(blocks: DataFrame, width: int, prepare) -> np.ndarray:
    """Sum of ``a.T @ (w * a)`` over blocks (w, a) = prepare(batch): one partial matrix a task, its upper half added up cell by cell."""
    rows, cols = np.triu_indices(width)

    def product(batches: Iterable[pa.RecordBatch]):
        total = np.zeros((width, width))
        for b in batches:
            if b.num_rows:
                w, a = prepare(b)
                total += a.T @ (a * w[:, None])
        yield pa.RecordBatch.from_arrays([pa.array(rows * width + cols, pa.int64()), pa.array(total[rows, cols])], ["cell", "s"])

    out = np.zeros((width, width))
    for r in blocks.mapInArrow(product, "cell long, s double").groupBy("cell").agg(F.sum("s").alias("s")).collect():  # the square of the dimension
        i, j = divmod(r["cell"], width)
        out[i, j] = out[j, i] = r["s"]
    return out


def fit(distinct: DataFrame, components: int = COMPONENTS, counts: bool = False) -> Fit | None:
    """Components of the distinct vectors' covariance; ``counts`` weighs a vector by its rows, else each counts once."""
    one = distinct.select(F.size("x").alias("d")).first()
    if one is None:
        return None
    width = one["d"]
    n, sums = _sums(distinct, width, counts)

    def prepare(b: pa.RecordBatch):
        w = b.column(1).to_numpy().astype(np.float64) if counts else np.ones(b.num_rows)
        return w, _centred(_block(b, 0, width), n, sums)[1]

    v = _gemm(distinct, width, prepare) / n
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    values, vectors = values[order], vectors[:, order].T
    good = (values > FLAT * max(values[0], 0.0)) & (values > 0)
    values, vectors = values[good], vectors[good]
    sign = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)]) if len(vectors) else np.zeros(0)
    return Fit(n, sums, vectors * sign[:, None], values, float(np.trace(v)))


def whiten(vectors: DataFrame, distinct: DataFrame, model: Fit) -> tuple[DataFrame, DataFrame]:
    """(vec_id, deviation, w) for all rows, and (x, n, deviation, w) for the distinct vectors: ``w`` are the whitened components."""
    n, sums, width = model.n, model.sums, len(model.sums)
    project = model.components / np.sqrt(model.values)[:, None] if len(model.values) else model.components

    def run(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            if not b.num_rows:
                continue
            exact, centred = _centred(_block(b, 0, width), n, sums)
            top = float(np.abs(centred).max()) * n
            if exact.dtype == object or top * top * width >= LIMIT:
                exact = exact.astype(object)
                deviation = [min(int(d), LIMIT) for d in (exact * exact).sum(axis=1)]
            else:
                deviation = (exact * exact).sum(axis=1)
            w = centred @ project.T
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(deviation, pa.int64()), lists], ["x", "n", "deviation", "w"])

    white = cut_lineage(distinct.select("x", "n").mapInArrow(run, "x array<long>, n long, deviation long, w array<double>"))
    return join_counted(vectors, white, ["x"], "n").select("vec_id", "deviation", "w"), white


def identity_error(white: DataFrame, model: Fit, counts: bool = False) -> float:
    """Largest absolute entry of the whitened covariance minus the identity, over the fit."""
    k = len(model.values)

    def prepare(b: pa.RecordBatch):
        w = b.column(0).to_numpy().astype(np.float64) if counts else np.ones(b.num_rows)
        return w, _block(b, 1, k)

    def centre(b: pa.RecordBatch, mean: np.ndarray):
        w, a = prepare(b)
        return w, a - mean

    rows = white.select("n", "w")
    weight = F.col("n").cast("double") if counts else F.lit(1.0)
    mean = rows.select(weight.alias("_w"), F.posexplode("w")).groupBy("pos").agg((F.sum(F.col("_w") * F.col("col")) / F.lit(model.n)).alias("m")).collect()
    at = np.zeros(k)
    for r in mean:  # a row a component
        at[r["pos"]] = r["m"]
    return float(np.abs(_gemm(rows, k, lambda b: centre(b, at)) / model.n - np.eye(k)).max())


OUT = "vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened_rows(rows: DataFrame, components: int = COMPONENTS, counts: bool = False) -> DataFrame:
    """A row for each usable row of ``rows`` (vec_id, embedding) and component: its whitened value with the figures of the fit."""
    vectors = integer_vectors(rows)
    distinct = distinct_vectors(vectors)
    model = fit(distinct, components, counts)
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], OUT.format(kind=rows.schema["vec_id"].dataType.simpleString()))
    out, white = whiten(vectors, distinct, model)
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
    each = out.select("vec_id", "deviation", F.posexplode("w").alias("_k", "whitened"))
    return each.select("vec_id", (F.col("_k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                       F.get(explained, F.col("_k")).alias("explained"), F.lit(identity_error(white, model, counts)).alias("identity_error"))


@query("op13_whitening")
def op13_whitening(spark, sf_dir):
    return whitened_rows(table(spark, sf_dir, "embeddings"))
