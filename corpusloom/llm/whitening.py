"""Whitening of embeddings by principal components, without the covariance matrix.

Entries become whole numbers, x = floor(64 c) + 1000000, and the fit list holds each distinct x vector once. Block subspace iteration: one
Spark pass over the fit list computes Xᵀ(XQ) on centred rows for a block Q of orthonormal columns; the driver takes QR of what comes back and
Rayleigh-Ritz values and vectors of the block, and stops when the residuals of all wanted components are small. Between two Rayleigh-Ritz
restarts the block follows a Chebyshev recurrence, which takes the square root of the passes that plain powers need where eigenvalues
are close; a block as wide as the vectors is certified by its second pass at the latest. Only matrices of dimensions times block width reach the driver.

Centring is exact: whole numbers lose the whole part of their mean first, and its fraction after.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._columns import append, named, released, without
from ._store import Scratch

SCALE, SHIFT, K = 64, 1_000_000, 16
#: A block has so many columns for each wanted component: a wide block costs little in a pass and saves passes.
WIDTH = 4
#: Residuals of certified components, against the largest eigenvalue.
TOLERANCE = 1e-12
#: Passes between restarts, and passes at most; without certificates by then the fit fails.
DEGREE, MOST_PASSES = 10, 600
#: A component whose eigenvalue is below this share of the largest has no variance to divide by.
NO_VARIANCE = 1e-10


@dataclass(frozen=True)
class Model:
    """n distinct vectors with exact sums by dimension; unit components as columns, by falling eigenvalue."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float
    residuals: np.ndarray
    passes: int


def whole(vector: Column) -> Column:
    """The x vector; null for a null vector, and where an entry is null, not finite or too large for a long."""
    fits = F.forall(vector, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < 2.0**56), F.lit(False)))
    return F.when(fits, F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT).cast("long")))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of lists of d whole numbers each."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """n and the exact sums: halves of 32 bits are added apart, so that no partial sum overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for b in batches:
            x = _matrix(b.column(0), d)
            n, high, low = n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(high), pa.array(low)], ["i", "n", "high", "low"])

    found = fit.mapInArrow(released(run), "i int, n long, high long, low long").groupBy("i").agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")]).collect()
    found.sort(key=lambda r: r.i)
    return found[0].n, [(r.high << 32) + r.low for r in found]


def _centre(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The whole part of the mean and its fraction."""
    return np.array([s // n for s in sums], np.int64), np.array([s % n / n for s in sums])


def _pass(fit: DataFrame, n: int, sums: list[int], q: np.ndarray) -> tuple[np.ndarray, float]:
    """Xᵀ(XQ) / n over centred rows, and the trace of XᵀX / n. Each task adds up its own rows; tasks are added by row of the result."""
    d, width = q.shape
    base, rest = _centre(n, sums)
    names = [f"c{j}" for j in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d + 1, width))
        for b in batches:
            y = (_matrix(b.column(0), d) - base) - rest
            total[:d] += y.T @ (y @ q)
            total[d, 0] += np.einsum("ij,ij->", y, y)
        yield pa.RecordBatch.from_arrays([pa.array(range(d + 1), pa.int32()), *map(pa.array, np.ascontiguousarray(total.T))], ["i", *names])

    schema = T.StructType([T.StructField("i", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in names]])
    found = fit.mapInArrow(released(run), schema).groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).toArrow().sort_by("i")
    out = np.column_stack([found[c].to_numpy() for c in names]) / n
    return out[:d], float(out[d, 0])


def _components(fit: DataFrame, n: int, sums: list[int], k: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, int]:
    """The first k eigenvectors and eigenvalues of the covariance, their residuals, its trace, and how many passes it took."""
    d = len(sums)
    y = np.linalg.qr(np.random.default_rng(7).normal(size=(d, width)))[0]
    before, step, cut = None, 0, 0.0
    for passes in range(1, MOST_PASSES + 1):
        q, r = np.linalg.qr(y)
        aq, trace = _pass(fit, n, sums, q)
        small = q.T @ aq
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors = q @ turn
        residuals = np.linalg.norm(aq @ turn - vectors * values, axis=0)[:k]
        if values[0] <= 0 or (residuals <= TOLERANCE * values[0]).all():
            return vectors[:, :k], values[:k], residuals, trace, passes
        if before is None or step == DEGREE or np.linalg.cond(r) > 1e8:  # restart from the Ritz vectors
            before, y, step, cut = vectors, aq @ turn, 0, max(values[-1], 1e-12 * values[0])
            half = cut / 2
            y = (y - half * before) / half
        else:  # the recurrence damps eigenvalues from 0 to cut
            before, y, step = y, 2 / half * (aq @ r - half * y) - before, step + 1
        scale = np.linalg.norm(y, axis=0).max()
        before, y = before / scale, y / scale
    raise RuntimeError(f"components are not certified after {MOST_PASSES} passes: residuals {residuals / values[0]}")


def fit(vectors: DataFrame, scratch: Scratch, vector: str = "embedding", k: int = K, width: int | None = None) -> Model | None:
    """The model of a table of vectors; None if none can be used.

    Rows that `whole` makes null are left out. Vectors of several lengths have no common covariance: those of the length that most
    distinct vectors have count (ties: the longest). Repeated vectors count once. Components without variance, as of a
    table of one vector, are left out, so there can be fewer than k."""
    distinct = scratch.save(vectors.select(whole(named(vector)).alias("x")).where("size(x) > 0").distinct(), "fit")
    lengths = [(r.n, r.d) for r in distinct.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()]
    if not lengths:
        return None
    d = lengths[0][1]
    own = distinct.where(F.size("x") == d)
    n, sums = _sums(own, d)
    v, e, residuals, trace, passes = _components(own, n, sums, min(k, d), min(d, width or WIDTH * k))
    some = e > NO_VARIANCE * max(e[0], 0) if e[0] > 0 else np.zeros(len(e), bool)
    v, e, residuals = v[:, some], e[some], residuals[some]
    error = 0.0
    if len(e):  # measured by a pass of its own
        w = v / np.sqrt(e)
        error = float(np.abs(w.T @ _pass(own, n, sums, w)[0] - np.eye(len(e))).max())
    return Model(n, sums, v, e, trace, error, residuals, passes + 1)


def _deviations(x: np.ndarray, base: np.ndarray, n: int, rest: np.ndarray) -> pa.Array:
    """Sums of (n x - S)², exact; null where a sum is too large for a long. rest: S - n base."""
    far = np.abs(x - base).max(initial=0)
    rough = (float(far) * n + n) ** 2 * x.shape[1]
    if rough < 2.0**62:
        return pa.array((((x - base) * n - rest) ** 2).sum(1))
    exact = [sum((int(c) * n - int(r)) ** 2 for c, r in zip(row, rest, strict=True)) for row in (x - base)]
    return pa.array([s if s < 1 << 63 else None for s in exact], pa.int64())


def whiten(vectors: DataFrame, model: Model | None, vector: str = "embedding") -> DataFrame:
    """vectors with deviation (long) and whitened (array<double>, one entry for each component), in the place of columns with these names.
    Rows whose vector cannot be used are not there; every other row is, repeated ones as often as they are in the table, whatever else is
    null in it. An empty table, and one without a usable vector, give none."""
    if model is None:
        own = without(vectors, ["deviation", "whitened"]).where("false")
        return own.select("*", F.lit(None).cast("long").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened"))
    d = len(model.sums)
    fields = [T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))]
    rows = vectors.withColumn("_x", whole(named(vector))).where(F.size("_x") == d)
    at = rows.columns.index("_x") - sum(c.lower() in ("deviation", "whitened") for c in rows.columns[: rows.columns.index("_x")])

    def make():
        base, part = _centre(model.n, model.sums)
        rest = np.array([s % model.n for s in model.sums], np.int64)
        w = model.components / np.sqrt(model.eigenvalues)

        def work(b: pa.RecordBatch) -> list:
            x = _matrix(b.column(at), d)
            z = ((x - base) - part) @ w
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * w.shape[1])
            return [_deviations(x, base, model.n, rest), pa.ListArray.from_arrays(ends, pa.array(z.ravel()))]

        return work

    return append(rows, fields, make).drop("_x")


def digest(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """A row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error, residual."""
    scratch = Scratch(vectors.sparkSession, "whitening")
    own = vectors.select(named(vec_id).alias(vec_id), named(vector).alias("_vector"))
    model = fit(own, scratch, "_vector", k)
    long = whiten(own, model, "_vector").select(vec_id, "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    per = lambda values: F.element_at(F.array(*map(F.lit, values or [0.0])), F.col("_at") + 1)
    explained = (model.eigenvalues / model.trace).tolist() if model and len(model.eigenvalues) else []
    residuals = (model.residuals / model.eigenvalues[0]).tolist() if explained else []
    return long.select(
        vec_id, (F.col("_at") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened",
        per(explained).alias("explained"), F.lit(model.identity_error if model else 0.0).alias("identity_error"), per(residuals).alias("residual"),
    )
