"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The covariance is never formed and no vector leaves its task. A pass multiplies it with a block of directions: each task centres its
vectors, forms Xc' (Xc Q) and emits one row per dimension, which an aggregate adds up. The driver holds blocks of (dimensions x
directions) numbers, whatever the number of vectors.

A round applies a Chebyshev polynomial of the covariance to the block, one pass a degree. The polynomial stays within one on the part
of the spectrum below the block's smallest Ritz value and grows fast above it, so unwanted directions are damped. Then comes a QR
factorisation and a Rayleigh-Ritz step, and the residual of every wanted pair is taken. By the residual bound of symmetric matrices
an eigenvalue lies within that residual of each Ritz value; rounds go on until the residuals are at the level of rounding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.stage import stage

SCALE, SHIFT = 1024, 100_000  # an entry c becomes the integer floor(SCALE * c) + SHIFT
SPARE = 24  # directions beyond the wanted ones: they set the edge of the damped spectrum
DEGREE, ROUNDS = 10, 60
LIFT = 1e6  # largest growth of the first direction over the last wanted one in a round
CERTIFIED, STALLED = 2e-15, 1e-10  # residuals over the largest eigenvalue: sure end; worst at which an end by rounding is accepted


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """`vec_id, x`: vectors that have no null and no non-finite entry, as integers. A null vector goes, an empty one stays."""
    whole = F.col(vector_col).cast("array<double>")
    good = F.col("c").isNotNull() & F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    base = vectors.select(F.col(id_col).alias("vec_id"), whole.alias("c")).where(good)
    return base.select("vec_id", F.transform("c", lambda v: F.floor(v * SCALE).cast("long") + SHIFT).alias("x"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors of a batch as the rows of a matrix of long."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), dims)


def added(rows: DataFrame, dims: int, width: int, piece: Callable[[np.ndarray], np.ndarray], lines: int) -> np.ndarray:
    """Sum over all batches of `piece`, a matrix of `lines` x `width` for each. One row a line leaves a task."""
    names = [f"c{j}" for j in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((lines, width))
        for b in batches:
            if b.num_rows:
                total += piece(matrix(b.column(0), dims).astype(np.float64))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(lines)), *(pa.array(total[:, j]) for j in range(width))], names=["line", *names])

    parts = rows.select("x").mapInArrow(run, "line long, " + ", ".join(f"{c} double" for c in names))
    out = np.zeros((lines, width))
    for r in parts.groupBy("line").agg(*[F.sum(c).alias(c) for c in names]).collect():
        out[r["line"]] = [r[c] for c in names]
    return out


def sums(rows: DataFrame, dims: int) -> np.ndarray:
    """Exact sum of each dimension, as Python integers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = matrix(b.column(0), dims).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(total)], names=["line", "s"])

    found = rows.select("x").mapInArrow(run, "line long, s long").groupBy("line").agg(F.sum("s").alias("s")).collect()
    return np.array([s for _, s in sorted((r["line"], r["s"]) for r in found)], object)


def degree(edge: float, least: float, top: float) -> int:
    """The degree of a filter: `DEGREE`, or less where it would lift `top` over `least` so far that a block loses its smaller directions."""
    growth = [float(np.arccosh(max(1.0, 2 * v / edge - 1))) for v in (least, top)]
    return max(1, min(DEGREE, int(np.log(LIFT) / max(1e-9, growth[1] - growth[0]))))


def filtered(times: Callable[[np.ndarray], np.ndarray], q: np.ndarray, edge: float, top: float, steps: int) -> np.ndarray:
    """The scaled Chebyshev polynomial of that degree of the covariance, applied to q: small on [0, edge], about one at `top`."""
    half = edge / 2
    sigma = first = half / (top - half)
    before, now = q, (times(q) - half * q) * (first / half)
    for _ in range(steps - 1):
        after = 1 / (2 / first - sigma)
        before, now = now, 2 * (after / half) * (times(now) - half * now) - sigma * after * before
        sigma = after
    return now


def eigenpairs(times: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The `wanted` largest eigenvalues, falling, their unit vectors as columns, and the largest residual over the largest value.

    An end counts as certified when all residuals are at rounding level, or when they stopped falling under `STALLED`. Eigenvalues
    that are equal have no vectors of their own; then the ones found are one choice of an orthonormal basis.
    """
    width = min(dims, wanted + SPARE)
    q = np.linalg.qr(np.random.default_rng(7).standard_normal((dims, width)))[0]
    last = np.inf
    for _ in range(ROUNDS):
        vq = times(q)
        values, turn = np.linalg.eigh((q.T @ vq + vq.T @ q) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        top = float(values[0])
        if top <= 0:
            return np.zeros(wanted), q[:, :wanted], 0.0
        left = float(np.linalg.norm(vq - q * values, axis=0)[:wanted].max()) / top
        if left <= CERTIFIED or left <= STALLED and left > last / 4:
            return np.maximum(values[:wanted], 0), q[:, :wanted], left
        last = left
        edge = float(values[-1])
        if edge <= top * 1e-14:  # the block spans all there is but rounding: plain steps do
            q = np.linalg.qr(vq + q * (top * 1e-3))[0]
        else:
            q = np.linalg.qr(filtered(times, q, edge, top, degree(edge, float(values[wanted - 1]), top)))[0]
    raise ArithmeticError(f"eigenpairs not certified after {ROUNDS} rounds: residual {left:.1e} of the largest eigenvalue")


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector and component: `vec_id, component, n, deviation, whitened, explained, identity_error`.

    Vectors that are null or hold a null or non-finite entry are left out; all others are fitted on and returned, repeated rows and
    rows with a null id each. Entries become integers (`integers`). `n` counts the vectors; `deviation` is the exact sum over
    dimensions of (n * x - S)**2, S the sum of the dimension, and the job fails by name if that is no long. `whitened` is the
    projection of x - S / n on the unit eigenvector of the covariance (divisor n) over the root of its eigenvalue e, `explained` is
    e / trace. Components are numbered from 1 by falling e, as many as there are dimensions at most. `identity_error` is the largest
    entry of the covariance of `whitened`, measured in a pass of its own, minus the identity. A component without variance has a null
    `whitened` and does not count there; if none has variance, `explained` and `identity_error` are null. Vectors of different
    lengths fail by name. Empty vectors and an empty table give no rows. Other columns are not read.
    """
    rows = stage(integers(vectors, id_col, vector_col), "vectors")
    shape = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high")).first()
    n, dims = shape["n"], shape["high"] or 0
    if n and shape["low"] != dims:
        raise ValueError(f"vectors of {shape['low']} to {dims} entries: all must have the same number")
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not n or not dims:
        return rows.sparkSession.createDataFrame([], schema)
    total = sums(rows, dims)
    mean = np.array([s / n for s in total])  # exact integers, rounded once

    def times(q: np.ndarray) -> np.ndarray:
        return added(rows, dims, q.shape[1], lambda x: (x - mean).T @ ((x - mean) @ q), dims) / n

    wanted = min(components, dims)
    values, q, _ = eigenpairs(times, dims, wanted)
    trace = float(added(rows, dims, 1, lambda x: np.array([[((x - mean) ** 2).sum()]]), 1)[0, 0]) / n
    live = values > (values[0] * 1e-13 if trace > 0 else np.inf)
    turn = q / np.sqrt(np.where(live, values, 1.0))

    def moments(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ turn
        return np.vstack([w.T @ w, w.sum(axis=0)])

    held = added(rows, dims, wanted, moments, wanted + 1) / n
    off = np.abs(held[:wanted] - np.outer(held[-1], held[-1]) - np.eye(wanted))[np.ix_(live, live)]
    error, share = (float(off.max()), values / trace) if live.any() else (None, [None] * wanted)
    exact = np.array([int(s) for s in total], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(1), dims)
            rough = ((n * (x - mean)) ** 2).sum(axis=1)
            if rough.max() >= 2.0**63 - 1e6 or n * max(abs(int(x.max())), abs(int(x.min()))) >= 2**62:
                raise OverflowError("deviation does not fit a long")
            deviation = ((n * x - exact.astype(np.int64)) ** 2).sum(axis=1)
            w = (x - mean) @ turn
            blank = np.tile(~live, b.num_rows)
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), wanted))), pa.array(np.tile(np.arange(1, wanted + 1, dtype=np.int32), b.num_rows)),
                pa.array(np.full(b.num_rows * wanted, n)), pa.array(np.repeat(deviation, wanted)), pa.array(w.ravel(), mask=blank),
                pa.array(list(share) * b.num_rows, pa.float64()), pa.array([error] * (b.num_rows * wanted), pa.float64()),
            ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(run, schema)
