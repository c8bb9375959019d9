"""Whitening of embeddings: distributed covariance, a symmetric eigensolver for its leading pairs, broadcast projection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mapped, with_fields
from .vectors import common_size, floored, matrix

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Eigenvalues under this share of the largest are zero in double precision: the data have no such direction.
NO_DIRECTION = 1e-12
#: Eigenvalues nearer than this share of the matrix norm are a cluster, whose vectors are made orthogonal to each other.
CLUSTER = 1e-3


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Householder reflections of a symmetric matrix: diagonal, off-diagonal, and the reflectors as rows."""
    a, d = a.astype(float).copy(), len(a)
    reflectors = np.zeros((max(d - 2, 0), d))
    for j in range(d - 2):
        v = a[j + 1 :, j].copy()
        length = np.linalg.norm(v)
        if not length:
            continue
        end = -np.copysign(length, v[0])
        v[0] -= end
        v /= np.linalg.norm(v)
        block = a[j + 1 :, j + 1 :]
        p = block @ v
        w = p - (v @ p) * v
        block -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[j + 1 :, j] = 0
        a[j + 1, j] = end
        reflectors[j, j + 1 :] = v
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def below(diagonal: np.ndarray, squares: np.ndarray, x: np.ndarray, tiny: float) -> np.ndarray:
    """Sturm counts: how many eigenvalues of the tridiagonal matrix lie under each x."""
    q, count = diagonal[0] - x, 0
    for a, b in [*zip(diagonal[1:], squares), (0.0, 0.0)]:
        q = np.where(np.abs(q) < tiny, -tiny, q)  # an x that is a value of a leading block counts as over it
        count = count + (q < 0)
        q = a - x - b / q
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each by bisection on Sturm counts until its interval cannot be halved."""
    d = len(diagonal)
    reach = np.abs(np.append(off, 0)) + np.abs(np.append(0, off))
    norm = max(np.abs(diagonal).max() + reach.max(), np.finfo(float).tiny)
    low, high = np.full(k, (diagonal - reach).min() - 1e-12 * norm), np.full(k, (diagonal + reach).max() + 1e-12 * norm)
    wanted, tiny = d - 1 - np.arange(k), np.finfo(float).eps ** 2 * norm
    while True:
        middle = (low + high) / 2
        if not ((low < middle) & (middle < high) & (high - low > np.finfo(float).eps * np.maximum(np.abs(low), np.abs(high)) + tiny)).any():
            return middle
        over = below(diagonal, off**2, middle, tiny) > wanted
        low, high = np.where(over, low, middle), np.where(over, middle, high)


def shifted_solve(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray, right: np.ndarray, tiny: float) -> np.ndarray:
    """Solves (T - shift) y = right for each column and its shift, by elimination with row exchanges, all columns at once."""
    d, k = right.shape
    top, next_, third, y = np.empty((d, k)), np.zeros((d, k)), np.zeros((d, k)), right.copy()
    p, q = diagonal[0] - shifts, np.full(k, off[0] if d > 1 else 0.0)
    for i in range(d - 1):
        s, t, u = np.full(k, off[i]), diagonal[i + 1] - shifts, np.full(k, off[i + 1] if i + 2 < d else 0.0)
        swap = np.abs(s) > np.abs(p)
        top[i], next_[i], third[i] = np.where(swap, s, p), np.where(swap, t, q), np.where(swap, u, 0)
        top[i] = np.where(top[i] == 0, tiny, top[i])
        factor = np.where(swap, p, s) / top[i]
        p, q = np.where(swap, q, t) - factor * next_[i], np.where(swap, 0, u) - factor * third[i]
        upper = np.where(swap, y[i + 1], y[i])
        y[i + 1] = np.where(swap, y[i], y[i + 1]) - factor * upper
        y[i] = upper
    top[d - 1] = np.where(np.abs(p) < tiny, tiny, p)
    for i in reversed(range(d)):
        after = next_[i] * y[i + 1] if i + 1 < d else 0
        y[i] = (y[i] - after - (third[i] * y[i + 2] if i + 2 < d else 0)) / top[i]
    return y


def leading_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Unit eigenvectors as columns: inverse iteration, and after each round vectors of a cluster are made orthogonal again."""
    d, k = len(diagonal), len(values)
    norm = max(np.abs(diagonal).max() + 2 * np.abs(np.append(off, 0)).max(), np.finfo(float).tiny)
    starts = [0] + [j for j in range(1, k) if values[j - 1] - values[j] > CLUSTER * norm] + [k]
    y = np.random.default_rng(7).standard_normal((d, k))
    for _ in range(rounds):
        y = shifted_solve(diagonal, off, values, y / np.abs(y).max(0), np.finfo(float).eps * norm)
        y /= np.abs(y).max(0)
        for first, end in zip(starts, starts[1:]):
            for j in range(first, end):
                for _ in range(2):  # the second time takes out what rounding left
                    y[:, j] -= y[:, first:j] @ (y[:, first:j].T @ y[:, j])
                y[:, j] /= np.linalg.norm(y[:, j])
    return y


def leading_pairs(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values falling, unit vectors as columns) of at most k leading eigenpairs with a value above rounding."""
    d = len(covariance)
    if not d or not np.any(covariance):
        return np.zeros(0), np.zeros((d, 0))
    diagonal, off, reflectors = tridiagonal(covariance)
    values = leading_values(diagonal, off, min(k, d))
    values = values[values > NO_DIRECTION * values[0]]
    y = leading_vectors(diagonal, off, values)
    for v in reflectors[::-1]:
        y -= 2 * np.outer(v, v @ y)
    return values, y


def _sums(vectors: DataFrame, vec_col: str, size: int) -> list[int]:
    """Exact sums of the dimensions: a row a dimension and partition, added up by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += floored(matrix(batch.column(0), size)[1], SCALE, 2**40).sum(0) + 0
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(size), pa.int32()), "s": pa.array(total)})

    parts = mapped(vectors.select(vec_col), run, "i int, s long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = {r["i"]: int(r["s"]) for r in parts.collect()}  # a row a dimension
    return [found.get(i, 0) for i in range(size)]


def _products(vectors: DataFrame, vec_col: str, size: int, image) -> np.ndarray:
    """The sum of the outer products of image(vectors), which is a few columns wide: a triangle a partition, added up by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            x = image(matrix(batch.column(0), size)[1])
            total = total + x.T @ x
        if np.ndim(total):
            yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(len(total)), pa.int32()), "row": [total[i, : i + 1].tolist() for i in range(len(total))]}, schema=pa.schema([("i", pa.int32()), ("row", pa.list_(pa.float64()))]))

    parts = mapped(vectors.select(vec_col), run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x"))
    found = parts.groupBy("i", "j").agg(F.sum("x").alias("x")).toArrow()  # a row a pair of dimensions
    i, j, x = (found.column(c).to_numpy() for c in ("i", "j", "x"))
    out = np.zeros((max(i, default=-1) + 1,) * 2)
    out[i, j] = out[j, i] = x
    return out


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """One row for each vector that takes part: (id_col, n, deviation, whitened, explained, identity_error).

    An entry c counts as x = floor(64 c) + 1000000. whitened holds the centred vector on the k leading components of the
    covariance over all vectors, each divided by the root of its eigenvalue; explained their shares of the trace;
    deviation the exact sum over dimensions of (n x - sum)^2, as decimal(38, 0); identity_error how far the covariance
    of whitened, measured over all rows, is from the identity at most.

    Three passes count, multiply and measure, each with one small row set a partition; sums of a partition and the
    components are bounded by the dimension, whatever the number of rows, and only they go to the driver and back.
    Vectors that are null, hold null or non-finite entries or have another length than the commonest (ties: the longer)
    take no part. Repeated rows and rows without id count one by one. Directions without variance in double precision
    are no components, so constant tables and single rows have none and whitened is empty. Other columns are not read.
    An empty table gives no rows; an entry of 2**34 and more is an error.
    """
    spark = vectors.sparkSession
    n, size = common_size(vectors, vec_col)
    schema = with_fields(vectors, [id_col], "n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double")
    if not n:
        return spark.createDataFrame([], schema)
    sums = _sums(vectors, vec_col, size)
    whole = np.array([s // n for s in sums])
    part = np.array([s % n for s in sums])

    def centred(values: np.ndarray) -> np.ndarray:
        return (floored(values, SCALE, 2**40) - whole) - part / n

    covariance = _products(vectors, vec_col, size, centred) / n
    values, components = leading_pairs(covariance, k)
    explained = (values / np.trace(covariance)).tolist() if len(values) else []
    held = spark.sparkContext.broadcast(components / np.sqrt(values))  # size x k numbers
    images = _products(vectors, vec_col, size, lambda v: centred(v) @ held.value) / n  # centred vectors have centred images
    error = float(np.abs(images - np.eye(len(values))).max()) if len(values) else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = matrix(batch.column(1), size)
            x = floored(found, SCALE, 2**40) - whole
            image = (x - part / n) @ held.value
            if float(n) ** 2 * (np.abs(x).max(initial=0) + 1.0) ** 2 * size < 2**62:
                deviation = pa.array(((n * x - part) ** 2).sum(1)).cast(pa.decimal128(38, 0))
            else:
                deviation = pa.array([sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, part)) for row in x], pa.decimal128(38, 0))
            offsets = pa.array(np.arange(len(at) + 1, dtype=np.int32) * image.shape[1])
            shares = pa.array(explained * len(at), pa.float64())
            columns = [batch.column(0).take(pa.array(at)), pa.array(np.full(len(at), n)), deviation, pa.ListArray.from_arrays(offsets, image.ravel()), pa.ListArray.from_arrays(offsets, shares), pa.array(np.full(len(at), error))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return mapped(vectors.select(id_col, vec_col), run, schema)
