"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation (operator 11).

A is the matrix of the distinct centred vectors, spread over tasks. Each step is one
job: every task multiplies its rows by a direction t, y = A t, and sends back
transpose(A) y, the products of y with the left vectors so far, and y's length. The
left vectors are reorthogonalised with these on the driver, through their
coefficients (u = A q), so no vector as long as the table is ever kept; the right
ones, which have as many entries as an embedding, are reorthogonalised there too. The
small bidiagonal matrix' singular values are the deviations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, stage
from .vectors import as_matrix, blocks, dimension, quantized

#: A step that is this much shorter than the longest one is taken for zero.
TINY = 1e-10
#: Entries of the matrix that a task works on at once.
AT_ONCE = 1 << 18


def _parts(raw: bytes, d: int) -> Iterator[np.ndarray]:
    x = np.frombuffer(raw, "<i8").reshape(-1, d)
    per = max(1, AT_ONCE // d)
    for at in range(0, len(x), per):
        yield x[at : at + per]


def _summed(table: DataFrame, d: int, size: int, of_rows: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all vectors of ``of_rows`` (``size`` numbers); tasks send their own sums, which are added by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for raw in batch.column("x"):
                for x in _parts(raw.as_buffer(), d):
                    total += of_rows(x)
        yield pa.RecordBatch.from_pydict({"pos": pa.array(np.arange(size), pa.int64()), "value": pa.array(total)})

    out = np.zeros(size)
    for r in map_batches(table, run, "pos long, value double").groupBy("pos").agg(F.sum("value").alias("value")).collect():
        out[r.pos] = r.value
    return out


def _exact_sums(table: DataFrame, d: int) -> tuple[int, list[int], int]:
    """Number of vectors, sum of each entry, sum of all squares, without rounding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = 0, [0] * d, 0
        for batch in batches:
            for raw in batch.column("x"):
                for x in _parts(raw.as_buffer(), d):
                    large = len(x) * d * int(np.abs(x).max()) ** 2 >= 1 << 62
                    x = x.astype(object) if large else x
                    n, sums, squares = n + len(x), [a + int(b) for a, b in zip(sums, x.sum(axis=0), strict=True)], squares + int((x * x).sum())
        values = [n, *sums, squares]
        # two parts, for sums of more than 38 digits would not fit a decimal
        high, low = zip(*(divmod(v, 1 << 60) for v in values), strict=True)
        decimals = lambda xs: pa.array(list(map(Decimal, xs)), pa.decimal128(38, 0))
        yield pa.RecordBatch.from_pydict({"pos": pa.array(range(d + 2), pa.int64()), "high": decimals(high), "low": decimals(low)})

    sums = map_batches(table, run, "pos long, high decimal(38,0), low decimal(38,0)").groupBy("pos").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    found = {r.pos: (int(r.high) << 60) + int(r.low) for r in sums.collect()}
    return found.get(0, 0), [found.get(i + 1, 0) for i in range(d)], found.get(d + 1, 0)


def bidiagonalise(multiply: Callable, d: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest singular values of a matrix of ``d`` columns and their right vectors (as columns).

    ``multiply(t, Q)`` gives, for y = A t and U = A Q, transpose(A) y, transpose(U) y and
    y's squared length. A single start can miss all but one direction of a multiple
    singular value. So a run that has converged is followed by one from a direction at
    right angles to all before, until as many steps again have found nothing larger (or
    the right vectors span all).
    """
    rng = np.random.default_rng(11)
    right, coefficients, images = np.empty((d, 0)), np.empty((d, 0)), np.empty((d, 0))
    alphas, betas, settled = [], [], None

    def away(w: np.ndarray) -> np.ndarray:
        for _ in range(2):
            w = w - right @ (right.T @ w)
        return w

    def fresh() -> np.ndarray:
        w = away(rng.standard_normal(d))
        return w / np.linalg.norm(w)

    v, b = fresh(), 0.0
    while True:
        t = v - b * coefficients[:, -1] if b else v
        image, along, squared = multiply(t, coefficients)
        a = float(np.sqrt(max(0.0, squared - along @ along)))
        longest = max([a, *alphas, *betas])
        if a <= TINY * longest:
            a, q, z = 0.0, np.zeros(d), np.zeros(d)
        else:
            q, z = (t - coefficients @ along) / a, (image - images @ along) / a
        right, coefficients, images = (np.column_stack([m, c]) for m, c in ((right, v), (coefficients, q), (images, z)))
        alphas.append(a)
        k = len(alphas)
        small = np.diag(alphas) + np.diag(betas, 1)
        p, s, w = np.linalg.svd(small)
        if k == d or not longest:
            break
        step = away(z - a * v)
        b = float(np.linalg.norm(step))
        if b <= TINY * longest or not a:
            b = 0.0
        enough = min(wanted, d)
        if k >= enough and (b * np.abs(p[-1, :enough])).max() <= 4 * np.finfo(float).eps * s[0]:
            settled = settled or k
            if k >= 2 * settled:
                break
            if k == settled:
                b = 0.0
        v = step / b if b else fresh()
        betas.append(b)
    return s[:wanted], right @ w[:wanted].T


def whiten(rows: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = 4) -> DataFrame:
    """Principal components of the distinct vectors, and every row whitened along them.

    Entries c are taken as floor(256 * c). Returns for each row that can be used (see
    ``vectors.quantized``: vectors that are null, hold null or non-finite entries, or are
    not of the most common length drop out) and each component by falling deviation:
    key, component (from 1), n (distinct vectors), deviation (squared distance of n * x
    from their sum, exact), whitened, explained, identity_error (largest entry by which
    the whitened distinct vectors' covariance differs from the identity). Rows that
    repeat, or share or lack a key, are each returned; they weigh once. Components along
    which nothing varies don't exist, so a table of one distinct vector gives no rows,
    like an empty one. Other columns are ignored.

    One direction of as many numbers as an embedding has, and sums of as many, go between
    driver and tasks in a step; nothing there grows with the rows.
    """
    given = rows.select(F.col(key).alias("key"), F.col(column).alias("vector"))
    d = dimension(given, "vector") or 1
    x = quantized(given, "vector", d, ["key"])
    fit = stage(blocks(x.select("x").distinct(), d), "fit")
    n, sums, squares = _exact_sums(fit, d)
    mean = np.array([s / n for s in sums]) if n else np.zeros(d)

    def multiply(t: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        def of_rows(part: np.ndarray) -> np.ndarray:
            a = part - mean
            y = a @ t
            return np.concatenate([y @ a, y @ (a @ q), [y @ y]])

        got = _summed(fit, d, d + q.shape[1] + 1, of_rows)
        return got[:d], got[d:-1], float(got[-1])

    spread = n * squares - sum(s * s for s in sums)  # n ** 2 times the covariance's trace
    sigma, directions = bidiagonalise(multiply, d, components) if spread else (np.empty(0), np.empty((d, 0)))
    real = sigma > TINY * sigma.max(initial=0.0)
    sigma, directions = sigma[real], directions[:, real]
    k = len(sigma)
    scale = directions * (np.sqrt(n) / sigma)
    explained = [float(s * s * n / spread) for s in sigma]

    def products(part: np.ndarray) -> np.ndarray:
        w = (part - mean) @ scale
        return np.concatenate([(w.T @ w).ravel(), w.sum(axis=0)])

    error = 0.0
    if k:
        got = _summed(fit, d, k * k + k, products) / n
        covariance = got[: k * k].reshape(k, k) - np.outer(got[k * k :], got[k * k :])
        error = float(np.abs(covariance - np.eye(k)).max())
    far, exact = max(map(abs, sums), default=0), np.array(sums, object)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per = max(1, AT_ONCE // d)
        for whole in batches:
            for at in range(0, whole.num_rows if k else 0, per):
                batch = whole.slice(at, per)
                m, v = batch.num_rows, as_matrix(batch.column("x"), d)
                w = (v - mean) @ scale
                if (n * int(np.abs(v).max()) + far) ** 2 * d < 1 << 63:
                    apart = ((n * v - exact.astype("<i8")) ** 2).sum(axis=1).tolist()
                else:
                    apart = ((n * v.astype(object) - exact) ** 2).sum(axis=1).tolist()
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key").take(each),
                        pa.array(np.tile(np.arange(1, k + 1, dtype="i4"), m)),
                        pa.array([n], pa.int64()).take(pa.array(np.zeros(m * k, "i4"))),
                        pa.array([Decimal(a) if a < 10**38 else None for a in apart], pa.decimal128(38, 0)).take(each),
                        pa.array(w.ravel()),
                        pa.array(np.tile(explained, m)),
                        pa.array(np.full(m * k, error)),
                    ],
                    names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    kinds = {"component": T.IntegerType(), "n": T.LongType(), "deviation": T.DecimalType(38, 0), "whitened": T.DoubleType(), "explained": T.DoubleType(), "identity_error": T.DoubleType()}
    schema = T.StructType([x.schema["key"], *(T.StructField(c, kind) for c, kind in kinds.items())])
    return map_batches(x, project, schema).withColumnRenamed("key", key)
