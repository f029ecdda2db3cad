"""Whole-number vectors that the embedding operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches

#: Bytes of whole-number vectors in one row of a table of blocks.
BLOCK_BYTES = 1 << 20
_WORD = np.dtype("<i8")


def dimension(rows: DataFrame, column: str) -> int:
    """The most common length of a vector (of equally common ones the longest); 0 if there is none."""
    lengths = rows.groupBy(F.size(column).alias("d")).count().where("d > 0")
    found = lengths.orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return found[0].d if found else 0


def as_binary(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    matrix = np.ascontiguousarray(matrix)
    kind = pa.binary(matrix.shape[1] * matrix.itemsize)
    return pa.FixedSizeBinaryArray.from_buffers(kind, len(matrix), [None, pa.py_buffer(matrix)]).cast(pa.binary())


def as_matrix(column: pa.Array, d: int) -> np.ndarray:
    """Binary values of ``as_binary`` as one matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), _WORD).reshape(-1, d)


def whole(column: pa.Array, d: int, limit: int = 1 << 62) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that can be used, and these as floor(256 * entry), each below ``limit`` in size."""
    at = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    sizes = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    at = at[sizes[at] == d]
    values = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, d)
    values = np.floor(256 * values)  # a null entry is NaN here
    fit = (np.abs(values) < limit).all(axis=1)
    return at[fit], values[fit].astype(_WORD)


def quantized(rows: DataFrame, column: str, d: int, keep: list[str], limit: int = 1 << 62) -> DataFrame:
    """``keep`` and x, the vector's entries as floor(256 * entry) in 64-bit integers.

    Rows are left out whose vector is null, holds a null, NaN or infinite entry, has not
    ``d`` entries, or an entry that becomes ``limit`` or more in size (sums of products
    then leave 63 bits).
    """

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = whole(batch.column(column), d, limit)
            left = [batch.column(c).take(pa.array(at)) for c in keep]
            yield pa.RecordBatch.from_arrays([*left, as_binary(x)], names=[*keep, "x"])

    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField("x", T.BinaryType())])
    return map_batches(rows.select(*keep, column), convert, schema)


def blocks(distinct: DataFrame, d: int) -> DataFrame:
    """``distinct(x)`` packed into rows of many vectors, about ``BLOCK_BYTES`` each."""
    per = max(1, BLOCK_BYTES // (d * _WORD.itemsize))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            held += batch.column("x").to_pylist()
            while len(held) >= per:
                yield pa.RecordBatch.from_pydict({"x": pa.array([b"".join(held[:per])], pa.binary())})
                held = held[per:]
        if held:
            yield pa.RecordBatch.from_pydict({"x": pa.array([b"".join(held)], pa.binary())})

    return map_batches(distinct, pack, "x binary")
