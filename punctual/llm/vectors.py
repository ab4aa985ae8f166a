"""Vectors with whole-number components, packed in chunks for numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors of a chunk: a row of a few hundred KB.
CHUNK = 1024
#: Components are held within these bounds, so that squared distances of vectors of up to 128 components stay whole 64-bit numbers.
MOST = 1 << 27


def usable(vector: Column, dims: int) -> Column:
    """Whether a vector has exactly dims components, none null, NaN or infinite."""
    return F.coalesce((F.size(vector) == dims) & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))


def whole(rows: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of every component, within MOST."""
    return np.clip(np.floor(rows.astype(np.float64) * scale), -MOST, MOST).astype(np.int64)


def narrow(values: np.ndarray) -> bytes:
    """Whole numbers in the narrowest of 2, 4 or 8 bytes, which the first byte tells."""
    low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
    size = next(k for k in (2, 4, 8) if -(1 << (8 * k - 1)) <= low and high < 1 << (8 * k - 1))
    return bytes([size]) + values.astype(f"<i{size}").tobytes()


def wide(packed: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(packed, f"<i{packed[0]}", offset=1).astype(np.int64).reshape(-1, columns)


def chunks(batches: Iterator[pa.RecordBatch], at: int, dims: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches, cut to CHUNK rows, and the vectors of their column `at`."""
    for batch in batches:
        for k in range(0, batch.num_rows, CHUNK):
            part = batch.slice(k, CHUNK)
            flat = part.column(at).flatten().to_numpy(zero_copy_only=False)
            yield part, whole(flat.reshape(part.num_rows, dims), scale)


def chunk_numbers() -> Iterator[int]:
    """Numbers that no other task gives."""
    from pyspark import TaskContext

    first = TaskContext.get().partitionId() << 32
    while True:
        yield first
        first += 1


def firsts(kept: DataFrame, n: int, *order: Column, vec_col: str, dims: int, scale: int) -> np.ndarray:
    """The n first vectors in this order, and among equals by components: n rows on the driver."""
    rows = kept.select(vec_col, *[x.alias(f"o{k}") for k, x in enumerate(order)]).orderBy(*[f"o{k}" for k in range(len(order))], vec_col).limit(n).collect()
    return whole(np.array([r[0] for r in rows], np.float64).reshape(len(rows), dims), scale)
