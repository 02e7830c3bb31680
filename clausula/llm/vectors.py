"""What the vector operators share: which rows count, vectors as bytes, matrices in tasks, and tasks that hold one side while the other streams past."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """True for a vector whose components are all finite numbers; a null vector gives false."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def usual_length(vectors: DataFrame, vector: str) -> int:
    """The most common length of a column of finite vectors (of equals the least); 0 of an empty table."""
    n = F.size(F.col(f"`{vector}`")).alias("n")
    found = vectors.select(n).groupBy("n").count().orderBy(F.desc("count"), "n").first()
    return found.n if found else 0


def packed(column: pa.Array) -> pa.Array:
    """A list column without nulls, all lists of one length, as bytes of float64."""
    n = len(column)
    flat = np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    width = flat.nbytes // n if n else 0
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(flat)])


def matrix(column: pa.Array | pa.ChunkedArray, dtype, width: int) -> np.ndarray:
    """A binary column as rows of numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def blobs(rows: np.ndarray) -> pa.Array:
    """Rows of numbers as a binary column."""
    rows = np.ascontiguousarray(rows)
    width = rows.strides[0] if rows.ndim > 1 else rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32)), pa.py_buffer(rows)])


def passed_by(batches, held_of, visit, left=None, key: str = "cell", most: int = 512):
    """Rows sorted by cell and side: of each cell those of side 0 are held (held_of makes an object of their table), and
    those of side 1 stream past it, `most` at a time. visit(held, rows) and left(held) give batches or None."""
    now, parts, held = None, [], None

    def closed():
        if left is not None and now is not None and (held is not None or parts):
            yield left(held if held is not None else held_of(pa.Table.from_batches(parts)))

    for b in batches:
        if not b.num_rows:
            continue
        cell, side = b[key].to_numpy(), b["side"].to_numpy()
        start = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (side[1:] != side[:-1])])
        for i, j in zip(start.tolist(), np.r_[start[1:], len(cell)].tolist()):
            if cell[i] != now:
                yield from (out for out in closed() if out is not None)
                now, parts, held = cell[i], [], None
            if side[i] == 0:
                parts.append(b.slice(i, j - i))
                continue
            if not parts and held is None:  # nothing is held here
                continue
            if held is None:
                held, parts = held_of(pa.Table.from_batches(parts)), []
            for at in range(i, j, most):
                out = visit(held, b.slice(at, min(most, j - at)))
                if out is not None:
                    yield out
    yield from (out for out in closed() if out is not None)
