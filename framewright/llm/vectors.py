"""Vectors as both vector operators take them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_BYTES = 16 << 20  # of the vectors that a model or the upper splits of trees are fitted on


def unit_vectors(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int, int]:
    """(rows (vec_id, v), at most how many, their width): one row an id, without what has no direction.

    Rows whose id or vector is null, whose vector holds a null, NaN or infinity or is all zeros, or has another width than
    most (of equally frequent widths the greater), are left out. Of several vectors under an id the least stays.
    """
    raw = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<float>").alias("v")).filter("vec_id is not null and size(v) > 0")
    sound = raw.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    most = sound.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    n, width = (most.n, most.width) if most else (0, 0)
    return sound.filter(F.size("v") == width).groupBy("vec_id").agg(F.min("v").alias("v")), n, width


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A row of length 1 a vector."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    m = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float32)
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(size > 0, size, 1)


def sampled(rows: DataFrame, key: str, vector: str, n: int, width: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, vectors) of about ``most`` rows, fewer where they would take more than ``SAMPLE_BYTES``; chosen by a hash of the key."""
    most = min(most, SAMPLE_BYTES // (4 * max(width, 1)))
    lot = F.pmod(F.xxhash64(F.lit(17), key), F.lit(1 << 30))
    found = rows.filter(lot < int(min(1.0, most / max(n, 1)) * (1 << 30))).select(key, vector).toArrow()
    order = np.argsort(found.column(0).to_numpy(), kind="stable")
    return found.column(0).to_numpy()[order], (matrix(found.column(1), width) if len(order) else np.zeros((0, max(width, 1)), np.float32))[order]


def alike(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether cosines of unit vectors (..., s, w) and (..., t, w) are at least the threshold; near it they are worked out in double precision."""
    s = a @ np.swapaxes(b, -1, -2)
    out = s >= threshold
    edge = np.nonzero(np.abs(s - threshold) < 1e-5)
    if len(edge[0]):
        x, y = a[(*edge[:-2], edge[-2])].astype(np.float64), b[(*edge[:-2], edge[-1])].astype(np.float64)
        out[edge] = np.einsum("ij,ij->i", x, y) >= threshold * np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)
    return out
