"""Valid vectors of Arrow batches as matrices, and blocks of a group for pairwise work."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most rows of one side of a pairwise block (a 2,000 x 2,000 product is 32 MB in double precision).
BLOCK_ROWS = 2_000


def usual_length(df: DataFrame, vector_col: str) -> int:
    """The most frequent length of the non-null vectors (the smaller one of equals), 0 for none."""
    top = df.where(F.col(vector_col).isNotNull()).groupBy(F.size(vector_col).alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").first()
    return int(top.n) if top else 0


def matrix(ids: pa.Array, vectors: pa.Array, dim: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and raw rows (double) of the valid vectors: of length ``dim``, all finite, not all zero."""
    ok = pc.fill_null(pc.and_(pc.equal(pc.list_value_length(vectors), dim), pc.is_valid(ids)), False)
    ids, vectors = ids.filter(ok), vectors.filter(ok)
    raw = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, max(dim, 1))
    good = np.isfinite(raw).all(axis=1) & (raw != 0).any(axis=1)
    return (ids, raw) if good.all() else (ids.filter(pa.array(good)), raw[good])


def unit(raw: np.ndarray) -> np.ndarray:
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def matrices(batches: Iterable[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for b in batches:
        ids, raw = matrix(b.column(0), b.column(1), dim)
        if len(ids):
            yield ids, raw


def packed(raw: np.ndarray) -> pa.Array:
    """Rows as binary values of four bytes a component, equal bytes of all components together: they compress better."""
    flat = np.ascontiguousarray(raw, dtype=np.float32)
    planes = np.ascontiguousarray(flat.view(np.uint8).reshape(len(flat), flat.shape[1], 4).transpose(0, 2, 1))
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * flat.shape[1]), len(flat), [None, pa.py_buffer(planes)]).cast(pa.binary())


def unpacked(column: pa.Array | pa.ChunkedArray, dim: int, kind: type = np.float64) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, dim), dtype=kind)
    _, places, data = column.buffers()
    places = np.frombuffer(places, dtype=np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    planes = np.frombuffer(data, dtype=np.uint8)[places[0] : places[-1]].reshape(-1, 4, dim)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.float32).reshape(-1, dim).astype(kind, copy=False)


def block_pairs(block: Column, blocks: Column) -> Column:
    """The pairs of blocks that a row of ``block`` meets: (left, right, side), left <= right. One pair if blocks is 1."""
    pair = lambda j: F.struct(F.least(block, j).alias("left"), F.greatest(block, j).alias("right"), (j >= block).alias("is_left"))
    return F.transform(F.sequence(F.lit(0), blocks - 1), pair)


def exact_squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of paired rows by differences, so that equal vectors are at exactly 0."""
    d = x - y
    return (d * d).sum(axis=1)
