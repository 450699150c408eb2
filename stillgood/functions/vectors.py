"""Vector columns: Arrow batches in, numpy math inside the task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

DECIMALS = 6
SCALE = 10**DECIMALS


def list_matrix(column) -> np.ndarray:
    """Equal-length Arrow lists as a float64 matrix; a NULL vector is an error."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        raise ValueError("vector column holds NULLs; filter them out first")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True) if matrix.size else matrix
    return matrix / np.where(norms == 0, 1.0, norms) if matrix.size else matrix


def l2_normalize(embedding: Column) -> Column:
    """Unit-length copy of a vector; a zero vector stays zero."""
    wide = F.transform(embedding, lambda x: x.cast("double"))
    square = F.aggregate(wide, F.lit(0.0), lambda acc, x: acc + x * x)
    norm = F.when(square > 0, F.sqrt(square)).otherwise(F.lit(1.0))
    return F.transform(wide, lambda x: x / norm)


@F.arrow_udf(DoubleType())
def _cosine(a: pa.Array, b: pa.Array) -> pa.Array:
    usable = pc.and_(a.is_valid(), b.is_valid()).to_numpy(zero_copy_only=False)
    out = np.full(len(a), np.nan)
    if usable.any():
        mask = pa.array(usable)
        left, right = unit_rows(list_matrix(a.filter(mask))), unit_rows(list_matrix(b.filter(mask)))
        out[usable] = np.einsum("ij,ij->i", left, right)
    return pa.array(out, mask=~usable)


def cosine(a: Column, b: Column) -> Column:
    """Row-wise cosine similarity; NULL when either vector is missing."""
    return _cosine(a, b)


def rounded(similarity: Column) -> Column:
    return F.round(similarity, DECIMALS)
