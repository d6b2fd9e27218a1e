"""Vectors of whole numbers from a column of embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scaled components beyond this are cut to it, so that none leaves the range of a long.
LARGEST = float(1 << 61)


def whole_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int, shift: int = 0) -> DataFrame:
    """``id`` and ``x``, each component c as the long floor(scale * c) + shift.

    Rows whose vector is null or holds null, NaN or infinite components are left out.
    """
    vector = F.col(vec_col).cast("array<double>")
    found = df.select(F.col(id_col).alias("id"), vector.alias("v")).where(
        "v IS NOT NULL AND forall(v, c -> coalesce(NOT isnan(c) AND abs(c) < double('infinity'), FALSE))")
    whole = f"CAST(floor(greatest({-LARGEST!r}D, least({LARGEST!r}D, {scale} * c))) AS BIGINT) + {shift}"
    return found.select("id", F.expr(f"transform(v, c -> {whole})").alias("x"))


def padded(x: str, length: int, fill: int) -> Column:
    """Vectors shorter than ``length`` count as if zeros, scaled to ``fill``, followed."""
    return F.expr(f"concat({x}, array_repeat({fill}L, {length} - size({x})))")


def matrix(column: pa.Array, length: int) -> np.ndarray:
    """The vectors of an Arrow batch as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), length)
