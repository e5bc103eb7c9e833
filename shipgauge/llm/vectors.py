"""Rows of vectors as numpy matrices, for operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

SOUND = "embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"


def sound() -> Column:
    """Neither null nor holding a null or a number that is not finite (column ``embedding`` of doubles)."""
    return F.expr(SOUND)


def matrix(column: pa.Array, width: int, dtype) -> np.ndarray:
    """Rows of ``width`` numbers each, from a list column without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(column), width)
