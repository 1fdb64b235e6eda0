"""Vectors as rows: which take part, and their float64 matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F


def usable(column: str):
    """Column: neither null nor empty, and every component a finite number."""
    c = F.col(column)
    return F.coalesce(c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def matrix(rows, width: int) -> np.ndarray:
    """Rows of any lengths up to width, padded by zeros."""
    out = np.zeros((len(rows), width))
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out
