"""What the two vector operators share."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def usable(vector: str):
    """Predicate: the vector has components, all finite and not all zero."""
    return f"""`{vector}` is not null and size(`{vector}`) > 0
        and forall(`{vector}`, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))
        and exists(`{vector}`, x -> x <> 0)"""


def matrix(column: pd.Series) -> np.ndarray:
    """Vectors of one length as rows in double precision."""
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, 0))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; the first step keeps squares of large values finite."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def by_length(frame: pd.DataFrame, vector: str):
    """Parts of a batch with vectors of equal length."""
    lengths = frame[vector].map(len)
    for n in sorted(set(lengths)):
        yield n, frame[lengths == n]


def as_doubles(vector: str):
    return F.col(vector).cast("array<double>")
