"""Bounded samples of labelled rows, the fixed split into learning and held-out documents, hashed features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents whose crc32(doc_id as text) is divisible by this are held out: nothing is learned from them.
HOLD_OUT = 5


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the documents nothing is learned from; a null doc_id is never learned from either."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % HOLD_OUT == 0, F.lit(True))


def thinned(rows: DataFrame, counts: dict, column: str, per_value: int, key: str = "doc_id") -> DataFrame:
    """About per_value rows of each value of `column` (counts: rows of each value), chosen by a hash of the key; 2 * per_value * values at most."""
    space = 1 << 30
    at = F.pmod(F.xxhash64(key, F.lit(17)), F.lit(space))
    keep = F.lit(False)
    for value, n in counts.items():
        keep = keep | ((F.col(column) == F.lit(value)) & (at < int(min(1.0, per_value / max(n, 1)) * space)))
    return rows.where(keep).limit(2 * per_value * max(1, len(counts)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
