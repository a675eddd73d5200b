"""Vector expressions in double precision."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalized(a: Column) -> Column:
    """a scaled to length 1; a zero vector stays as it is."""
    length = F.sqrt(dot(a, a))
    # The length is repeated into an array so that it is computed once a row, not once an element.
    return F.zip_with(a, F.array_repeat(F.when(length > 0, length).otherwise(1.0), F.size(a)), lambda x, n: x / n)


def hashed_embedding(text: Column, size: int = 64) -> Column:
    """A deterministic stand-in for an embedding model: signed hashed word counts, in Arrow batches."""
    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        def one(value: str | None) -> np.ndarray:
            codes = np.array([zlib.crc32(w.encode()) for w in re.findall(r"\w+", (value or "").lower())], dtype=np.int64)
            return np.bincount(codes % size, weights=np.where(codes >> 16 & 1, 1.0, -1.0), minlength=size)

        return texts.map(one)

    return embed(text)
