"""Digests of numbers as bytes, the same in every language."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles_sha256(*columns: str) -> Column:
    """SHA-256, in hexadecimal, of the columns packed as little-endian doubles; null if one is null. Arrow batches: SQL has no bytes of doubles."""

    @F.pandas_udf("string")
    def digest(*parts: pd.Series) -> pd.Series:
        rows = np.stack([p.to_numpy(np.float64, na_value=np.nan) for p in parts], axis=1).astype("<f8")
        missing = np.any([p.isna().to_numpy() for p in parts], axis=0)
        return pd.Series([None if m else hashlib.sha256(r.tobytes()).hexdigest() for r, m in zip(rows, missing)])

    return digest(*(F.col(c).cast("double") for c in columns))
