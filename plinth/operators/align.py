"""Rigid alignment of paired points: fifteen sums in one aggregate, then a 3 x 3 decomposition on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rigid_alignment(pairs: DataFrame, source: list[str], target: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The rotation and shift that take source to target with the least squared error."""
    aggs = [F.avg(c).alias(f"m_{c}") for c in source + target] + [F.covar_pop(a, b).alias(f"c_{a}_{b}") for a in source for b in target]
    r = pairs.agg(*aggs).first()
    cov = np.array([[r[f"c_{a}_{b}"] for b in target] for a in source])
    u, _, v = np.linalg.svd(cov)
    flip = np.diag([1.0, 1.0, np.sign(np.linalg.det(v.T @ u.T))])
    rot = v.T @ flip @ u.T
    return rot, np.array([r[f"m_{c}"] for c in target]) - rot @ np.array([r[f"m_{c}"] for c in source])
