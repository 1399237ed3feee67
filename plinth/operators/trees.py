"""Decision tree ensembles from flat node arrays: all trees of all rows advance together, one numpy step per level."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.operators.binning import finite


@lru_cache(maxsize=8)
def read_model(path: str) -> dict:
    """A JSON model, read once per process."""
    with open(path) as f:
        return json.load(f)


def walk(features: np.ndarray, model: dict) -> np.ndarray:
    """Sum (kind boosted: through a logistic) or mean (kind forest) of the leaves that rows reach. Forest features compare as 32-bit floats."""
    nodes = {k: np.asarray(model[k]) for k in ("left", "right", "feature", "threshold", "value", "leaf")}
    x = features.astype(np.float32).astype(np.float64) if model.get("kind") == "forest" else features
    at = np.tile(np.asarray(model["roots"]), (len(x), 1))
    rows = np.arange(len(x))[:, None]
    while True:
        open_ = ~nodes["leaf"][at].astype(bool)
        if not open_.any():
            break
        step = np.where(x[rows, nodes["feature"][at]] <= nodes["threshold"][at], nodes["left"][at], nodes["right"][at])
        at = np.where(open_, step, at)
    leaves = nodes["value"][at]
    if model.get("kind") == "forest":
        return leaves.mean(axis=1)
    return 1 / (1 + np.exp(-(leaves.sum(axis=1) + model.get("bias", 0.0))))


def score(df: DataFrame, model: dict, features: list[str], name: str = "score") -> DataFrame:
    """Adds the ensemble's score. Missing and infinite features count as 0; a model with a scale rounds its features half up to 1 / scale."""

    @F.pandas_udf("double")
    def run(*columns: pd.Series) -> pd.Series:
        x = np.stack([c.to_numpy(dtype=float, na_value=np.nan) for c in columns], axis=1)
        x = np.where(np.isfinite(x), x, 0.0)
        if model.get("scale"):
            x = np.floor(x * model["scale"] + 0.5) / model["scale"]
        return pd.Series(walk(x, model))

    return df.withColumn(name, run(*(F.col(f).cast("double") for f in features)))


def score_column(model: dict, features: list[str]) -> Column:
    """The same as one nested column without Python, for small ensembles: each tree is a CASE expression."""

    def tree(node: int) -> Column:
        if model["leaf"][node]:
            return F.lit(float(model["value"][node]))
        c = F.col(features[model["feature"][node]]).cast("double")
        c = F.when(finite(c), c).otherwise(0.0)
        if model.get("scale"):
            c = F.floor(c * float(model["scale"]) + 0.5) / float(model["scale"])
        if model.get("kind") == "forest":
            c = c.cast("float").cast("double")
        return F.when(c <= float(model["threshold"][node]), tree(model["left"][node])).otherwise(tree(model["right"][node]))

    total = sum((tree(r) for r in model["roots"]), F.lit(0.0))
    return total / len(model["roots"]) if model.get("kind") == "forest" else 1 / (1 + F.exp(-(total + float(model.get("bias", 0.0)))))
