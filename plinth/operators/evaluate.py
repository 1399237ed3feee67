"""Evaluation: confusion counts over distinct cells, error windows, completeness, pivots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(truth: DataFrame, found: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """tp, fp, fn, precision, recall and iou of distinct keys, per group."""
    on = [*by, *keys]
    t = truth.select(*on).distinct().withColumn("__t", F.lit(1))
    f = found.select(*on).distinct().withColumn("__f", F.lit(1))
    j = t.join(f, on, "full_outer")
    g = j.groupBy(*by).agg(F.count(F.when(F.col("__t").isNotNull() & F.col("__f").isNotNull(), 1)).alias("tp"), F.count(F.when(F.col("__t").isNull(), 1)).alias("fp"), F.count(F.when(F.col("__f").isNull(), 1)).alias("fn"))
    return g.withColumns({"precision": F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), "recall": F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), "iou": F.try_divide(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn"))})


def error_windows(errors: DataFrame, by: list[str], error: str, windows: dict[str, Column], limit: float) -> DataFrame:
    """n, rmse, p95, greatest error and rows beyond limit, of each named window: rows are copied into the windows that hold them."""
    names = F.array(*(F.when(c, F.lit(n)) for n, c in windows.items()))
    rows = errors.withColumn("window", F.explode(F.filter(names, lambda w: w.isNotNull())))
    e = F.col(error)
    return rows.groupBy(*by, "window").agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.percentile(F.abs(e), F.lit(0.95)).alias("p95"), F.max(F.abs(e)).alias("greatest"), F.count_if(F.abs(e) > limit).alias("beyond"))


def trajectory_score(errors: DataFrame, by: list[str], error: str, heading: str, limit: float) -> DataFrame:
    """Of each trajectory: rows, root mean square, mean, 95th percentile (linear) and greatest position error, heading error in degrees, rows beyond the limit."""
    e, h = F.col(error), F.col(heading)
    aggs = [F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("mean"), F.percentile(e, F.lit(0.95)).alias("p95"), F.max(e).alias("worst"), F.degrees(F.sqrt(F.avg(h * h))).alias("heading_rmse"), F.count_if(e > limit).alias("beyond")]
    return errors.groupBy(*by).agg(*aggs)


def with_completeness(summary: DataFrame, expected: DataFrame, keys: list[str], n: str, values: list[str]) -> DataFrame:
    """Expected combinations that are missing or short (expected_n) have infinite errors and complete = false."""
    j = expected.join(summary, keys, "left")
    full = F.coalesce(F.col(n) >= F.col("expected_n"), F.lit(False))
    return j.select(*keys, full.alias("complete"), *(F.when(full, F.col(v)).otherwise(F.lit(float("inf"))).alias(v) for v in values))


def pivoted(df: DataFrame, rows: list[str], column: str, names: list[str], value: Column) -> DataFrame:
    return df.groupBy(*rows).pivot(column, names).agg(value)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
