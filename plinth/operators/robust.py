"""Robust lines by rounds of grouped aggregates; only the number of rounds is fixed, no rows reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.operators.graph import cut


def clipped_line(df: DataFrame, keys: list[str], x: str, y: str, rounds: int = 4, spreads: float = 3.0) -> DataFrame:
    """Slope and intercept of y on x per key, refitted over the rows within ``spreads`` of 1.4826 median absolute residuals.

    The first line goes through the medians of the halves of each key's x range, which single outliers don't move.
    """
    rows = cut(df.select(*keys, F.col(x).alias("__x"), F.col(y).alias("__y")), "line")
    middle = rows.groupBy(*keys).agg(F.median("__x").alias("__m"))
    low = F.col("__x") <= F.col("__m")
    halves = rows.join(middle, keys).groupBy(*keys).agg(*(F.median(F.when(c, F.col(v))).alias(n) for c, v, n in ((low, "__x", "x0"), (low, "__y", "y0"), (~low, "__x", "x1"), (~low, "__y", "y1"))))
    slope = F.try_divide(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0"))
    line = cut(halves.select(*keys, slope.alias("slope"), (F.col("y0") - slope * F.col("x0")).alias("intercept")), "line")
    for _ in range(rounds):
        r = rows.join(line, keys).withColumn("__r", F.col("__y") - F.col("slope") * F.col("__x") - F.col("intercept"))
        spread = r.groupBy(*keys).agg((1.4826 * F.median(F.abs("__r"))).alias("__s"))
        kept = r.join(spread, keys).where(F.abs("__r") <= F.greatest(spreads * F.col("__s"), F.lit(1e-9)))
        line = cut(kept.groupBy(*keys).agg(F.regr_slope("__y", "__x").alias("slope"), F.regr_intercept("__y", "__x").alias("intercept"), F.count("*").alias("n")), "line").select(*keys, "slope", "intercept", "n")
    return line
