"""Ordered numeric operators over (keys, time): differences, integrals, smoothing, gradients, unwrapping, dead reckoning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def difference(df: DataFrame, keys: list[str], order: list[str], value: str, name: str = "diff") -> DataFrame:
    return df.withColumn(name, F.col(value) - F.lag(value).over(_w(keys, order)))


def trapezoid(df: DataFrame, keys: list[str], time: str, value: str, name: str = "integral") -> DataFrame:
    """Running integral of value over time by trapezoids, 0 at the first row."""
    w = _w(keys, [time])
    step = F.coalesce((F.col(time) - F.lag(time).over(w)) * (F.col(value) + F.lag(value).over(w)) / 2, F.lit(0.0))
    return df.withColumn("__s", step).withColumn(name, F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__s")


def anchored(df: DataFrame, keys: list[str], time: str, integral: str, closure: Column, name: str = "anchored") -> DataFrame:
    """A running integral with its closure error spread linearly over the time of the key: exact at both ends."""
    by = Window.partitionBy(*keys)
    first, last = F.min(time).over(by), F.max(time).over(by)
    end = F.max(F.struct(F.col(time), F.col(integral))).over(by)[integral]
    share = F.when(last > first, (F.col(time) - first) / F.when(last > first, last - first)).otherwise(0.0)
    return df.withColumn(name, F.col(integral) + (closure - end) * share)


def box_mean(df: DataFrame, keys: list[str], order: list[str], value: str, half: int, name: str = "smooth") -> DataFrame:
    """Centred moving sum over 2 half + 1 rows, missing rows as zeros, divided by the full width."""
    return df.withColumn(name, F.sum(value).over(_w(keys, order).rowsBetween(-half, half)) / (2 * half + 1))


def gradient(df: DataFrame, keys: list[str], time: str, value: str, name: str = "gradient") -> DataFrame:
    """Second-order central differences on uneven steps, one-sided at the ends; null for a single row."""
    w = _w(keys, [time])
    before, after = F.col(time) - F.lag(time).over(w), F.lead(time).over(w) - F.col(time)
    down, up = (F.col(value) - F.lag(value).over(w)) / before, (F.lead(value).over(w) - F.col(value)) / after
    return df.withColumn(name, F.when(before.isNull(), up).when(after.isNull(), down).otherwise((down * after + up * before) / (before + after)))


def unwrapped(df: DataFrame, keys: list[str], order: list[str], angle: str, name: str = "unwrapped") -> DataFrame:
    """Angles without jumps of full turns."""
    w = _w(keys, order)
    step = F.col(angle) - F.lag(angle).over(w)
    turns = F.coalesce(F.floor((step + math.pi) / (2 * math.pi)), F.lit(0))
    return df.withColumn("__k", turns).withColumn(name, F.col(angle) - 2 * math.pi * F.sum("__k").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__k")


def repair_spikes(df: DataFrame, keys: list[str], order: list[str], value: str, jump: float, name: str = "repaired") -> DataFrame:
    """A single row that leaves its neighbours by more than jump, both ways alike, takes their mean."""
    w = _w(keys, order)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    out, back = F.col(value) - before, F.col(value) - after
    spike = (F.abs(out) > jump) & (F.abs(back) > jump) & (out * back > 0) & (F.abs(before - after) <= jump)
    return df.withColumn(name, F.when(F.coalesce(spike, F.lit(False)), (before + after) / 2).otherwise(F.col(value)))


def count_within(df: DataFrame, keys: list[str], value: str, half: float, name: str = "within") -> DataFrame:
    """How many rows of the key lie within half of each row's value."""
    by = ", ".join(f"`{k}`" for k in keys)
    return df.withColumn(name, F.expr(f"count(*) OVER (PARTITION BY {by} ORDER BY `{value}` RANGE BETWEEN {half!r}D PRECEDING AND {half!r}D FOLLOWING)"))


def kernel_smooth(df: DataFrame, keys: list[str], time: str, value: str, sigma: float, reach: float, least: int) -> DataFrame:
    """Gaussian-weighted mean of the rows within reach, where there are enough: keys, time, smooth, support."""
    from plinth.operators.ranges import band_join

    d = df.select(*keys, time, value)
    pairs = band_join(d, d, keys, time, reach)
    u = (F.col(time) - F.col(f"r_{time}")) / sigma
    k = F.exp(-0.5 * u * u)
    g = pairs.groupBy(*keys, time).agg(F.sum(k * F.col(f"r_{value}")).alias("__s"), F.sum(k).alias("__k"), F.count("*").alias("support"))
    return g.select(*keys, time, F.when(F.col("support") >= least, F.col("__s") / F.col("__k")).alias("smooth"), "support")


def dead_reckon(df: DataFrame, keys: list[str], time: str, speed: str, rate: str) -> DataFrame:
    """Planar pose by exact constant-twist steps, (0, 0, 0) at the first row; a step has the rates of the row before it."""
    w = _w(keys, [time])
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumns({"__dt": F.coalesce(F.col(time) - F.lag(time).over(w), F.lit(0.0)), "__v": F.coalesce(F.lag(speed).over(w), F.lit(0.0)), "__r": F.coalesce(F.lag(rate).over(w), F.lit(0.0))})
    d = d.withColumn("__a", F.col("__dt") * F.col("__r")).withColumn("yaw", F.sum("__a").over(run))
    half = F.col("__a") / 2
    chord = F.col("__v") * F.col("__dt") * F.when(F.abs(half) < 1e-9, 1.0).otherwise(F.sin(half) / F.when(F.abs(half) < 1e-9, 1.0).otherwise(half))
    mid = F.col("yaw") - half
    d = d.withColumn("__x", chord * F.cos(mid)).withColumn("__y", chord * F.sin(mid))
    return d.withColumns({"px": F.sum("__x").over(run), "py": F.sum("__y").over(run)}).drop("__dt", "__v", "__r", "__a", "__x", "__y")


def separable_window(cells: DataFrame, keys: list[str], value: str, rows: int, cols: int, how: str = "sum", name: str = "box") -> DataFrame:
    """Box sum, count or least value around occupied cells, over the columns and then the rows of a lattice.

    Rows between occupied ones count through an explode of the column pass to the rows that it can reach.
    """
    one = F.col(value) if how != "count" else F.lit(1)
    step = F.sum if how in ("sum", "count") else F.min
    spread = cells.select(*keys, "bx", "by", one.alias("__v")).withColumn("__d", F.explode(F.sequence(F.lit(-cols), F.lit(cols))))
    along = spread.groupBy(*keys, "bx", (F.col("by") + F.col("__d")).alias("by")).agg(step("__v").alias("__v"))
    up = along.withColumn("__d", F.explode(F.sequence(F.lit(-rows), F.lit(rows)))).groupBy(*keys, (F.col("bx") + F.col("__d")).alias("bx"), "by").agg(step("__v").alias(name))
    return cells.join(up, [*keys, "bx", "by"])


def filled_holes(cells: DataFrame, keys: list[str], value: str, reach: int, least: int) -> DataFrame:
    """keys, bx, by, filled, n: the empty cells of each key's occupied box with the median of the values within reach, where there are ``least`` of them."""
    from plinth.operators.binning import neighbours

    box = cells.groupBy(*keys).agg(F.min("bx").alias("__x0"), F.max("bx").alias("__x1"), F.min("by").alias("__y0"), F.max("by").alias("__y1"))
    every = box.select(*keys, F.explode(F.sequence("__x0", "__x1")).alias("bx"), "__y0", "__y1").select(*keys, "bx", F.explode(F.sequence("__y0", "__y1")).alias("by"))
    holes = every.join(cells, [*keys, "bx", "by"], "left_anti")
    near = neighbours(holes, cells.select(*keys, "bx", "by", F.col(value).alias("__v")), keys, reach)
    return near.groupBy(*keys, "bx", "by").agg(F.median("__v").alias("filled"), F.count("*").alias("n")).where(F.col("n") >= least)
