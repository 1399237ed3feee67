"""Gaps and islands over ordered rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gap_islands(df: DataFrame, keys: list[str], order: str, gap: float, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds island: a new one begins where the step in order exceeds gap."""
    w = Window.partitionBy(*keys).orderBy(order, *ties)
    new = F.when(F.col(order) - F.lag(order).over(w) > gap, 1).otherwise(0)
    return df.withColumn("__new", new).withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def continuous_support(df: DataFrame, keys: list[str], order: str, gap: float, least_rows: int, least_span: float) -> DataFrame:
    """Rows of the islands that have enough rows and span."""
    marked = gap_islands(df, keys, order, gap)
    by = Window.partitionBy(*keys, "island")
    kept = marked.withColumn("__n", F.count("*").over(by)).withColumn("__s", F.max(order).over(by) - F.min(order).over(by))
    return kept.where((F.col("__n") >= least_rows) & (F.col("__s") >= least_span)).drop("__n", "__s")


def runs(df: DataFrame, keys: list[str], order: list[str], label: Column) -> DataFrame:
    """Runs of equal labels: keys, run, label, first and last value of the first order column, rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("label", label)
    marked = marked.withColumn("__new", F.when(F.col("label").eqNullSafe(F.lag("label").over(w)) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1))
    marked = marked.withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "run", "label").agg(F.min(order[0]).alias("begin"), F.max(order[0]).alias("end"), F.count("*").alias("n"))


def true_runs(df: DataFrame, keys: list[str], order: list[str], condition: Column, least: float, join_gap: float, pad: float) -> DataFrame:
    """Spans of true runs: joined over short gaps, long enough, padded: keys, begin, end, n."""
    from plinth.operators.ranges import merge_intervals

    found = runs(df, keys, order, condition).where("label").select(*keys, "begin", "end")
    joined = merge_intervals(found, keys, "begin", "end", join_gap)
    return joined.where(F.col("end") - F.col("begin") >= least).select(*keys, (F.col("begin") - pad).alias("begin"), (F.col("end") + pad).alias("end"), "n")


def validity_sessions(df: DataFrame, keys: list[str], order: list[str], valid: Column) -> DataFrame:
    """Adds session: the running count of rising edges of valid, 0 where it isn't."""
    w = Window.partitionBy(*keys).orderBy(*order)
    v = df.withColumn("__v", F.coalesce(valid, F.lit(False)))
    rise = F.when(F.col("__v") & ~F.coalesce(F.lag("__v").over(w), F.lit(False)), 1).otherwise(0)
    v = v.withColumn("__r", rise).withColumn("__s", F.sum("__r").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return v.withColumn("session", F.when(F.col("__v"), F.col("__s")).otherwise(0)).drop("__v", "__r", "__s")


def compressed_ranges(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Integer sets as text: 1-3,7,9-12."""
    w = Window.partitionBy(*keys).orderBy(number)
    d = df.select(*keys, number).distinct().withColumn("__g", F.col(number) - F.row_number().over(w))
    r = d.groupBy(*keys, "__g").agg(F.min(number).alias("a"), F.max(number).alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")))
    listed = r.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("a").alias("a"), text.alias("t")))).alias("__l"))
    return listed.select(*keys, F.array_join(F.col("__l.t"), ",").alias("ranges"))
