"""Overlapping batch schedules over an ordered list of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, order: str) -> DataFrame:
    """Adds row, from 0, in order over all rows: ranges are counted apart and shifted, so no task sees them all."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.repartitionByRange(parts, order).withColumn("__p", F.spark_partition_id())
    counts = dealt.groupBy("__p").agg(F.count("*").alias("__n"))  # a row for each part
    before = counts.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__b"))
    within = dealt.withColumn("__i", F.row_number().over(Window.partitionBy("__p").orderBy(order)) - 1)
    return within.join(F.broadcast(before), "__p").withColumn("row", F.col("__i") + F.col("__b")).drop("__p", "__i", "__b")


def schedule(frames: DataFrame, order: str, count: int, stride: int) -> DataFrame:
    """Each frame in every window of count frames that holds it: first_row and the frame. Windows start every stride rows; the last one ends with the last frame."""
    if stride > count:
        raise ValueError("a stride beyond the count would skip frames")
    n = frames.count()
    rows = numbered(frames, order)
    last = max(n - count, 0)
    start = F.floor(F.col("row") / stride) * stride
    starts = F.filter(F.transform(F.sequence(F.lit(0), F.lit(-(-count // stride))), lambda k: F.least(start - k * stride, F.lit(last))), lambda b: (b >= 0) & (b <= F.col("row")) & (b + count > F.col("row")))
    tail = F.when(F.col("row") >= last, F.array(F.lit(last).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return rows.withColumn("first_row", F.explode(F.array_distinct(F.concat(starts, tail)))).drop("row")
