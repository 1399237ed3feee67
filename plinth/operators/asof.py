"""As-of joins over keys and an ordered time column, by one union and one sorted window pass (no cartesian product).

Each side brings its rows with a marker; running last/first values carry the right row before and after each left row. Time
columns are numbers; the right side's payload is a struct. Ties have a stated rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bracket(left: DataFrame, right: DataFrame, keys: list[str], time: str, payload: list[str]) -> DataFrame:
    """Left rows with lo and hi: structs (time, payload) of the last right row at or before and the first at or after; null if none.

    Of right rows with equal time the greatest payload stands before and the least after.
    """
    held = F.struct(F.col(time).alias("t"), *(F.col(p) for p in payload))
    r = right.select(*keys, F.col(time).alias("__t"), F.lit(0).alias("__side"), held.alias("__r"))
    extra = [c for c in left.columns if c not in keys]
    l_rows = left.select(*keys, F.col(time).alias("__t"), F.lit(1).alias("__side"), F.struct(*extra).alias("__l"))
    both = r.withColumn("__l", F.lit(None).cast(l_rows.schema["__l"].dataType)).unionByName(l_rows.withColumn("__r", F.lit(None).cast(r.schema["__r"].dataType)))
    before = Window.partitionBy(*keys).orderBy("__t", "__side", "__r").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys).orderBy(F.col("__t"), F.col("__side").desc(), F.col("__r")).rowsBetween(0, Window.unboundedFollowing)
    out = both.withColumn("lo", F.last("__r", ignorenulls=True).over(before)).withColumn("hi", F.first("__r", ignorenulls=True).over(after))
    return out.where("__side = 1").select(*keys, "__l.*", "lo", "hi")


def backward(left: DataFrame, right: DataFrame, keys: list[str], time: str, payload: list[str], most_age: float | None = None) -> DataFrame:
    """The newest right row at or before each left row, as struct match; older than most_age is none."""
    out = bracket(left, right, keys, time, payload).drop("hi").withColumnRenamed("lo", "match")
    if most_age is not None:
        out = out.withColumn("match", F.when(F.col(time) - F.col("match.t") <= most_age, F.col("match")))
    return out


def forward(left: DataFrame, right: DataFrame, keys: list[str], time: str, payload: list[str]) -> DataFrame:
    """The first right row at or after each left row, as struct match."""
    return bracket(left, right, keys, time, payload).drop("lo").withColumnRenamed("hi", "match")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], time: str, payload: list[str], tie: str = "earlier") -> DataFrame:
    """The right row nearest in time, as struct match, and the signed distance dt (match - left). tie: earlier or later."""
    out = bracket(left, right, keys, time, payload)
    down, up = F.col(time) - F.col("lo.t"), F.col("hi.t") - F.col(time)
    earlier = F.col("hi").isNull() | (F.col("lo").isNotNull() & ((down <= up) if tie == "earlier" else (down < up)))
    return out.withColumn("match", F.when(earlier, F.col("lo")).otherwise(F.col("hi"))).withColumn("dt", F.col("match.t") - F.col(time)).drop("lo", "hi")


def interpolated(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str], widest: float, angles: tuple[str, ...] = ()) -> DataFrame:
    """Values between the bracketing rows, linear (angles along the shorter arc); ok where both exist and stand at most widest apart."""
    out = bracket(left, right, keys, time, values)
    width = F.col("hi.t") - F.col("lo.t")
    w = F.when(width > 0, (F.col(time) - F.col("lo.t")) / F.when(width > 0, width)).otherwise(0.0)
    out = out.withColumn("ok", F.coalesce(width <= widest, F.lit(False))).withColumn("w", w)
    for v in values:
        a, b = F.col(f"lo.{v}"), F.col(f"hi.{v}")
        out = out.withColumn(v, arc(a, b, F.col("w")) if v in angles else (1 - F.col("w")) * a + F.col("w") * b)
    return out.drop("lo", "hi")


def arc(a: Column, b: Column, w: Column) -> Column:
    d = F.atan2(F.sin(b - a), F.cos(b - a))
    return F.atan2(F.sin(a + w * d), F.cos(a + w * d))
