"""Interval and band joins by bucket equi-keys, sweep lines, interval merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def band_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, half: float, right_prefix: str = "r_") -> DataFrame:
    """Pairs whose times differ by at most half: the left side probes three buckets of that width, the exact test follows."""
    probes = left.withColumn("__b", F.explode(F.array(*(F.floor(F.col(time) / half).cast("long") + i for i in (-1, 0, 1)))))
    other = right.select(*keys, *(F.col(c).alias(right_prefix + c) for c in right.columns if c not in keys), F.floor(F.col(time) / half).cast("long").alias("__b"))
    return probes.join(other, [*keys, "__b"]).where(F.abs(F.col(time) - F.col(right_prefix + time)) <= half).drop("__b")


def interval_join(points: DataFrame, spans: DataFrame, keys: list[str], time: str, begin: str, end: str, bucket: float) -> DataFrame:
    """Points with the spans [begin, end] that hold them.

    A span is entered in the buckets that it touches on a level where these are few: level l has buckets of bucket * 4^l, and
    a span lies on the first level whose buckets are a quarter of its length or wider, so that it touches six at most, however
    long. Points probe every level that spans have.
    """
    length = F.greatest((F.col(end) - F.col(begin)) / (4 * bucket), F.lit(1.0))
    level = F.ceil(F.log(4.0, length) - 1e-9).cast("int")
    leveled = spans.withColumn("__l", level)
    highest = leveled.agg(F.max("__l").alias("m")).first()["m"] or 0
    wide = F.lit(float(bucket)) * F.pow(F.lit(4.0), F.col("__l"))
    place = lambda t: F.floor(F.col(t) / wide).cast("long")
    entered = leveled.withColumn("__b", F.explode(F.sequence(place(begin), place(end))))
    p = points.withColumn("__l", F.explode(F.sequence(F.lit(0), F.lit(int(highest))))).withColumn("__b", place(time))
    inside = [p[k] == entered[k] for k in keys] + [p["__l"] == entered["__l"], p["__b"] == entered["__b"], p[time] >= entered[begin], p[time] <= entered[end]]
    payload = [c for c in spans.columns if c not in keys]
    return p.join(entered, inside).select(*(p[c] for c in points.columns), *(entered[c] for c in payload))


def merge_intervals(spans: DataFrame, keys: list[str], begin: str, end: str, reach: float = 0.0) -> DataFrame:
    """Unions of overlapping intervals (or with gaps of at most reach), and how many each holds."""
    w = Window.partitionBy(*keys).orderBy(begin, end)
    so_far = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("__new", F.when(so_far.isNull() | (F.col(begin) > so_far + reach), 1).otherwise(0))
    grouped = marked.withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "island").agg(F.min(begin).alias(begin), F.max(end).alias(end), F.count("*").alias("n"))


def sweep(spans: DataFrame, keys: list[str], begin: str, end: str) -> DataFrame:
    """Elementary segments of a set of intervals with the number that covers each: keys, begin, end, cover."""
    events = spans.select(*keys, F.col(begin).alias("at"), F.lit(1).alias("step")).unionByName(spans.select(*keys, F.col(end).alias("at"), F.lit(-1).alias("step")))
    net = events.groupBy(*keys, "at").agg(F.sum("step").alias("step"))
    w = Window.partitionBy(*keys).orderBy("at")
    out = net.select(*keys, F.col("at").alias("begin"), F.lead("at").over(w).alias("end"), F.sum("step").over(w).alias("cover"))
    return out.where(F.col("end").isNotNull() & (F.col("cover") > 0))


def scan_match(scans: DataFrame, packets: DataFrame, scan: str, frame: str, column: str, reach: int, least: int = 16) -> DataFrame:
    """scan, frame, start, columns: the packet frame whose column stamps less the scan's column times (offset) are one exact start, over ``least`` columns or more.

    A scan's header (about) says within ``reach`` when it began, which keeps the join to packets of that time. A scan with
    no such frame, or with several, is an error.
    """
    expected = scans.withColumn("__e", F.col("about") + F.col("offset"))
    probes = expected.withColumn("__b", F.explode(F.array(*(F.floor(F.col("__e") / reach) + i for i in (-1, 0, 1)))))
    p = packets.select(F.col(frame), F.col(column), "stamp", F.floor(F.col("stamp") / reach).alias("__b"))
    starts = probes.join(p, [column, "__b"]).where(F.abs(F.col("stamp") - F.col("__e")) <= reach).select(scan, frame, (F.col("stamp") - F.col("offset")).alias("start"))
    exact = starts.groupBy(scan, frame).agg(F.count("*").alias("columns"), F.min("start").alias("start"), F.max("start").alias("__l")).where((F.col("columns") >= least) & (F.col("start") == F.col("__l")))
    found = exact.groupBy(scan).agg(F.count("*").alias("__n"), F.min(F.struct(frame, "start", "columns")).alias("__f"))
    every = scans.select(scan).distinct().join(found, scan, "left")
    sure = F.when(F.col("__n") == 1, F.col("__f")).otherwise(F.raise_error(F.concat(F.lit("no single frame for scan "), F.col(scan).cast("string"))))
    return every.withColumn("__f", sure).select(scan, f"__f.{frame}", "__f.start", "__f.columns")
