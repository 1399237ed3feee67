"""Structured Streaming twins: windowed aggregates with watermarks, keyed state, exactly-once file sinks.

Replays read Parquet as a stream and stop when all of it is processed (availableNow), so they can stand in for batch queries.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plinth.operators.graph import shared_dir
from plinth.operators.stateful import LowPass


def source(spark: SparkSession, path: str) -> DataFrame:
    """The files under path (or the one that it names) as a stream."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    files = spark.read.parquet(path).inputFiles()
    if len(files) == 1 and files[0].rstrip("/").endswith(name):
        return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return spark.readStream.schema(schema).parquet(path)


def run_to_end(df: DataFrame, mode: str = "append") -> DataFrame:
    """Runs the stream over all that is there, into a table in the shared folder, and reads it."""
    out = f"{shared_dir(df.sparkSession)}/stream-{uuid.uuid4().hex}"
    started = df.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").outputMode(mode).trigger(availableNow=True).start()
    started.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{out}/data")


def tumbling(spark: SparkSession, path: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per type and window. Each micro-batch writes the windows that it changed, the newest of a window counts; state beyond the watermark goes."""
    events = source(spark, path).select(F.expr("cast(ts as timestamp)").alias("ts"), "event_type", "value")
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        # a batch that is run again after a failure replaces its own rows only
        batch.write.mode("overwrite").parquet(f"{out}/data/batch={number}")

    q = counted.writeStream.outputMode("update").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    newest = spark.read.parquet(f"{out}/data").groupBy("window", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("r"))
    us = F.expr("timestampdiff(MICROSECOND, timestamp'2024-01-01 00:00:00', window.start)")
    return newest.select("event_type", F.floor(us / 3600000000).alias("hour"), "r.n", "r.total")


class LowPassProcessor(StatefulProcessor):
    """The low-pass fold as keyed streaming state; rows that are older than their key's last one are dropped."""

    def __init__(self, tau: float) -> None:
        self.tau = tau

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("low_pass", "time double, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fold = LowPass(self.tau)
        if self.state.exists():
            fold.time, fold.value = self.state.get()
        out = []
        for r in pd.concat(list(rows)).sort_values(["t", "event_id"]).itertuples(index=False):
            if fold.time is None or r.t >= fold.time:
                out.append((key[0], r.event_id, *fold.step(r.t, r.value)))
        if fold.time is not None:
            self.state.update((fold.time, fold.value))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "filtered", "rate"])

    def close(self) -> None:
        pass


def streaming_low_pass(events: DataFrame, tau: float) -> DataFrame:
    """events: a stream of user_id, event_id, t, value."""
    return events.groupBy("user_id").transformWithStateInPandas(LowPassProcessor(tau), "user_id long, event_id long, filtered double, rate double", "Append", "None")
