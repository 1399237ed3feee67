"""All queries of the engine's own operators, and their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: Added before rounding on both sides, so that exact ties don't hang on the last bit.
TIE = 1e-9


def rnd(c: Column | str, digits: int) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) + TIE, digits)


def _sql(text: str) -> str:
    """The SQL with the column by quoted and the same rounding as rnd."""
    text, out, at = re.sub(r"(?<!\")\bby\b", '"by"', text), "", 0
    for m in re.finditer(r"\bround\(", text):
        if m.start() < at:
            continue
        depth, comma, i = 1, 0, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(text[i], 0)
            comma = i if text[i] == "," and depth == 1 else comma
            i += 1
        out += f"{text[at : m.start()]}round(({_sql(text[m.end() : comma])}) + {TIE}, {text[comma + 1 : i - 1].strip()})"
        at = i
    return out + text[at:]


def query(name: str, sql: str | None = None):
    """Registers a (spark, sf_dir) query and, where SQL can state it, its twin."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = _sql(sql)
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point returns: lineitem as frame, class, x, y, z and intensity."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"), F.col("l_suppkey").alias("frame"), F.col("l_returnflag").alias("cls"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), F.col("l_discount").alias("z"), F.col("l_tax").alias("inten"))


PTS = "WITH pts AS (SELECT l_orderkey AS ok, l_linenumber AS ln, l_suppkey AS frame, l_returnflag AS cls, l_quantity AS x, l_extendedprice / 1000 AS y, l_discount AS z, l_tax AS inten FROM lineitem)"


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensor streams: events as key, topic, value and time in seconds (double) and microseconds (long)."""
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", us.alias("us"), (us / 1e6).alias("t"))


EV = "WITH ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00') AS us, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6 AS t FROM events)"


from plinth.plans import composed, curbs, detectors, evaluation, geometry, lattice, logic, navigation, sequences, sources, space, structures, timing  # noqa: E402, F401
