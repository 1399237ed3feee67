"""Queries of the sources and sinks: what is written in a format and read back equals the table."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from plinth.operators.graph import shared_dir
from plinth.plans.catalog import PTS, points, query, rnd, table
from plinth.sources import bags, frames, packets


def folder(spark) -> str:
    return f"{shared_dir(spark)}/source-{uuid.uuid4().hex}"


@query("csv_scan", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders")
def csv_scan(spark, sf):
    path = folder(spark)
    frames.write_csv(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"), path)
    return frames.read_csv(spark, path, "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderstatus string", ["o_orderkey", "o_totalprice"])


@query("pose_scan", "SELECT o_orderkey AS frame_index, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 2 ELSE o_totalprice END AS x FROM orders WHERE o_orderkey % 2 = 0")
def pose_scan(spark, sf):
    """Canonical pose columns before legacy ones, for the requested frames."""
    path, o = folder(spark), table(spark, sf, "orders")
    frames.write_csv(o.select(F.col("o_orderkey").alias("frame_index"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("pose_x"), (F.col("o_totalprice") / 2).alias("odom_x")), path)
    wanted = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("frame_index"))
    return frames.read_poses(spark, path, wanted, "frame_index bigint, pose_x double, odom_x double")


@query("nested_flatten", 'SELECT c_custkey AS "id", c_acctbal AS "pose.balance", c_nationkey AS "pose.nation.key" FROM customer')
def nested_flatten(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.struct(F.col("c_acctbal").alias("balance"), F.struct(F.col("c_nationkey").alias("key")).alias("nation")).alias("pose"))
    return frames.flattened(c)


def packed(df, layout: np.dtype, columns: dict[str, str], keep: list[str]):
    """Rows as binary packets of a layout."""
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.zeros(batch.num_rows, layout)
            for field, column in columns.items():
                rows[field] = batch.column(batch.schema.get_field_index(column)).to_numpy(zero_copy_only=False)
            raw = rows.tobytes()
            size = layout.itemsize
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)) for k in keep), pa.array([raw[i * size : (i + 1) * size] for i in range(len(rows))], pa.binary())], names=[*keep, "packet"])

    return df.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "packet binary"]))


COLUMN = np.dtype([("stamp", "<u8"), ("measurement", "<u2"), ("frame", "<u2"), ("range", "<u4")])


@query("packet_decode", f"{PTS} SELECT ok AS stamp, ln::BIGINT AS measurement, frame % 60000 AS frame, CAST(x AS BIGINT) AS range FROM pts")
def packet_decode(spark, sf):
    p = points(spark, sf).select(F.col("ok").cast("long"), F.col("ln").cast("long"), (F.col("frame") % 60000).cast("long").alias("frame"), F.col("x").cast("long").alias("r"))
    return packets.decode(packed(p, COLUMN, {"stamp": "ok", "measurement": "ln", "frame": "frame", "range": "r"}, []), "packet", COLUMN)


@query("imu_packets", "SELECT event_id, user_id AS clock, round(value::FLOAT::DOUBLE, 5) AS ax, round((value / 2)::FLOAT::DOUBLE, 5) AS gz FROM events")
def imu_packets(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").cast("long"), F.col("user_id").cast("long"), "value", (F.col("value") / 2).alias("half"))
    d = packets.decode(packed(e, packets.IMU, {"clock": "user_id", "ax": "value", "gz": "half"}, ["event_id"]), "packet", packets.IMU)
    return d.select("event_id", "clock", rnd("ax", 5).alias("ax"), rnd("gz", 5).alias("gz"))


@query("point_blobs", f"{PTS} SELECT frame, round(x::FLOAT::DOUBLE, 4) AS x, round(y::FLOAT::DOUBLE, 4) AS y, round(z::FLOAT::DOUBLE, 6) AS z FROM pts")
def point_blobs(spark, sf):
    """Frames as strided big-endian point blobs, and their fields as rows again."""
    layout = np.dtype([("x", ">f4"), ("skip", "V4"), ("y", ">f4"), ("z", ">f4")])

    def blob(g):
        rows = np.zeros(len(g), layout)
        for c in "xyz":
            rows[c] = g[c].to_numpy()
        import pandas as pd

        return pd.DataFrame([(g["frame"].iloc[0], len(g), rows.tobytes())], columns=["frame", "points", "data"])

    blobs = points(spark, sf).select("frame", "x", "y", "z").groupBy("frame").applyInPandas(blob, "frame long, points long, data binary")
    v = packets.blob_rows(blobs, ["frame"], "data", "points", layout.itemsize, {"x": (0, ">f4"), "y": (8, ">f4"), "z": (12, ">f4")})
    return v.select("frame", rnd("x", 4).alias("x"), rnd("y", 4).alias("y"), rnd("z", 6).alias("z"))


@query("text_fields", "SELECT s_suppkey::DOUBLE AS a, s_nationkey::DOUBLE AS b, s_acctbal AS c FROM supplier")
def text_fields(spark, sf):
    """White-space separated numbers, as navigation packets have them."""
    path = folder(spark)
    table(spark, sf, "supplier").select(F.concat_ws("  ", "s_suppkey", "s_nationkey", "s_acctbal").alias("value")).write.text(path)
    return frames.read_text_fields(spark, path, ["a", "b", "c"]).drop("file")


@query("json_list_scan", "SELECT c_custkey AS utime, c_acctbal AS linear FROM customer")
def json_list_scan(spark, sf):
    """Files of one JSON list each, of at most 10,000 records where keys are spread; a dealt-out partition may hold several lists, so each row is told to be its own file."""
    path = folder(spark)
    key = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(key.alias("utime"), F.col("c_acctbal").alias("linear"), (key % 7).alias("part"), F.floor(key / 70_000).alias("block"))
    rows.groupBy("part", "block").agg(F.to_json(F.collect_list(F.struct("utime", "linear"))).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    return frames.read_json_lists(spark, path, "utime bigint, linear double")


@query("versioned_sink", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def versioned_sink(spark, sf):
    """A table that is published twice has one version, named by its rows."""
    root, n = folder(spark), table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    path = frames.publish(n, root, ["n_nationkey", "n_name", "n_regionkey"])
    if frames.publish(n, root, ["n_nationkey", "n_name", "n_regionkey"]) != path:
        raise ValueError("the same rows have two versions")
    return spark.read.parquet(path)


@query("partitioned_frames", f"{PTS} SELECT frame, x, y, z FROM pts WHERE frame % 10 = 3")
def partitioned_frames(spark, sf):
    """Frames of a table partitioned by drive and frame; only the wanted ones' files are read."""
    path = folder(spark)
    p = points(spark, sf).select(F.lit("d").alias("drive"), "frame", "x", "y", "z")
    frames.write_frames(p.repartition("frame"), path)
    return spark.read.parquet(path).where("drive = 'd' AND frame % 10 = 3").select(F.col("frame").cast("long"), "x", "y", "z")


@query("gnss_rows", "SELECT o_orderkey / 1e9 AS bag_time_sec, o_orderkey + (o_custkey % 1000) * 1e-9 AS stamp_sec, CAST(2300 + o_orderkey % 9 AS INT) AS gps_week, o_totalprice / 1000 AS gps_seconds, CAST(o_orderkey % 3 AS INT) AS solution_status, CAST(o_orderkey % 5 AS INT) AS position_type, 45.0::DOUBLE AS latitude_deg, -93.0::DOUBLE AS longitude_deg, o_totalprice AS ellipsoid_height_m, 30.5::DOUBLE AS undulation_m, 0.1::DOUBLE AS latitude_stdev_m, 0.2::DOUBLE AS longitude_stdev_m, 0.3::DOUBLE AS height_stdev_m, 1.0::DOUBLE AS diff_age_sec, CAST(7 AS INT) AS num_satellites, o_totalprice - 30.5 AS orthometric_height_m FROM orders")
def gnss_rows(spark, sf):
    """Typed rows of nested position messages."""
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    s = lambda **c: F.struct(*((v if hasattr(v, "alias") else F.lit(v)).alias(n) for n, v in c.items()))
    message = s(
        header=s(stamp=s(sec=key, nanosec=F.col("o_custkey") % 1000)), nov_header=s(gps_week_number=2300 + key % 9, gps_week_milliseconds=price), sol_status=s(status=(key % 3).cast("int")), pos_type=s(type=(key % 5).cast("int")),
        lat=45.0, lon=-93.0, hgt=price, undulation=30.5, lat_stdev=0.1, lon_stdev=0.2, hgt_stdev=0.3, diff_age=1.0, num_svs=7,
    )
    return bags.navigation_rows(table(spark, sf, "orders").select(key.alias("time_ns"), message.alias("message")), "bestpos")


@query("source_variable", "WITH l AS (SELECT p_size, p_name, p_partkey, CASE WHEN lower(p_name) = 'green' THEN 0 WHEN contains(lower(p_name), 'green') THEN 1 ELSE 2 END AS r FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY r, p_partkey, p_name) AS i FROM l) SELECT p_size, p_name AS variable FROM k WHERE i = 1")
def source_variable(spark, sf):
    return bags.source_variable(table(spark, sf, "part"), ["p_size"], "p_name", "p_partkey", "green")


@query("frame_subscripts", "SELECT o_orderkey, CASE WHEN o_orderkey BETWEEN 1 AND 7000 THEN (o_orderkey - 1) % 70 + 1 ELSE 0 END AS r, CASE WHEN o_orderkey BETWEEN 1 AND 7000 THEN (o_orderkey - 1) // 70 + 1 ELSE 0 END AS c FROM orders")
def frame_subscripts(spark, sf):
    r, c = bags.frame_subscripts(70, 100, F.col("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey", F.coalesce(r, F.lit(0)).alias("r"), F.coalesce(c, F.lit(0)).alias("c"))
