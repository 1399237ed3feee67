"""Bags written here byte by byte, read back by the source; broken ones are errors."""

import bz2
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from plinth.operators import ranges
from plinth.sources import bags, packets


def record(head, data):
    fields = b"".join(struct.pack("<I", len(k) + 1 + len(v)) + k.encode() + b"=" + v for k, v in head.items())
    return struct.pack("<I", len(fields)) + fields + struct.pack("<I", len(data)) + data


def cloud(stamp, points, big=False):
    order = ">" if big else "<"
    names = ("x", "y", "z", "intensity")
    fields = b"".join(struct.pack("<I", len(n)) + n.encode() + struct.pack("<IBI", 4 * i, 7, 1) for i, n in enumerate(names))
    body = np.array(points, order + "f4").tobytes()
    return struct.pack("<III", 0, *stamp) + struct.pack("<I", 5) + b"lidar" + struct.pack("<III", 1, len(points), 4) + fields + struct.pack("<BIII", big, 16, 16 * len(points), len(body)) + body + b"\x01"


def bag(path, chunks):
    out = bags.MAGIC + record({"op": b"\x03"}, b" " * 100)
    for i, messages in enumerate(chunks):
        inner = b""
        for topic, (sec, nsec), data in messages:
            conn = struct.pack("<I", 0 if topic == "/points" else 1)
            inner += record({"op": b"\x07", "conn": conn, "topic": topic.encode()}, record({"topic": topic.encode(), "type": b"kind"}, b"")[4:-4])
            inner += record({"op": b"\x02", "conn": conn, "time": struct.pack("<II", sec, nsec)}, data)
        packed = bz2.compress(inner) if i % 2 else inner
        out += record({"op": b"\x05", "compression": b"bz2" if i % 2 else b"none", "size": struct.pack("<I", len(inner))}, packed)
        out += record({"op": b"\x04"}, b"index")
    path.write_bytes(out)


def test_bag_round_trip(spark, tmp_path):
    path = tmp_path / "one.bag"
    clouds = [[(float(i), j / 2, -1.0, 0.25) for j in range(3)] for i in range(5)]
    bag(path, [[("/points", (i, 500), cloud((i, 7), c, big=i == 3)), ("/imu", (i, 1), b"abc")] for i, c in enumerate(clouds)])
    spark.dataSource.register(bags.BagSource)
    everything = spark.read.format("bag").option("chunks", "2").load(str(path))
    assert everything.count() == 10 and everything.rdd.getNumPartitions() == 3
    one = spark.read.format("bag").option("topic", "/points").load(str(path))
    assert {r.type for r in one.collect()} == {"kind"}
    turned = bags.points(one, [[0, -1, 0], [1, 0, 0], [0, 0, 1]]).orderBy("time_ns", "point").collect()
    assert [(r.x, r.y, r.z, r.intensity) for r in turned] == [(-y, x, z, s) for c in clouds for x, y, z, s in c]
    assert turned[0].time_ns == 500 and turned[-1].stamp_ns == 4_000_000_007 and [r.point for r in turned[:3]] == [1, 2, 3]
    (tmp_path / "bad.bag").write_bytes(b"#ROSBAG V1.2\n")
    with pytest.raises(Exception, match="not a bag"):
        spark.read.format("bag").load(str(tmp_path / "bad.bag")).count()
    with pytest.raises(ValueError):
        bags.unpacked({"compression": b"lz4"}, b"")


def test_blobs_that_are_too_short(spark):
    df = spark.createDataFrame([(1, 2, bytearray(b"\0" * 8)), (2, 0, bytearray())], "k long, n long, b binary")
    assert packets.blob_rows(df.where("k = 2"), ["k"], "b", "n", 8, {"v": (0, "<f4")}).count() == 0
    assert packets.blob_rows(df.where("k = 1"), ["k"], "b", "n", 4, {"v": (0, "<f4")}).count() == 2
    with pytest.raises(Exception, match="can't hold"):
        packets.blob_rows(df, ["k"], "b", "n", 8, {"v": (0, "<f4")}).count()


def test_scans_need_one_frame(spark):
    columns = list(range(20))
    scan = spark.createDataFrame([(1, c, 10 * c + c % 3, 1000) for c in columns], "scan long, c long, offset long, about long")
    frame = lambda f, shift, n=20: [(f, c, 1000 + shift + 10 * c + c % 3) for c in columns[:n]]
    run = lambda rows: ranges.scan_match(scan, spark.createDataFrame(rows, "frame long, c long, stamp long"), "scan", "frame", "c", 500).collect()
    assert [tuple(r) for r in run(frame(5, 7) + [(6, c, 1003 + 10 * c) for c in columns] + frame(7, 9, 15))] == [(1, 5, 1007, 20)]
    for rows in (frame(5, 7) + frame(6, 8), frame(5, 7, 15)):
        with pytest.raises(Exception, match="no single frame"):
            run(rows)


def test_subscripts(spark):
    one = spark.range(0, 8).select("id", *(c.alias(n) for c, n in zip(bags.frame_subscripts(2, 3, F.col("id")), "rc")))
    assert [(r.r, r.c) for r in one.orderBy("id").collect()] == [(None, None), (1, 1), (2, 1), (1, 2), (2, 2), (1, 3), (2, 3), (None, None)]
