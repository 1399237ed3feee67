"""Bag files of recorded topics (format version 2.0): a Python data source, point cloud messages, and typed rows of navigation messages.

A bag is a run of records with a header of named fields and data; chunks hold the messages. The source makes a partition of
every ``chunks`` chunks, found by skipping from record to record, so a long bag is read in parallel and never stands in
memory. Chunks may be plain or packed by bz2; another packing is an error.
"""

from __future__ import annotations

import bz2
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed values of the format: its first line, and the op codes of messages, chunks and connections.
MAGIC, MESSAGE, CHUNK, CONNECTION = b"#ROSBAG V2.0\n", 2, 5, 7


def header_fields(raw: bytes) -> dict[str, bytes]:
    out, at = {}, 0
    while at < len(raw):
        size = struct.unpack_from("<I", raw, at)[0]
        name, _, value = raw[at + 4 : at + 4 + size].partition(b"=")
        out[name.decode()] = value
        at += 4 + size
    return out


def records(raw: bytes) -> Iterator[tuple[dict[str, bytes], bytes]]:
    """Header and data of the records in a block."""
    at = 0
    while at < len(raw):
        size = struct.unpack_from("<I", raw, at)[0]
        head = header_fields(raw[at + 4 : at + 4 + size])
        at += 4 + size
        size = struct.unpack_from("<I", raw, at)[0]
        yield head, raw[at + 4 : at + 4 + size]
        at += 4 + size


def scan(f) -> Iterator[tuple[dict[str, bytes], int, int]]:
    """Header, and place and size of the data, of the records of an open bag; the data is skipped."""
    if f.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a bag of version 2.0")
    while head := f.read(4):
        fields = header_fields(f.read(struct.unpack("<I", head)[0]))
        size = struct.unpack("<I", f.read(4))[0]
        yield fields, f.tell(), size
        f.seek(size, 1)


def unpacked(head: dict[str, bytes], data: bytes) -> bytes:
    kind = head.get("compression", b"none")
    if kind == b"none":
        return data
    if kind == b"bz2":
        return bz2.decompress(data)
    raise ValueError(f"unknown packing {kind.decode()}")


class ChunkPartition(InputPartition):
    def __init__(self, path: str, places: list[tuple[int, int, dict]], topics: dict[bytes, tuple[str, str]]) -> None:
        self.path, self.places, self.topics = path, places, topics


class BagReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.topic, self.chunks = options["path"], options.get("topic"), int(options.get("chunks", "50"))

    def partitions(self) -> list[ChunkPartition]:
        topics, places = {}, []
        with open(self.path, "rb") as f:
            for head, at, size in scan(f):
                if head.get("op") == bytes([CHUNK]):
                    places.append((at, size, head))
                elif head.get("op") == bytes([CONNECTION]):
                    back = f.tell()
                    f.seek(at)
                    topics[head["conn"]] = (head["topic"].decode(), header_fields(f.read(size)).get("type", b"").decode())
                    f.seek(back)
        return [ChunkPartition(self.path, places[i : i + self.chunks], topics) for i in range(0, len(places), self.chunks)]

    def read(self, part: ChunkPartition) -> Iterator[pa.RecordBatch]:
        topics = dict(part.topics)
        with open(part.path, "rb") as f:
            for at, size, head in part.places:
                f.seek(at)
                rows = []
                for inner, data in records(unpacked(head, f.read(size))):
                    if inner["op"] == bytes([CONNECTION]):
                        topics[inner["conn"]] = (inner["topic"].decode(), header_fields(data).get("type", b"").decode())
                    elif inner["op"] == bytes([MESSAGE]):
                        topic, kind = topics[inner["conn"]]
                        if self.topic in (None, topic):
                            sec, nsec = struct.unpack("<II", inner["time"])
                            rows.append((topic, kind, sec * 1_000_000_000 + nsec, data))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.binary()))], names=["topic", "type", "time_ns", "data"])


class BagSource(DataSource):
    """spark.dataSource.register(BagSource); spark.read.format("bag").option("topic", ...).load(path). The path is one that every executor sees."""

    @classmethod
    def name(cls) -> str:
        return "bag"

    def schema(self) -> str:
        return "topic string, type string, time_ns bigint, data binary"

    def reader(self, schema) -> BagReader:
        return BagReader(self.options)


#: Number kinds of point fields, fixed values of the message.
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 8: "f8"}


def point_cloud(data: bytes) -> tuple[int, dict[str, np.ndarray]]:
    """Stamp in nanoseconds and the fields of a point cloud message, each a strided view in the message's byte order."""
    at = 0

    def take(layout: str):
        nonlocal at
        found = struct.unpack_from("<" + layout, data, at)
        at += struct.calcsize("<" + layout)
        return found

    def text() -> str:
        nonlocal at
        (size,) = take("I")
        at += size
        return data[at - size : at].decode()

    _, sec, nsec = take("III")
    text()
    height, width, number = take("III")
    fields = []
    for _ in range(number):
        name = text()
        fields.append((name, *take("IBI")))
    big, step, _, size = take("BIII")
    body = data[at : at + size]
    order = ">" if big else "<"
    return sec * 1_000_000_000 + nsec, {name: np.ndarray((height * width,), order + NUMBERS[kind], body, offset, (step,)) for name, offset, kind, _ in fields}


def points(messages: DataFrame, rotation: list[list[float]]) -> DataFrame:
    """One row a point of the cloud messages: time_ns, stamp_ns, point (from 1), x, y, z in the vehicle's axes, intensity (null where the cloud has none)."""
    turn = np.array(rotation)
    schema = "time_ns bigint, stamp_ns bigint, point bigint, x double, y double, z double, intensity double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for time, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                stamp, fields = point_cloud(data)
                p = np.stack([fields[a].astype(np.float64) for a in "xyz"], axis=1) @ turn.T
                n = len(p)
                shine = pa.array(fields["intensity"].astype(np.float64)) if "intensity" in fields else pa.nulls(n, pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, time)), pa.array(np.full(n, stamp)), pa.array(np.arange(1, n + 1)), *(pa.array(p[:, i]) for i in range(3)), shine], names=["time_ns", "stamp_ns", "point", "x", "y", "z", "intensity"])

    return messages.select("time_ns", "data").mapInArrow(run, schema)


#: Columns of navigation rows by message kind: names as in the reference tables, and where a message has them.
NAVIGATION = {
    "bestpos": {"solution_status": "sol_status.status", "position_type": "pos_type.type", "latitude_deg": "lat", "longitude_deg": "lon", "ellipsoid_height_m": "hgt", "undulation_m": "undulation", "latitude_stdev_m": "lat_stdev", "longitude_stdev_m": "lon_stdev", "height_stdev_m": "hgt_stdev", "diff_age_sec": "diff_age", "num_satellites": "num_svs"},
    "bestvel": {"solution_status": "sol_status.status", "velocity_type": "vel_type.type", "latency_sec": "latency", "horizontal_speed_mps": "hor_speed", "track_ground_deg": "trk_gnd", "vertical_speed_mps": "ver_speed"},
    "inspva": {"latitude_deg": "latitude", "longitude_deg": "longitude", "height_m": "height", "north_velocity_mps": "north_velocity", "east_velocity_mps": "east_velocity", "up_velocity_mps": "up_velocity", "roll_deg": "roll", "pitch_deg": "pitch", "azimuth_deg": "azimuth"},
    "odom": {"x_m": "pose.pose.position.x", "y_m": "pose.pose.position.y", "z_m": "pose.pose.position.z", "qx": "pose.pose.orientation.x", "qy": "pose.pose.orientation.y", "qz": "pose.pose.orientation.z", "qw": "pose.pose.orientation.w"},
    "lidar": {},
}


def stamp_seconds(sec: Column, nanosec: Column) -> Column:
    return sec.cast("double") + nanosec * 1e-9


def navigation_rows(messages: DataFrame, kind: str, time: str = "time_ns", message: str = "message") -> DataFrame:
    """Typed rows of one kind of message (a struct): bag time, header stamp, GPS week and seconds where there is a receiver header, and the kind's own columns."""
    inner = {f.name for f in messages.schema[message].dataType.fields}
    m = lambda path: F.col(f"{message}.{path}")
    out = [(F.col(time) / 1e9).alias("bag_time_sec"), stamp_seconds(m("header.stamp.sec"), m("header.stamp.nanosec")).alias("stamp_sec")]
    if "nov_header" in inner:
        out += [m("nov_header.gps_week_number").cast("int").alias("gps_week"), (m("nov_header.gps_week_milliseconds") / 1000).alias("gps_seconds")]
    columns = [m(path).alias(name) for name, path in NAVIGATION[kind].items()]
    if kind == "bestpos":
        columns.append((m("hgt") - m("undulation")).alias("orthometric_height_m"))
    return messages.select(*out, *columns)


def source_variable(listing: DataFrame, keys: list[str], name: str, order: str, wanted: str) -> DataFrame:
    """Of each file's variables the one to read: named as wanted (case aside), else the first whose name holds it, else the first."""
    low = F.lower(name)
    rank = F.when(low == wanted.lower(), 0).when(F.contains(low, F.lit(wanted.lower())), 1).otherwise(2)
    return listing.groupBy(*keys).agg(F.min_by(name, F.struct(rank, order, name)).alias("variable"))


def frame_subscripts(rows: int, columns: int, index: Column) -> tuple[Column, Column]:
    """Row and column (from 1) of a frame's linear number in a frame array that is a row, a column or a table, in column order; null beyond it."""
    inside = index.between(1, rows * columns)
    return F.when(inside, (index - 1) % rows + 1), F.when(inside, F.floor((index - 1) / rows) + 1)
