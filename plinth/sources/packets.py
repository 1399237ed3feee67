"""Binary frame files and packets: a Python data source, and decoders for fixed little-endian layouts.

A file is a run of frames: a header (frame number uint32, time double, exposure double, count uint32) and count rows of five
32-bit floats x, y, z, intensity, range. The source makes one partition per file and yields Arrow batches frame by frame,
so that a long file never stands in memory at once.
"""

from __future__ import annotations

import glob
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HEADER = struct.Struct("<IddI")
FIELDS = ("x", "y", "z", "intensity", "range")


def frames(read) -> Iterator[tuple[int, float, np.ndarray]]:
    """read(n): the next n bytes, fewer at the end. A frame that breaks off is an error."""
    while head := read(HEADER.size):
        if len(head) != HEADER.size:
            raise ValueError("a header breaks off")
        number, time, _, count = HEADER.unpack(head)
        body = read(count * 4 * len(FIELDS))
        if len(body) != count * 4 * len(FIELDS):
            raise ValueError(f"frame {number} breaks off")
        yield number, time, np.frombuffer(body, "<f4").reshape(count, len(FIELDS))


class FilePartition(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class FrameReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[FilePartition]:
        found = sorted(glob.glob(os.path.join(self.path, "*.bin"))) if os.path.isdir(self.path) else [self.path]
        return [FilePartition(p) for p in found]

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        with open(partition.path, "rb") as f:
            for number, time, rows in frames(f.read):
                n = len(rows)
                columns = [pa.array(np.full(n, number, np.int64)), pa.array(np.full(n, time)), pa.array(np.arange(1, n + 1))]
                columns += [pa.array(rows[:, i].astype(np.float64)) for i in range(len(FIELDS))]
                yield pa.RecordBatch.from_arrays(columns, names=["frame", "time", "point", *FIELDS])


class FrameSource(DataSource):
    """spark.dataSource.register(FrameSource); spark.read.format("frames").load(path). The path is one that every executor sees."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return "frame bigint, time double, point bigint, " + ", ".join(f"{f} double" for f in FIELDS)

    def reader(self, schema) -> FrameReader:
        return FrameReader(self.options["path"])


#: An inertial packet: three time counters in nanoseconds, acceleration and angular velocity. Fixed values of its layout.
IMU = np.dtype([("clock", "<u8"), ("acceleration_time", "<u8"), ("gyro_time", "<u8"), ("ax", "<f4"), ("ay", "<f4"), ("az", "<f4"), ("gx", "<f4"), ("gy", "<f4"), ("gz", "<f4")])


def decode(df: DataFrame, column: str, layout: np.dtype) -> DataFrame:
    """Binary packets of one layout as typed columns after the others; a packet of another size is an error."""
    others = [c for c in df.columns if c != column]
    kinds = {"u": ("bigint", np.int64), "i": ("bigint", np.int64), "f": ("double", np.float64)}
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes if c != column), *(f"{n} {kinds[layout[n].kind][0]}" for n in layout.names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(len(others)).to_pylist()
            if any(r is None or len(r) != layout.itemsize for r in raw):
                raise ValueError(f"packets must have {layout.itemsize} bytes")
            rows = np.frombuffer(b"".join(raw), layout)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], *(pa.array(rows[n].astype(kinds[layout[n].kind][1])) for n in layout.names)], names=[*others, *layout.names])

    return df.select(*others, F.col(column)).mapInArrow(run, schema)


def field_view(blob: bytes, count: int, step: int, offset: int, kind: str) -> np.ndarray:
    """One field of a strided point blob, as it lies, in the byte order that kind names."""
    return np.ndarray((count,), np.dtype(kind), blob, offset, (step,))


def blob_rows(df: DataFrame, keys: list[str], blob: str, count: str, step: int, fields: dict[str, tuple[int, str]]) -> DataFrame:
    """keys, point (from 1) and the fields (offset, byte order and kind) of strided point blobs, one row a point; a blob that is too short is an error."""
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "point bigint", *(f"`{f}` double" for f in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (n, raw) in enumerate(zip(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist())):
                if n and len(raw) < n * step:
                    raise ValueError(f"a blob of {len(raw)} bytes can't hold {n} points")
                views = [pa.array(field_view(raw, n, step, offset, kind).astype(np.float64)) for offset, kind in fields.values()]
                same = [pa.concat_arrays([batch.column(k).slice(i, 1)] * n) if n else batch.column(k).slice(0, 0) for k in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(1, n + 1)), *views], names=[*keys, "point", *fields])

    return df.select(*keys, F.col(count).cast("long"), blob).mapInArrow(run, schema)
