"""Frame tables, validated CSV and JSON scans, nested flattening, and the versioned sink."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_frames(points: DataFrame, path: str) -> None:
    """Partitioned by drive and frame, so that a single frame reads its own files only."""
    points.write.partitionBy("drive", "frame").mode("overwrite").parquet(path)


def read_frame(spark: SparkSession, path: str, drive: str, frame: int) -> DataFrame:
    return spark.read.parquet(path).where((F.col("drive") == drive) & (F.col("frame") == frame))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, required: list[str]) -> DataFrame:
    """CSV with a header and a fixed schema; missing required columns are an error before any row is read."""
    header = spark.read.option("header", True).csv(path).columns
    missing = [c for c in required if c not in header]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header, doubles in full."""
    df.write.option("header", True).csv(path)


def read_poses(spark: SparkSession, path: str, frames: DataFrame, schema: str) -> DataFrame:
    """Poses of the requested frames: canonical pose_* columns win over legacy odom_* ones. Repeated and missing frames are errors."""
    poses = read_csv(spark, path, schema, ["frame_index"])
    if poses.groupBy("frame_index").count().where("count > 1").limit(1).count():
        raise ValueError("repeated frames")
    if frames.join(poses, "frame_index", "left_anti").limit(1).count():
        raise ValueError("missing frames")
    names = sorted({c.split("_", 1)[1] for c in poses.columns if c.startswith(("pose_", "odom_"))})
    pick = [F.coalesce(*(F.col(f"{p}_{n}") for p in ("pose", "odom") if f"{p}_{n}" in poses.columns)).alias(n) for n in names]
    return frames.join(poses, "frame_index").select("frame_index", *pick)


def flattened(df: DataFrame) -> DataFrame:
    """Nested structs as columns with dotted names."""

    def walk(kind: T.DataType, path: list[str]):
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                yield from walk(f.dataType, [*path, f.name])
        else:
            yield path

    return df.select(*(F.col(".".join(f"`{p}`" for p in path)).alias(".".join(path)) for path in walk(df.schema, [])))


def read_json_lists(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Files that hold one JSON list of records each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_text_fields(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """White-space separated numbers, one row per line, with the file's name."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(F.input_file_name().alias("file"), parts.alias("p"))
    return rows.select("file", *(F.col("p")[i].cast("double").alias(n) for i, n in enumerate(names)))


def parse_nanos(c: Column) -> Column:
    """'yyyy-MM-dd HH:mm:ss.nnnnnnnnn' as nanoseconds since 1970, which timestamps would cut to microseconds."""
    seconds = F.unix_timestamp(F.substring_index(c, ".", 1))
    return seconds * 1_000_000_000 + F.rpad(F.substring_index(c, ".", -1), 9, "0").cast("long")


def publish(df: DataFrame, root: str, digest_columns: list[str]) -> str:
    """Writes a version whose name is the digest of its rows; a version that is there already is left alone."""
    parts = df.select(F.sum(F.xxhash64(*digest_columns).cast("decimal(38,0)")).alias("h"), F.count("*").alias("n")).first()
    name = hashlib.sha256(f"{parts['h']}:{parts['n']}:{df.schema.simpleString()}".encode()).hexdigest()[:16]
    path = f"{root.rstrip('/')}/version={name}"
    fs_path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    if not fs.exists(fs_path):
        temporary = f"{root.rstrip('/')}/.tmp-{uuid.uuid4().hex}"
        df.write.parquet(temporary)
        if not fs.rename(df.sparkSession._jvm.org.apache.hadoop.fs.Path(temporary), fs_path):
            raise OSError(f"couldn't publish {path}")
    return path
