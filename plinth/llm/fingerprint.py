"""Document fingerprints: quartile bucket digests of hashed byte triplets, compared by a bounded difference score.

Every five-byte window of a text's UTF-8 bytes gives the triplets (0,1,2), (0,1,3), (0,2,4) and (0,1,4); each is hashed into
one of BUCKETS counters. The digest holds, for each bucket, the quartile (0 to 3) that its count falls in, the logarithm of
the length, the ratios of the quartiles and a checksum of the text, in hexadecimal. The difference of two digests adds, for
each bucket, the square of the quartile distance, and a bounded term for length and quartile ratios; likeness is 1 at no
difference and 0 at what unrelated digests differ by (of sparse digests, what digests without a common bucket differ by),
and never outside 0 to 1.

Null texts are empty and have an empty digest; texts of fewer than five bytes are filled up with zero bytes. Equal texts
have equal digests. Long texts are one pass of array arithmetic. The edited text of a document takes the start of the next
one in descending order of the key; rows with equal keys are ordered by a hash of the text, null keys come last; a single
row is its own next one, an empty table gives an empty one. Columns other than key and text are never read.

Rows are dealt out by ranges of (key, text hash) that a random sample of SAMPLE rows a range sets, so the texts of one hot key
spread over many ranges; each range ends with a copy of the first row of the next, one row a range.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm._common import small_batches, table, text_or_empty

BUCKETS = 256
#: Of unrelated digests, the mean difference of a bucket: quartiles are uniform, E (a - b)^2 = 2.5.
UNRELATED = 2.5


def digest(raw: bytes) -> str:
    n = len(raw)
    head = f"{min(255, int(np.log2(n + 1) * 8)):02x}"
    check = f"{zlib.crc32(raw):08x}"
    if n == 0:
        return f"{head}0000{check}{'00' * (BUCKETS // 4)}"
    b = np.frombuffer(raw.ljust(5, b"\0"), np.uint8).astype(np.uint32)
    a = b[:-4] * np.uint32(0x9E3779B1)
    two = b * np.uint32(0x85EBCA77)
    three = b * np.uint32(0xC2B2AE3D)
    a1 = a + two[1:-3]
    counts = np.zeros(BUCKETS, np.int64)
    for salt, mixed in ((0x1B873593, a1 + three[2:-2]), (0x2545F491, a1 + three[3:-1]), (0x5851F42D, a + two[2:-2] + three[4:]), (0x14057B7E, a1 + three[4:])):
        mixed = (mixed ^ np.uint32(salt)) * np.uint32(0x27D4EB2F)
        counts += np.bincount(mixed >> np.uint32(33 - BUCKETS.bit_length()), minlength=BUCKETS)
    q1, q2, q3 = np.partition(counts, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1])[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    code = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    ratios = f"{int(q1 * 255 // max(1, q3)):02x}{int(q2 * 255 // max(1, q3)):02x}"
    packed = code[0::4] | code[1::4] << 2 | code[2::4] << 4 | code[3::4] << 6
    return f"{head}{ratios}{check}{packed.astype(np.uint8).tobytes().hex()}"


def codes(digest_: str) -> np.ndarray:
    packed = np.frombuffer(bytes.fromhex(digest_[14:]), np.uint8)
    return np.stack([packed >> s & 3 for s in (0, 2, 4, 6)], axis=1).ravel().astype(np.int16)


def likeness(a: str, b: str) -> float:
    """1 for equal digests, 0 for unrelated or opposite ones."""
    if a == b:
        return 1.0
    x, y = codes(a), codes(b)
    d = x - y
    score = float((d * d).sum()) / max(1.0, min(BUCKETS * UNRELATED, float((x * x).sum() + (y * y).sum())))
    score += min(8, abs(int(a[:2], 16) - int(b[:2], 16))) / 160
    score += (min(64, abs(int(a[2:4], 16) - int(b[2:4], 16))) + min(64, abs(int(a[4:6], 16) - int(b[4:6], 16)))) / 2560
    score += 0.005 * (a[6:14] != b[6:14])
    return max(0.0, 1.0 - score)


LAST = -(2**63)  # stands for a null key
#: Rows of the sample for each range.
SAMPLE = 64


def _place(bounds: list[tuple[int, int]]):
    """The range of a row: how many bounds (place, hash) don't lie behind it, by binary search over 16 bytes in order."""
    edges = np.array(bounds, np.int64).reshape(-1, 2)

    def marks(place: np.ndarray, hash_: np.ndarray) -> np.ndarray:
        both = np.stack([place, hash_], axis=1).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
        return np.ascontiguousarray(both.astype(">u8")).view("S16").ravel()

    known = marks(edges[:, 0], edges[:, 1])

    @F.pandas_udf("int")
    def place(at: pd.Series, hash_: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(known, marks(at.to_numpy(np.int64), hash_.to_numpy(np.int64)), side="right").astype(np.int32))

    return place


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next for every row of docs."""
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(key).cast("long").alias("__key"), text_or_empty(text).alias("__text"))
    # the place: keys in descending order, null last
    rows = rows.withColumns({"__at": F.bitwise_not(F.coalesce("__key", F.lit(LAST))), "__hash": F.xxhash64("__text")})
    share = min(1.0, SAMPLE * parts / max(1, docs.count()))
    sample = rows.select("__at", "__hash").sample(share, 11).collect() if parts > 1 else []
    drawn = sorted((r["__at"], r["__hash"]) for r in sample)
    rows = rows.withColumn("__bucket", _place(sorted({drawn[len(drawn) * i // parts] for i in range(1, parts)}) if drawn else [])("__at", "__hash"))
    # the first row of each range, again at the end of the range before: as many rows as ranges, known by place and hash
    heads = {r["__bucket"]: r["h"] for r in rows.groupBy("__bucket").agg(F.min(F.struct("__at", "__hash")).alias("h")).collect()}
    used = sorted(heads)
    if used:
        to = spark.createDataFrame([(used[i - 1], *heads[b]) for i, b in enumerate(used)], "__to int, __at bigint, __hash bigint")
        copies = rows.join(F.broadcast(to), ["__at", "__hash"]).groupBy("__to", "__at", "__hash").agg(F.min(F.struct("__text", "__key")).alias("r"))
        tails = copies.select(F.col("r.__key").alias("__key"), F.col("r.__text").alias("__text"), "__at", "__hash", F.col("__to").alias("__bucket"), F.lit(1).alias("__tail"))
        rows = rows.withColumn("__tail", F.lit(0)).unionByName(tails)
    else:
        rows = rows.withColumn("__tail", F.lit(0))
    dealt = rows.repartitionById(max(parts, len(used), 1), "__bucket").sortWithinPartitions("__bucket", "__tail", "__at", "__hash", "__text")
    schema = f"`{key}` bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # key, text, fingerprint of the row that waits for its next one
        names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for batch in batches:
            out: list[tuple] = []
            for k, t, tail in zip(*(c.to_pylist() for c in batch.columns)):
                mark = digest(t.encode())
                if held is not None:
                    k0, t0, mark0 = held
                    cut = len(t0) // 3
                    edited = (t0[: len(t0) - cut] + t[:cut]).encode()
                    mark1 = digest(edited)
                    out.append((k0, len(t0), hashlib.sha256(edited).hexdigest(), mark0, mark1, likeness(mark0, mark1), likeness(mark0, mark)))
                held = None if tail else (k, t, mark)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], names=names)

    return dealt.select("__key", "__text", "__tail").mapInArrow(compare, schema)


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return fingerprint_documents(table(spark, sf_dir, "documents"))
