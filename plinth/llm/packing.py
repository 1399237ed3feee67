"""Best-fit packing of tokenised documents into sequences, planned over the histogram of lengths.

Documents are tokenised once, cut where they are longer than a sequence, and the pieces written as a table. The histogram
of piece lengths, at most ``capacity`` numbers, goes to the driver, which runs best-fit decreasing over counts: open
sequences are groups of equal remaining space, and all pieces of one length that fit a group go there at once. The plan is
a list of rank intervals of each length with the sequences and offsets that they take, bounded by the square of capacity
and independent of the number of documents. Pieces then take their places by their rank within their length. Ranks are
counted in hashed buckets and shifted by the buckets before, so that a length that most pieces share is spread out too.

Null texts are empty and give one piece, the end id alone. Rows with equal keys are separate documents. Ties: pieces of one
length are ranked by hashed bucket, key, piece and checksum; equal ones are interchangeable. Long texts are encoded whole. An
empty table gives no pieces. Columns other than key and text are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.llm._common import cut, sliced, small_batches, table, text_or_empty
from plinth.llm.byte_bpe import bpe

CAPACITY, END = 1024, 2


class Slots(NamedTuple):
    """Pieces of a length with ranks from rank_from on: ``per`` of them in each of the sequences from sequence on, from offset on."""

    rank_from: int
    per: int
    sequence: int
    offset: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[int, list[Slots]]:
    """Best-fit decreasing over counts: the slots of every length, by rank."""
    space: dict[int, list[tuple[int, int]]] = {}  # remaining: (first sequence, number of sequences)
    slots: dict[int, list[Slots]] = {}
    used = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        mine = slots.setdefault(length, [])

        def fill(first: int, number: int, remaining: int, left: int, rank: int, length: int = length, mine: list = mine) -> tuple[int, int]:
            """Puts pieces into a group of equal sequences; gives what is left and the next rank."""
            per = remaining // length
            full = min(number, left // per)
            if full:
                mine.append(Slots(rank, per, first, capacity - remaining))
                space.setdefault(remaining - per * length, []).append((first, full))
                left, rank = left - full * per, rank + full * per
            if full < number:
                if left:
                    mine.append(Slots(rank, left, first + full, capacity - remaining))
                    space.setdefault(remaining - left * length, []).append((first + full, 1))
                    rank, left, full = rank + left, 0, full + 1
                if full < number:
                    space.setdefault(remaining, []).append((first + full, number - full))
            return left, rank

        for remaining in sorted(r for r in space if r >= length):
            if not left:
                break
            for first, number in space.pop(remaining):
                if left:
                    left, rank = fill(first, number, remaining, left, rank)
                else:
                    space.setdefault(remaining, []).append((first, number))
        if left:
            number = -(-left // (capacity // length))
            fill(used, number, capacity, left, rank)
            used += number
    return slots


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """start and length of the pieces of n ids: the first one takes what full pieces leave."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return ([(0, head)] if head else []) + [(i, capacity) for i in range(head, n, capacity)]


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, key: str, text: str, capacity: int, end: int) -> DataFrame:
    rows = docs.select(F.col(key).cast("long"), text_or_empty(text).alias("__text"))
    schema = f"`{key}` bigint, piece int, start bigint, length bigint, ids_crc32 bigint"

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(tokenizer_path)
        last = np.array([end], "<u4")
        for batch in sliced(batches, "__text", 4 << 20):
            out: list[tuple] = []
            for k, ids in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1).to_pylist())):
                ids = np.concatenate([ids.astype("<u4"), last])
                for i, (start, length) in enumerate(piece_bounds(len(ids), capacity)):
                    out.append((k, i, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            columns = [pa.array(c, kind) for c, kind in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(pieces, schema)


def pack(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id and offset for every piece of every row of docs."""
    spark = docs.sparkSession
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pieces = cut(tokenised_pieces(docs, tokenizer_path, key, text, capacity, end), "pieces")
    pieces = pieces.withColumn("__bucket", F.pmod(F.xxhash64(F.col(key), "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = pieces.groupBy("length", "__bucket").agg(F.count("*").alias("__n"))
    # capacity x buckets rows at most
    before = counts.select("length", "__bucket", (F.sum("__n").over(Window.partitionBy("length").orderBy("__bucket")) - F.col("__n")).alias("__before"))
    within = Window.partitionBy("__bucket", "length").orderBy(key, "piece", "ids_crc32")
    ranked = pieces.withColumn("__within", F.row_number().over(within) - 1).join(before, ["length", "__bucket"])
    ranked = ranked.select(key, "piece", "start", "length", "ids_crc32", (F.col("__within") + F.col("__before")).alias("__rank"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    arrays = {length: np.array(s, np.int64).reshape(-1, 4) for length, s in plan(histogram, capacity).items()}
    schema = f"`{key}` bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length):
                mine = np.flatnonzero(length == size)
                slots = arrays[int(size)]
                s = slots[np.searchsorted(slots[:, 0], rank[mine], side="right") - 1]
                nth = rank[mine] - s[:, 0]
                sequence[mine] = s[:, 2] + nth // s[:, 1]
                offset[mine] = s[:, 3] + nth % s[:, 1] * size
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    small_batches(spark)
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
