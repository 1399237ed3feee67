"""Token counts of whole texts by a sentencepiece model; huge texts in overlapping chunks that are spliced exactly.

Texts up to ``chunk`` bytes go to the library whole. A longer text is encoded in overlapping chunks, and the byte offset
at which each token ends is kept. Two neighbouring chunks are spliced at a position of their overlap where both have a
token boundary that is proven stable: a space after a byte that isn't one. No piece of the vocabulary holds a space mark
behind another character (checked when the model is loaded), so no merge ever crosses such a place, and what stands on one
side of it can't change the tokens on the other. Where an overlap has no such place, it is widened, four times each try,
up to the whole of both chunks. A chunk without any such place grows in one step to the next one of the text (to its end,
if there is none, as in scripts without spaces), so each byte is encoded a bounded number of times. If a chunk's tokens
don't add up to its bytes (a model that normalises its input), nothing is proven and the text is encoded whole.

Null texts count as empty: no bytes, no tokens. Rows, ties and repeated keys included, are counted as often as they come; an
empty table gives an empty one. Columns other than key and text are never read, so their names can't clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm._common import sliced, small_batches, table, text_or_empty

MARK = "▁"
CHUNK, OVERLAP, LIMIT = 1 << 15, 1 << 9, 4096


class PieceCounter:
    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.proven = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        self.width = np.array([1 if self.model.is_byte(i) else len(p.replace(MARK, " ").encode()) for i, p in enumerate(pieces)], np.int64)

    def ends(self, raw: bytes, start: int, end: int) -> np.ndarray | None:
        """The offset in raw at which each token of raw[start:end] ends; None if they don't add up."""
        ids = self.model.encode(raw[start:end].decode())
        at = start - 1 + np.cumsum(self.width[np.array(ids, np.int64)])
        return at if len(at) and at[-1] == end else None

    def count_whole(self, raw: bytes) -> int:
        return len(self.model.encode(raw.decode()))

    def count(self, raw: bytes, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        n = len(raw)
        if n <= chunk or not self.proven:
            return self.count_whole(raw)
        data = np.frombuffer(raw, np.uint8)

        def whole_char(i: int) -> int:
            while 0 < i < n and data[i] & 0xC0 == 0x80:
                i += 1
            return min(i, n)

        stable = np.flatnonzero((data[1:] == 32) & (data[:-1] != 32)) + 1
        total, counted = 0, -1  # counted: tokens that end up to there are in total
        start, end = 0, whole_char(chunk)
        left = self.ends(raw, start, end)
        while left is not None and end < n:
            ahead = int(np.searchsorted(stable, end))
            if ahead == np.searchsorted(stable, max(start, counted), side="right"):  # nothing to splice at in the chunk
                stop = whole_char(min(n, int(stable[ahead]) + chunk)) if ahead < len(stable) else n
                left, end = self.ends(raw, start, stop), stop
                continue
            back, splice = overlap, None
            while splice is None:
                begin = whole_char(max(start, end - back))
                stop = whole_char(min(n, max(end + 1, begin + chunk)))
                right = self.ends(raw, begin, stop)
                if right is None:
                    return self.count_whole(raw)
                both = np.intersect1d(left[left > max(begin, counted)], right)
                both = both[(both < end) & (both > begin)]
                both = both[(data[both] == 32) & (data[both - 1] != 32)] if len(both) else both
                if len(both):
                    splice = int(both[len(both) // 2])
                elif begin <= start:
                    break  # the chunks overlap as far as they can: one chunk now
                else:
                    back *= 4
            if splice is None:
                stop = whole_char(min(n, 2 * end - start))
                left, end = self.ends(raw, start, stop), stop
                continue
            total += int(((left > counted) & (left <= splice)).sum())
            counted, left, start, end = splice, right, begin, stop
        if left is None:
            return self.count_whole(raw)
        return total + int((left > counted).sum())


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """key, n_bytes, n_tokens and over_limit for every row of docs. model_path: of the model, on every executor."""
    rows = docs.select(F.col(key), text_or_empty(text).alias("__text"))
    schema = rows.select(F.col(key), F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_tokens"), F.lit(True).alias("over_limit")).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = counter(model_path)
        for batch in sliced(batches, "__text", 2 << 20):
            texts = batch.column(1).to_pylist()
            raws = [t.encode() for t in texts]
            tokens = np.zeros(len(raws), np.int64)
            short = [i for i, r in enumerate(raws) if len(r) <= chunk]
            tokens[short] = [len(ids) for ids in model.model.encode([texts[i] for i in short], num_threads=1)]
            for i, r in enumerate(raws):
                if len(r) > chunk:
                    tokens[i] = model.count(r, chunk, overlap)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in raws], pa.int64()), pa.array(tokens), pa.array(tokens > limit)], names=[key, "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(count, schema)


def op5_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    small_batches(spark)
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
