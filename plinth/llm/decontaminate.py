"""Benchmark decontamination: CGK random-walk embeddings, repeated bit sampling, exact edit verification.

Texts and items are lower-cased (A-Z) with one space between words. The embedding of Chakraborty, Goldenberg and Koucky walks
along a string: step j writes the byte under the pointer, which then moves on or stays, as a random bit of j and that byte
says. Strings at small edit distance fall into step again after each edit, so their embeddings differ in few places.

A window of item size starts at every word of every text, and its embedding begins anew at each word: a walk of the whole
window at a fifth of edits is out of step for most of its length, so that no affordable number of samples meets it, while
walks of STEPS steps keep the damage of an edit to themselves. Each repetition has random bits of its own, samples SAMPLED
of these steps, and looks the samples up in a table of the items' own walks, entered at each byte of each item; what agrees
proposes the alignment of a window with an item. Four repetitions meet 99 of 100 leaks of items of 90 bytes with a fifth of
their characters edited, and more of longer ones (tests measure recall by length and rate). Items of fewer than PIECES_BELOW
bytes are also cut into one piece more than the edits allowed: a leak leaves one undamaged, so none of these is missed.

A walk ends as soon as no item begins with the samples that it has so far; those that agree in all samples get to the end.

A proposed window first meets the item in stretches of 64 bytes, thousands abreast: the least distances of all stretches add
up to no more than the item's own, so a window goes as soon as those of its first stretches exceed the distance allowed, and
nothing near is lost. For the others Myers'
bit-parallel scan gives the item's exact least edit distance to any part of the window, widened by the distance allowed.
Texts within ``similarity`` (1 - distance / item length) hold the item. Items go to the executors in blocks of BLOCK_BYTES at most, one pass over the texts for each block; more than
MOST_BYTES of items are an error.

Null or empty texts hold nothing, and null or empty items are never held. Short items follow the same rule as all others.
Rows and items that repeat are answered as often as they come; of equally near places the first is meant. Empty tables give
no finding and drop nothing. Long texts are one pass of array arithmetic. drop_contaminated keeps all columns, whatever
their names; find_items reads key and text only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.llm._common import sliced, small_batches, table, text_or_empty

SIMILARITY, STEPS, SAMPLED, REPETITIONS, BLOCK_BYTES, MOST_BYTES = 0.8, 36, 14, 4, 8 << 20, 256 << 20
#: Items of fewer bytes are also met by pieces, of which a leak leaves one undamaged.
PIECES_BELOW = 80
#: Stretches of items that are held against texts together, and bytes of their windows that are laid out at a time.
TOGETHER, COLUMNS = 1 << 12, 32
#: Bytes of texts that are searched together.
TEXT_BYTES = 2 << 20


def normal(text: str) -> bytes:
    return b" ".join(text.encode().lower().split()).replace(b"\0", b" ")


class Walk:
    """One repetition's random bits and sampled steps."""

    def __init__(self, seed: int, steps: int, sampled: int) -> None:
        rng = np.random.default_rng(seed)
        self.moves = rng.integers(0, 2, (steps, 256))
        self.moves[:, 0] = 0  # the end of a text is never passed
        self.sampled = frozenset(rng.choice(steps, sampled, replace=False).tolist())
        self.last = max(self.sampled)
        #: After some of the sampled steps, the last among them, the upper bits of the keys that the items have by then.
        self.begun = {j: np.zeros(1 << 20, bool) for j in {*sorted(self.sampled)[5::2], self.last}}

    def keys(self, flat: np.ndarray, at: np.ndarray, learn: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Positions in at, and the sampled steps of the walks from there as 64-bit numbers.

        All of at to learn (the items' own places); else a place goes as soon as no item begins with its samples so far.
        """
        kept, out = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for first in range(0, len(at), 1 << 14):  # blocks that stay in the cache
            place = at[first : first + (1 << 14)].astype(np.int64)
            mine = np.arange(first, first + len(place))
            key, low = np.zeros(len(place), np.uint64), np.zeros(len(place), np.uint64)
            byte, wide, move = np.zeros(len(place), np.uint8), np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
            for j in range(self.last + 1):
                flat.take(place, out=byte, mode="clip")
                wide[:] = byte
                if j in self.sampled:
                    key += wide.view(np.uint64)
                    key *= np.uint64(0x9E3779B97F4A7C15)
                    key ^= np.right_shift(key, np.uint64(29), out=low)
                if j in self.begun and learn:
                    self.begun[j][key >> np.uint64(44)] = True
                elif j in self.begun:
                    some = np.flatnonzero(self.begun[j].take((key >> np.uint64(44)).view(np.int64), mode="clip"))
                    place, mine, key, wide = place[some], mine[some], key[some], wide[some]
                    byte, low, move = byte[: len(some)], low[: len(some)], move[: len(some)]
                if j < self.last:
                    place += self.moves[j].take(wide, out=move, mode="clip")
            kept.append(mine)
            out.append(key)
        return np.concatenate(kept), np.concatenate(out)


def word_starts(flat: np.ndarray) -> np.ndarray:
    inside = flat > 32
    return np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))


def runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each run, one run after another."""
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())


class Items:
    """The items of a block: their texts, bit masks and the table of sampled keys."""

    def __init__(self, items: list[tuple[int, str]], similarity: float, steps: int, sampled: int, repetitions: int) -> None:
        self.ids, self.raws = [], []
        for i, text in items:
            raw = normal(text or "")
            if raw:
                self.ids.append(i)
                self.raws.append(raw)
        self.allowed = [int((1 - similarity) * len(r) + 1e-9) for r in self.raws]
        flat = np.frombuffer(b"\0".join(self.raws) + b"\0", np.uint8)
        sizes = np.array([len(r) for r in self.raws], np.int64)
        ends = np.cumsum(sizes + 1)
        self.tables = []
        self.sizes, self.flat = sizes, flat
        self.begins = ends - sizes - 1
        self.masks: dict[int, dict[int, int]] = {}
        at = np.flatnonzero(flat)
        item = np.searchsorted(ends, at, side="right")
        offset = at - self.begins[item] if len(at) else at
        for k in range(repetitions):
            walk = Walk(k, steps, sampled)
            _, keys = walk.keys(flat, at, learn=True)
            order = np.argsort(keys, kind="stable")
            self.tables.append((walk, keys[order], item[order], offset[order]))
        # of a short item that a text holds, one of these pieces is undamaged
        self.pieces = []
        for i, raw in enumerate(self.raws):
            if len(raw) < PIECES_BELOW:
                cuts = [len(raw) * k // (self.allowed[i] + 1) for k in range(self.allowed[i] + 2)]
                self.pieces += [(i, c, raw[c:d]) for c, d in zip(cuts, cuts[1:])]

    def hits(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Item and start in flat of the alignments that the samples propose, without repeats."""
        at = word_starts(flat)
        items, starts = [], []
        for walk, keys, item, offset in self.tables:
            if not len(keys) or not len(at):
                continue
            some, mine = walk.keys(flat, at)
            low, high = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
            n = high - low
            places = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            items.append(item[places])
            starts.append(np.repeat(at[some], n) - offset[places])
        whole = flat.tobytes() if self.pieces else b""
        for i, offset, piece in self.pieces:
            places, p = [], whole.find(piece)
            while p >= 0:
                places.append(p - offset)
                p = whole.find(piece, p + 1)
            items.append(np.full(len(places), i, np.int64))
            starts.append(np.array(places, np.int64))
        if not items:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        item, start = np.concatenate(items), np.concatenate(starts)
        order = np.lexsort((start, item))
        item, start = item[order], start[order]
        new = np.concatenate([[True], (item[1:] != item[:-1]) | (start[1:] != start[:-1])])[: len(item)]
        return item[new], start[new]

    def plausible(self, flat: np.ndarray, item: np.ndarray, start: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether the item may lie within the distance allowed of flat[begin:end], aligned at start: the least distances of its stretches of 64 bytes to where the text may have them add up to no more.

        Windows meet one stretch after another until these already add up to more; the fewer windows are left, the more
        stretches of each at a time.
        """
        allowed = np.array(self.allowed, np.int64)[item]
        sizes, total = self.sizes[item], np.zeros(len(item), np.int64)
        stretches = -(-sizes // 64)
        flat = np.concatenate([flat, np.zeros(COLUMNS, np.uint8)])
        met, left = 0, np.arange(len(item))
        while len(left):
            more = max(1, TOGETHER // len(left))
            pieces = np.minimum(stretches[left] - met, more)
            window = np.repeat(left, pieces)
            offset = 64 * runs(np.full(len(left), met), pieces)
            low = np.clip(start[window] + offset - allowed[window], begin[window], end[window])
            length = np.minimum(64, sizes[window] - offset)
            high = np.clip(start[window] + offset + length + allowed[window] + allowed[window] // 4 + 2, low, end[window])
            place, least = self.begins[item[window]] + offset, np.zeros(len(window), np.int64)
            order = np.argsort(high - low, kind="stable")
            for first in range(0, len(order), TOGETHER):
                some = order[first : first + TOGETHER]
                least[some] = self.least(flat, place[some], length[some], low[some], high[some] - low[some])
            np.add.at(total, window, least)
            met += more
            left = left[(total[left] <= allowed[left]) & (stretches[left] > met)]
        return total <= allowed

    def least(self, flat: np.ndarray, place: np.ndarray, length: np.ndarray, low: np.ndarray, width: np.ndarray) -> np.ndarray:
        """The least distances of stretches of the items, from place on and of at most 64 bytes, to any part of the width bytes of flat from low on; widths in ascending order, COLUMNS bytes more in flat.

        Myers' columns, all stretches abreast. A stretch takes the upper rows; what is below them agrees with every byte.
        """
        # the rows of each byte, for the distinct stretches among these
        mine, which = np.unique(place, return_inverse=True)
        size = np.zeros(len(mine), np.int64)
        size[which] = length
        one, below = np.uint64(1), (64 - size).astype(np.uint64)
        rows = np.repeat((one << below) - one, 256)
        np.bitwise_or.at(rows, np.repeat(np.arange(len(mine)) * 256, size) + self.flat[runs(mine, size)], one << runs(64 - size, size).astype(np.uint64))
        ahead = np.lib.stride_tricks.sliding_window_view(flat, COLUMNS)
        ended = np.searchsorted(width, np.arange(width[-1]), "right").tolist()
        base, plus, minus = which * 256, np.uint64(2**64 - 1) << below[which], np.zeros(len(place), np.uint64)
        score = length.astype(np.int8)
        out = best = score.copy()
        at, sign = np.empty(len(place), np.int64), np.empty(len(place), bool)
        equal, xv, xh, ph, mh = np.empty((5, len(place)), np.uint64)
        gone = 0
        for step, over in enumerate(ended):
            if step % COLUMNS == 0:  # windows that ended go; the next bytes of the others, column by column
                low, base, plus, minus, score, best, at, sign, equal, xv, xh, ph, mh = (x[over - gone :] for x in (low, base, plus, minus, score, best, at, sign, equal, xv, xh, ph, mh))
                gone = over
                columns = np.ascontiguousarray(ahead[low + step].T)
            np.add(base, columns[step % COLUMNS], out=at)
            rows.take(at, out=equal, mode="clip")
            np.bitwise_or(equal, minus, out=xv)
            np.bitwise_and(equal, plus, out=xh)
            xh += plus
            xh ^= plus
            xh |= equal
            np.bitwise_or(xh, plus, out=ph)
            np.invert(ph, out=ph)
            ph |= minus
            np.bitwise_and(plus, xh, out=mh)
            score += np.less(ph.view(np.int64), 0, out=sign).view(np.int8)
            score -= np.less(mh.view(np.int64), 0, out=sign).view(np.int8)
            np.minimum(best[over - gone :], score[over - gone :], out=best[over - gone :])
            ph <<= one
            mh <<= one
            np.bitwise_or(xv, ph, out=plus)
            np.invert(plus, out=plus)
            plus |= mh
            np.bitwise_and(ph, xv, out=minus)
        return out

    def distance(self, item: int, window: bytes) -> int:
        """The least edit distance of the item to any part of the window."""
        raw = self.raws[item]
        masks = self.masks.get(item)
        if masks is None:
            masks = self.masks[item] = {}
            for i, byte in enumerate(raw):
                masks[byte] = masks.get(byte, 0) | 1 << i
        m = len(raw)
        full, top = (1 << m) - 1, 1 << (m - 1)
        plus, minus, score, best = full, 0, m, m
        for byte in window:
            equal = masks.get(byte, 0)
            xv = equal | minus
            xh = (((equal & plus) + plus) ^ plus) | equal
            ph, mh = minus | (full & ~(xh | plus)), plus & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
                if score < best:
                    best = score
            ph, mh = ph << 1 & full, mh << 1 & full
            plus, minus = mh | (full & ~(xv | ph)), ph & xv
        return best

    def held(self, raws: list[bytes]) -> list[tuple[int, int, int, int]]:
        """Text, item, distance and begin (in the normal text, about) of every item that a text holds, once each."""
        if not self.raws:
            return []
        flat = np.frombuffer(b"\0".join(raws) + b"\0", np.uint8)
        widths = np.array([len(r) + 1 for r in raws], np.int64)
        ends = np.cumsum(widths)
        item, start = self.hits(flat)
        if not len(item):
            return []
        # the text that an alignment's window lies in, by its middle; the window, widened by what may be inserted
        allowed = np.array(self.allowed, np.int64)[item]
        text = np.searchsorted(ends, np.clip(start + self.sizes[item] // 2, 0, len(flat) - 1), side="right")
        first = ends[text] - widths[text]
        begin = np.maximum(first, start - allowed)
        end = np.minimum(ends[text] - 1, start + self.sizes[item] + allowed + allowed // 4 + 2)
        keep = np.flatnonzero(end > begin)
        keep = keep[self.plausible(flat, item[keep], start[keep], begin[keep], end[keep])]
        order = keep[np.lexsort((start[keep], item[keep], text[keep]))]
        # alignments that are covered by the window of one shortly before are passed over
        some: list[int] = []
        last, at = (-1, -1), 0
        for k, t, i, s in zip(order.tolist(), text[order].tolist(), item[order].tolist(), start[order].tolist()):
            if (t, i) != last or s - at > max(2, self.allowed[i] // 4):
                some.append(k)
                last, at = (t, i), s
        tried = np.array(some, np.int64)
        found: dict[tuple[int, int], tuple[int, int]] = {}
        for t, i, s, a, b in zip(*(c[tried].tolist() for c in (text, item, start - first, begin - first, end - first))):
            window = raws[t][a:b]
            d = 0 if self.raws[i] in window else self.distance(i, window)
            if d <= self.allowed[i] and ((t, i) not in found or d < found[t, i][0]):
                found[t, i] = (d, max(0, s))
        return [(t, i, d, s) for (t, i), (d, s) in sorted(found.items())]


def item_blocks(items: DataFrame, item_key: str, item_text: str, block_bytes: int) -> list[list[tuple[int, str]]]:
    """The items in blocks of bounded size, all within MOST_BYTES; each block is read on its own."""
    rows = items.select(F.col(item_key).cast("long").alias("i"), text_or_empty(item_text).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    if total > MOST_BYTES:
        raise ValueError(f"the items have {total} bytes; more than {MOST_BYTES} go in several runs")
    blocks = max(1, -(-2 * total // block_bytes))
    return [[(r["i"], r["t"]) for r in rows.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).collect()] for b in range(blocks)]


def find_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, steps: int = STEPS, sampled: int = SAMPLED, repetitions: int = REPETITIONS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """key, item_id, distance and similarity of every item that a text holds."""
    rows = docs.select(F.col(key).cast("long"), text_or_empty(text).alias("__text"))
    out = None
    for block in item_blocks(items, item_key, item_text, block_bytes):

        def find(batches: Iterator[pa.RecordBatch], block: list = block) -> Iterator[pa.RecordBatch]:
            known = Items(block, similarity, steps, sampled, repetitions)
            for batch in sliced(batches, "__text", TEXT_BYTES):
                keys = batch.column(0).to_pylist()
                found = [(keys[t], known.ids[i], d, 1 - d / len(known.raws[i])) for t, i, d, _ in known.held([normal(t) for t in batch.column(1).to_pylist()])]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=[key, "item_id", "distance", "similarity"])

        part = rows.mapInArrow(find, f"`{key}` bigint, item_id bigint, distance bigint, similarity double")
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, steps: int = STEPS, sampled: int = SAMPLED, repetitions: int = REPETITIONS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows and columns of docs whose text holds no item."""
    schema, place = T.StructType(docs.schema.fields), docs.columns.index(text)
    for block in item_blocks(items, item_key, item_text, block_bytes):

        def clean(batches: Iterator[pa.RecordBatch], block: list = block) -> Iterator[pa.RecordBatch]:
            known = Items(block, similarity, steps, sampled, repetitions)
            for batch in sliced(batches, text, TEXT_BYTES):
                held = {t for t, *_ in known.held([normal(t or "") for t in batch.column(place).to_pylist()])}
                yield batch.take(pa.array([i for i in range(batch.num_rows) if i not in held], pa.int64())) if held else batch

        docs = docs.mapInArrow(clean, schema)
    return docs


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
