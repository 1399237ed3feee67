"""Repeated byte strings of a corpus, by common-prefix interval trees over sparse enhanced suffix arrays.

A byte is repeated if a string of ``least`` bytes that also starts anywhere else covers it. The corpus is too large for one
suffix array, so its suffixes are thinned and dealt out without losing a match:

1. Of all grams of ``gram`` bytes, the anchors are those whose hash is the least in some window of ``least`` bytes. Equal
   strings of ``least`` bytes have equal least grams at equal places, so each repeated string holds an anchor whose gram
   also stands, in the same place of the match, in the other copy. About two grams in ``least`` are anchors.
2. Anchors whose hash occurs once are dropped. The others bring their neighbourhood, as far as a match of ``least`` bytes
   that holds them can reach. Equal neighbourhoods are counted, not repeated, before they move: copies stay cheap.
3. The neighbourhoods of one gram are the suffixes that start with it, in classes that share half of ``least`` bytes. Sorted, with the common prefixes of neighbours, a
   stack scan gives their common-prefix intervals, the deepest first. Of each interval's members the left contexts are
   compared in sorted order: where they differ the interval is left-diverse, and each member's longest left extension
   within it is known. An extension and a prefix of ``least`` bytes together are a repeat, and every member of the interval
   gets its part, not neighbours in the array only.
4. The parts go back to every occurrence, and each text is put together again with its own.

Anchors may be chosen for shorter repeats (``passage``) than those removed (``least``): the neighbourhoods still reach as far
as a match of ``least`` bytes around its middle window, so one pass over the intervals gives the parts of both lengths.

A gram with more than ``split`` different neighbourhoods isn't gathered: each of its windows of ``least`` bytes is counted
by its 128-bit hash instead, which gives the same parts with sums that combine before they move.

Null and empty texts have no bytes and no spans; rows that repeat, keys included, hold each other's bytes and lose them all.
Ties between equal grams are settled by place. Very long texts go in segments of SEGMENT bytes; an empty table gives an empty
one. remove_repeats keeps all columns, whatever their names; repeat_digests reads key and text only. Anchors are looked for in
SEGMENT bytes at a time, in arrays of eight bytes for each of them: about 200 bytes of a worker's memory for each byte.

Matches never cross documents. Null texts are empty. Texts shorter than ``least`` keep all bytes, whatever their copies.
Rows with equal keys and texts are copies of one another. Overlapping occurrences in one text count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.llm._common import cut, flat_bytes, fresh, sliced, small_batches, table, text_or_empty

LEAST, GRAM, SPLIT, SEGMENT = 400, 32, 50_000, 1 << 18
#: Passages that repeat are reported from so many bytes and, further, words on.
PASSAGE, PASSAGE_WORDS = 200, 50
#: Bits of the map of texts that may have repeats, in words of 64: a broadcast of 2^18 rows at most.
MARKS = 1 << 24

_BASE = np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


def _sliding(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of width values."""
    n = len(values)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int, gram: int, longer: int | None = None) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Places of the anchors in flat and their hashes; begins and ends of the strings of ``least`` bytes that are repeated within their own run, and of those of ``longer`` bytes; whether a segment has windows without an anchor of their own.

    Segments [start, end) follow one another and matches don't cross them. Of several least grams in a window the first is
    its anchor, or the last if the run of them may have begun before the window: so a run has one anchor at either end, not
    one for each turn. A window that is a run altogether, of a period of half of it at most, is repeated if the run goes on
    for one more period; the windows of the run's first period then stand for all.
    """
    none = np.zeros(0, np.int64)
    n, width = len(flat), least - gram + 1
    spared = np.zeros(len(starts), bool)
    if n < least:
        return none, none, [(none, none)] * (2 if longer else 1), spared
    sums = np.zeros(n + 1, np.uint64)
    sums[1:] = flat
    sums[1:] += np.uint64(1)
    sums[1:] *= _powers(n, _BASE)[:n]
    np.add.accumulate(sums, out=sums)
    back = _powers(n, _BACK)
    code = sums[gram:] - sums[:-gram]
    code *= back[: n - gram + 1]
    code ^= code >> np.uint64(31)
    code *= np.uint64(0x9FB21C651E98DF25)
    code ^= code >> np.uint64(28)
    mask = np.uint64((1 << 23) - 1)  # room for the places of a segment
    place = np.arange(len(code), dtype=np.uint64)
    high = code & ~mask
    first = (_sliding(high | place, width) & mask).astype(np.int64)
    last = (mask - (_sliding(high | (mask - place), width) & mask)).astype(np.int64)
    valid = np.zeros(n + 1, np.int8)
    long = ends - starts >= least
    valid[starts[long]] += 1
    np.add.at(valid, ends[long] - least + 1, -1)
    window = np.flatnonzero(np.cumsum(valid)[: len(first)] > 0)
    pick = first[window]
    tied = np.flatnonzero(pick != last[window])
    local = [none] * (2 if longer else 1)
    if len(tied):
        i, one, other = window[tied], pick[tied], last[window[tied]]
        # the period: how far on the first of the equal grams comes again
        heads, at = np.unique(one, return_inverse=True)
        reach = np.zeros(len(heads), np.int64)
        np.maximum.at(reach, at, other - one)
        period, open_ = reach.copy(), np.arange(len(heads))
        for d in range(1, least // 2 + 1):
            open_ = open_[reach[open_] > d]
            if not len(open_):
                break
            hit = high[heads[open_] + d] == high[heads[open_]]
            period[open_[hit]] = d
            open_ = open_[~hit]
        period = period[at]

        def same(x: np.ndarray, y: np.ndarray, length: np.ndarray) -> np.ndarray:
            return (sums[x + length] - sums[x]) * back[x] == (sums[y + length] - sums[y]) * back[y]

        whole = (period <= least // 2) & same(i, i + period, least - period)
        pick[tied] = np.where(whole | (one - i >= period), one, other)
        # windows that come again one period on, and those that stood there one period before
        is_window = np.zeros(n + 1, bool)
        is_window[window] = True
        segment = np.searchsorted(starts, i, side="right")
        ahead, before = np.minimum(i + period, n), np.maximum(i - period, 0)
        on = whole & is_window[ahead] & (np.searchsorted(starts, ahead, side="right") == segment)
        on[on] = same(i[on], ahead[on], np.full(int(on.sum()), least))
        held = whole & (i >= period) & is_window[before] & (np.searchsorted(starts, before, side="right") == segment)
        held[held] = same(i[held], before[held], np.full(int(held.sum()), least))
        local[0] = np.unique(np.concatenate([i[on], ahead[on]]))
        if longer:  # of a run that goes on for so long, the longer strings come again one period on too
            far = whole & (i + period + longer <= ends[segment - 1])
            far[far] = same(i[far], i[far] + period[far], np.full(int(far.sum()), longer))
            local[1] = np.unique(np.concatenate([i[far], i[far] + period[far]]))
        keep = np.ones(len(window), bool)
        keep[tied[held]] = False
        spared[segment[held] - 1] = True
        pick = pick[keep]
    at = np.unique(pick)
    return at, code[at].view(np.int64), [_covered(places, size) for places, size in zip(local, (least, longer))], spared


def _covered(places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of strings of one size that begin at sorted places."""
    if not len(places):
        return places, places
    breaks = np.flatnonzero(np.diff(places) > 1)
    return places[np.concatenate([[0], breaks + 1])], places[np.concatenate([breaks, [len(places) - 1]])] + size


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """__k1, __k2: key and text hash. Rows that share both are equal."""
    whole = text_or_empty(text)
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("__k1"), F.xxhash64(whole).alias("__k2"), whole.alias("__text"))


def _marks(some: DataFrame) -> DataFrame:
    """word, bits: a map of MARKS bits, of the same size for every corpus, that has the bits of all (__k1, __k2) of ``some``."""
    at = F.pmod(F.xxhash64("__k1", "__k2"), F.lit(MARKS))
    return cut(some.select(at.alias("at")).selectExpr("at div 64 AS word", "shiftleft(1L, cast(at % 64 AS int)) AS bit").groupBy("word").agg(F.bit_or("bit").alias("bits")), "marks")


def _marked(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """rows with __in: true where the map has the row's bit, for all that it was made of and few others; these find no partner later on."""
    at = rows.withColumn("__at", F.pmod(F.xxhash64("__k1", "__k2"), F.lit(MARKS)))
    held = at.join(F.broadcast(marks), F.expr("__at div 64 = word"), "left")
    return held.withColumn("__in", F.expr("coalesce(getbit(bits, cast(__at % 64 AS int)), 0) = 1")).select(*rows.columns, "__in")


def _anchor_rows(rows: DataFrame, least: int, gram: int, longer: int | None = None) -> DataFrame:
    """Anchors (h; kind 1 where windows of the text have none of their own, else 0), and the spans that are repeated within their own run (kind 0 of the longer strings, or of the only ones; 1 of the shorter)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "__text", SEGMENT):
            flat, at = flat_bytes(batch.column(2))
            for first in range(0, max(1, len(flat)), SEGMENT):  # a long text goes in segments; each window is in one of them
                last = min(len(flat), first + SEGMENT + (longer or least) - 1)
                starts, ends = np.clip(at[:-1], first, last), np.clip(at[1:], first, last)
                some = ends > starts
                place, code, local, spared = anchors(flat[first:last], starts[some] - first, ends[some] - first, least, gram, longer)
                # anchors have a hash, runs a kind and an end
                begins, finishes = (np.concatenate(x) for x in zip(*local))
                kinds = np.repeat(np.arange(len(local))[::-1], [len(b) for b, _ in local])
                place = np.concatenate([place, begins]) + first
                doc = np.searchsorted(at, place, side="right") - 1
                if len(place):
                    hashes = pa.concat_arrays([pa.array(code), pa.nulls(len(begins), pa.int64())])
                    stops = pa.concat_arrays([pa.nulls(len(code), pa.int64()), pa.array(finishes + first - at[doc[len(code) :]], pa.int64())])
                    runs = pa.array(spared[np.searchsorted(np.flatnonzero(some), doc[: len(code)])].astype(np.int32))
                    kind = pa.concat_arrays([runs, pa.array(kinds, pa.int32())])
                    yield pa.RecordBatch.from_arrays([hashes, batch.column(0).take(pa.array(doc)), batch.column(1).take(pa.array(doc)), pa.array(place - at[doc]), stops, kind], names=["h", "__k1", "__k2", "pos", "end", "kind"])
                if last == len(flat):
                    break

    return rows.mapInArrow(find, "h bigint, __k1 bigint, __k2 bigint, pos bigint, end bigint, kind int")


def _neighbourhoods(rows: DataFrame, least: int, gram: int, passage: int | None = None) -> DataFrame:
    """rows: __k1, __k2, __text, found (array of h, pos), spared. Occurrences (kind 0) and counted neighbourhoods (kind 1).

    Where anchors are those of ``passage`` bytes, a string of ``least`` bytes has the one of its middle window, which is that
    of all its copies: a neighbourhood reaches as far as such a string can. If that window has no anchor of its own, being in
    a run that began a period before, this holds for all copies of the string, and their texts (spared) take the full reach.
    """
    schema = "kind int, h bigint, c1 bigint, c2 bigint, __k1 bigint, __k2 bigint, pos bigint, left int, context binary, n bigint"
    kinds = pa.schema([("kind", pa.int32()), ("h", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("__k1", pa.int64()), ("__k2", pa.int64()), ("pos", pa.int64()), ("left", pa.int32()), ("context", pa.binary()), ("n", pa.int64())])
    middle = (least - (passage or least)) // 2

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, list] = {}

        def counted() -> pa.RecordBatch:
            rows = [(1, h, c1, c2, None, None, None, left, context, n) for (h, c1, c2), (left, context, n) in seen.items()]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)

        for batch in sliced(batches, "__text", 4 << 20):
            out = []
            for k1, k2, text, found, spared in zip(*(c.to_pylist() for c in batch.columns)):
                raw = text.encode()
                back, on = (least - gram, least) if spared or not passage else (middle + passage - gram, least - middle)
                for x in found:
                    h, pos = x["h"], x["pos"]
                    left = min(pos, back)
                    context = raw[pos - left : pos + on]
                    mark = hashlib.blake2b(context, digest_size=16, salt=left.to_bytes(8, "little")).digest()
                    c1, c2 = int.from_bytes(mark[:8], "little", signed=True), int.from_bytes(mark[8:], "little", signed=True)
                    out.append((0, h, c1, c2, k1, k2, pos, None, None, None))
                    have = seen.get((h, c1, c2))
                    if have is None:
                        seen[h, c1, c2] = [left, context, 1]
                    else:
                        have[2] += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)
            if len(seen) > 50_000:
                yield counted()
        if seen:
            yield counted()

    return rows.mapInArrow(collect, schema)


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] equals b[:low], a[:high] doesn't
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def prefix_intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of the common-prefix intervals of a suffix array, children before parents. lcp[i]: of i - 1 and i."""
    stack: list[tuple[int, int]] = []  # depth, first
    for i in range(1, len(lcp) + 1):
        depth, first = lcp[i] if i < len(lcp) else -1, i - 1
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            yield d, first, i - 1
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def repeats(members: list[tuple[int, bytes, int]], *lengths: int) -> list[list[tuple[int, int]]]:
    """For each length, how far left and right of its anchor each member is repeated; (0, 0) where it isn't. members: left, context, count; contexts differ."""
    n = len(members)
    best = [[(0, 0)] * n for _ in lengths]
    for i, (left, context, count) in enumerate(members):
        for k, least in enumerate(lengths):
            if count > 1 and len(context) >= least:
                best[k][i] = (left, len(context) - left)
    if n == 1:
        return best
    rights = [context[left:] for left, context, _ in members]
    lefts = [context[:left][::-1] for left, context, _ in members]
    # of a repeat of the least length, half stands right of the anchor or half stands left of it
    half = (min(lengths) + 1) // 2
    for ahead, behind, swapped in ((rights, lefts, False), (lefts, rights, True)):
        alike: dict[bytes, list[int]] = {}
        for i, x in enumerate(ahead):
            if len(x) >= half:
                alike.setdefault(x[:half], []).append(i)
        for some in alike.values():
            if len(some) > 1:
                _extend(some, ahead, behind, lengths, best, swapped)
    return best


def _extend(some: list[int], ahead: list[bytes], behind: list[bytes], lengths: tuple[int, ...], best: list[list[tuple[int, int]]], swapped: bool) -> None:
    """The members' enhanced suffix array by what is ahead, its intervals, and in each the longest extensions behind."""
    if len(some) == 2:
        a, b = some
        found = [(a, b, _common(behind[a], behind[b]), _common(ahead[a], ahead[b]))]
    else:
        array = sorted(some, key=ahead.__getitem__)
        lcp = [0] + [_common(ahead[array[i - 1]], ahead[array[i]]) for i in range(1, len(array))]
        rank = {i: r for r, i in enumerate(sorted(some, key=behind.__getitem__))}
        found = []
        for depth, first, last in prefix_intervals(lcp):
            inside = sorted(array[first : last + 1], key=rank.__getitem__)
            found += [(a, b, _common(behind[a], behind[b]), depth) for a, b in zip(inside, inside[1:])]
    for a, b, back, on in found:
        left, right = (on, back) if swapped else (back, on)
        for mine, least in zip(best, lengths):
            if back + on >= least:
                for i in (a, b):
                    mine[i] = (max(mine[i][0], left), max(mine[i][1], right))


def _parts(counted: DataFrame, lengths: tuple[int, ...], parts: int) -> DataFrame:
    """kind (the place of the length), c1, c2, l, r of the neighbourhoods with repeats, from one sorted pass over each gram's."""
    names = ["kind", "c1", "c2", "l", "r"]
    schema = "kind bigint, c1 bigint, c2 bigint, l bigint, r bigint"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, group = None, {}
        out: list[tuple] = []

        def close() -> None:
            members = [(left, context, n) for left, context, n in group.values()]
            for kind, (least, found) in enumerate(zip(lengths, repeats(members, *lengths))):
                out.extend((kind, c1, c2, l, r) for (c1, c2), (l, r) in zip(group, found) if l + r >= least)
            group.clear()

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)
            out.clear()
            return batch

        for batch in batches:
            for h, c1, c2, left, context, n in zip(*(c.to_pylist() for c in batch.columns)):
                if h != current and group:
                    close()
                current = h
                have = group.get((c1, c2))
                group[c1, c2] = (left, context, n + (have[2] if have else 0))
            if out:
                yield flushed()
        if group:
            close()
        if out:
            yield flushed()

    rows = counted.select("h", "c1", "c2", "left", "context", "n").repartition(parts, "h").sortWithinPartitions("h")
    return rows.mapInArrow(scan, schema)


def _hot_parts(counted: DataFrame, least: int, gram: int, kind: int) -> DataFrame:
    """The same, of one length, by counts of window hashes: nothing of a gram is gathered."""
    schema = "w1 bigint, w2 bigint, c1 bigint, c2 bigint, left int, n bigint"

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, c1, c2, left, context, n in zip(*(c.to_pylist() for c in batch.columns)):
                out = []
                for s in range(max(0, left + least - len(context)), min(left, least - gram) + 1):  # windows that hold the gram
                    # with the gram and its place, so that a window counts once for each of its grams
                    mark = hashlib.blake2b(context[left - s : left - s + least], digest_size=16, salt=h.to_bytes(8, "little", signed=True), person=s.to_bytes(4, "little")).digest()
                    out.append((int.from_bytes(mark[:8], "little", signed=True), int.from_bytes(mark[8:], "little", signed=True), c1, c2, s, n))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [pa.int64()] * 4 + [pa.int32(), pa.int64()])], names=["w1", "w2", "c1", "c2", "left", "n"])

    whole = counted.groupBy("h", "c1", "c2").agg(F.first("left").alias("left"), F.first("context").alias("context"), F.sum("n").alias("n"))
    rows = whole.select("h", "c1", "c2", "left", "context", "n").mapInArrow(windows, schema)
    again = rows.groupBy("w1", "w2").agg(F.sum("n").alias("total")).where("total > 1")
    return rows.join(again, ["w1", "w2"], "left_semi").groupBy(F.lit(kind).cast("long").alias("kind"), "c1", "c2").agg(F.max("left").cast("long").alias("l"), (F.lit(least) - F.min("left")).cast("long").alias("r"))


def repeated_spans(docs: DataFrame, key: str, text: str, least: int = LEAST, gram: int = GRAM, split: int = SPLIT, passage: int | None = None) -> tuple[DataFrame, DataFrame]:
    """docs by __k1, __k2, and the spans (array of kind, begin, end, in bytes, unordered) of the texts that have repeats. kind 0: of ``least`` bytes; 1: of ``passage`` bytes, if asked for."""
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lengths = (least,) if passage is None else (least, passage)
    rows = _keyed(docs, key, text)
    read = cut(_anchor_rows(rows, min(lengths), gram, least if passage else None), "anchors")
    found, inner = read.where("h is not null").drop("end"), read.where("h is null").select("__k1", "__k2", "kind", F.col("pos").alias("begin"), "end")
    again = found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    per_text = found.join(again, "h", "left_semi").groupBy("__k1", "__k2").agg(F.collect_set(F.struct("h", "pos")).alias("found"), (F.max("kind") if passage else F.lit(0)).alias("spared"))
    some = rows
    if passage:  # twice the anchors, so texts that have none in common with others don't move
        per_text = cut(per_text, "found")
        some = _marked(rows, _marks(per_text)).where("__in")
    extracts = cut(_neighbourhoods(some.join(per_text, ["__k1", "__k2"]).select("__k1", "__k2", "__text", "found", "spared"), least, gram, passage), "neighbourhoods")
    counted, occurrences = extracts.where("kind = 1"), extracts.where("kind = 0")
    hot = cut(counted.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > split).select("h"), "hot")
    if hot.isEmpty():
        reach = _parts(counted, lengths, parts)
    else:
        reach = _parts(counted.join(hot, "h", "left_anti"), lengths, parts)
        for kind, length in enumerate(lengths):
            reach = reach.unionByName(_hot_parts(counted.join(hot, "h", "left_semi"), length, gram, kind))
    spans = occurrences.select("c1", "c2", "__k1", "__k2", "pos").join(reach, ["c1", "c2"]).select("__k1", "__k2", F.col("kind").cast("int"), (F.col("pos") - F.col("l")).alias("begin"), (F.col("pos") + F.col("r")).alias("end"))
    spans = spans.unionByName(inner)
    return rows, spans.groupBy("__k1", "__k2").agg(F.collect_set(F.struct("kind", "begin", "end")).alias("spans"))


def merged(spans: list[dict] | None, kind: int = 0) -> list[tuple[int, int]]:
    """The spans of one kind as runs that neither touch nor overlap."""
    out: list[list[int]] = []
    for begin, end in sorted((s["begin"], s["end"]) for s in spans or [] if s["kind"] == kind):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [(b, e) for b, e in out]


def repeat_digests(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, gram: int = GRAM, split: int = SPLIT, passage: int | None = None) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs.

    With ``passage``, also n_passages and n_passage_bytes: runs, covered by strings of so many bytes that also start anywhere
    else, of more than PASSAGE_WORDS words. They are counted, not removed.
    """
    rows, spans = repeated_spans(docs, key, text, least, gram, split, passage)
    if passage:  # texts without repeats stay where they are
        spans = cut(spans, "spans")
        rows = _marked(rows, _marks(spans))
    joined = (rows.where("__in") if passage else rows).join(spans, ["__k1", "__k2"], "left").select("__k1", "__text", "spans")
    if passage:
        joined = joined.unionByName(rows.where("NOT __in").select("__k1", "__text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")))
    names = [key, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["n_passages", "n_passage_bytes"] if passage else [])]
    kinds = [pa.int64()] * 4 + [pa.string()] + [pa.int64()] * 2
    schema = ", ".join(f"`{n}` {'string' if k == pa.string() else 'bigint'}" for n, k in zip(names, kinds))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "__text"):
            out = []
            for k, t, found in zip(*(c.to_pylist() for c in batch.columns)):
                raw, runs = t.encode(), merged(found)
                kept, at = [], 0
                for begin, end in runs:
                    kept.append(raw[at:begin])
                    at = end
                kept.append(raw[at:])
                row = (None if k == -(2**63) else k, len(raw), sum(e - b for b, e in runs), len(runs), hashlib.sha256(b"".join(kept)).hexdigest())
                if passage:
                    long = [(b, e) for b, e in merged(found, 1) if len(raw[b:e].split()) > PASSAGE_WORDS]
                    row += (len(long), sum(e - b for b, e in long))
                out.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], names=names)

    return joined.mapInArrow(digest, schema)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, gram: int = GRAM, split: int = SPLIT) -> DataFrame:
    """All rows and columns of docs, the text without its repeats (whole characters only) and n_chars, if it is there, to match."""
    _, spans = repeated_spans(docs, key, text, least, gram, split)
    whole = text_or_empty(text)
    k1, k2, held = fresh(docs, "__k1", "__k2", "__spans")
    keyed = docs.withColumns({k1: F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))), k2: F.xxhash64(whole)})
    joined = keyed.join(spans.select(F.col("__k1").alias(k1), F.col("__k2").alias(k2), F.col("spans").alias(held)), [k1, k2], "left").select(*docs.columns, held)
    schema = T.StructType(docs.schema.fields)
    place = docs.columns.index(text)
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text):
            texts = batch.column(place).to_pylist()
            changed = {}
            for i, found in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if not found or texts[i] is None:
                    continue
                raw, kept, at = texts[i].encode(), [], 0
                for begin, end in merged(found):
                    while begin < end and raw[begin] & 0xC0 == 0x80:
                        begin += 1
                    while begin < end < len(raw) and raw[end] & 0xC0 == 0x80:
                        end -= 1
                    kept.append(raw[at:begin])
                    at = max(at, end)
                kept.append(raw[at:])
                changed[i] = b"".join(kept).decode()
            columns = list(batch.columns[:-1])
            if changed:
                texts = [changed.get(i, t) for i, t in enumerate(texts)]
                columns[place] = pa.array(texts, columns[place].type)
                if count is not None:
                    sizes = columns[count].to_pylist()
                    columns[count] = pa.array([len(changed[i]) if i in changed else s for i, s in enumerate(sizes)], columns[count].type)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return joined.mapInArrow(strip, schema)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return repeat_digests(table(spark, sf_dir, "documents"), passage=PASSAGE)
