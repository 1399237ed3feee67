"""Near duplicates: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity.

A text's words are its lower-cased (A-Z) runs of bytes above white space; its shingles are its runs of ``words`` words (all
of them, if it has fewer). A shingle weighs its count in the text times an inverse document frequency between 1 and 2; the
frequencies of all documents are counted in DF_SLOTS hashed counters, a table of fixed size. Each of ROWS x BANDS samples
draws a shingle and a level such that two texts draw the same ones with a probability equal to their weighted Jaccard
similarity (Ioffe 2010). Texts that agree on all samples of a band are candidates: at similarity 0.8, 99.98 % of the pairs.

Texts with equal words are one node from the start, however many. In each bucket of a band all nodes are compared with one
pivot, not with each other. Those that aren't similar to it are held against all others of the bucket by their samples alone,
and each is paired with the two that agree best of every cluster that the bucket has so far, so that copies give a few pairs
each. These picks may fail while another member would pass. So a bucket that still holds several clusters of verified links
is looked through: the nodes of each are held against those of the others, best agreement first, until a pair is similar,
which joins the two clusters, or none is left. Copies are one cluster by then and aren't held against each other. Buckets of
more than ``most_bucket`` nodes get their first picks among nodes that share another band too (a similar pair shares six more
on average); they are looked through whole, in blocks, each against each, so pairs that share one band alone are met as well.
A pair is verified by the exact weighted Jaccard similarity of its texts, if its samples agree often enough that it may reach
the threshold at all (four standard deviations below it). Classes are the connected components of the verified links.

Null texts are empty; texts without words are all equal. Rows repeat as often as they come, in one class. Ties: of a class the
row with the least key stays, of equal keys that with the least text id. An empty table has no classes. Long texts are shingled
whole, a megabyte of texts at a time or one text. keep_one keeps all columns, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm._common import cut, fresh, sliced, small_batches, table, text_or_empty
from plinth.llm._graph import components

WORDS, THRESHOLD, ROWS, BANDS = 5, 0.8, 3, 12
DF_SLOTS, DF_SLICES = 1 << 18, 16
LEVELS = 1 << 14
MOST_BUCKET = 20_000
#: Shingles of one bucket that a worker keeps at a time, 16 bytes each.
KEPT_SHINGLES = 8 << 20

_BASE = np.uint64(0x8CB92BA72F3D8DD7)
_BACK = np.uint64(pow(0x8CB92BA72F3D8DD7, -1, 1 << 64))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def normal(text: str) -> bytes:
    """The words, one space between them."""
    return b" ".join(text.encode().lower().split())


def text_id(words: bytes) -> int:
    """64 bits of a digest: of n different texts about n * n / 2**65 pairs share one by chance."""
    return int.from_bytes(hashlib.blake2b(words, digest_size=8).digest(), "little", signed=True)


def shingles(raws: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, hash and count of each distinct shingle of normal texts, by document."""
    flat = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    n = len(flat)
    ends = np.cumsum([len(r) + 1 for r in raws])
    inside = flat != 32
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    w0, w1 = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(w0):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * _powers(n, _BASE)[:n], dtype=np.uint64)])
    word = _mix((sums[w1] - sums[w0]) * _powers(n, _BACK)[w0])
    doc = np.searchsorted(ends, w0, side="right")
    first = np.searchsorted(doc, doc, side="left")
    last = np.searchsorted(doc, doc, side="right")
    at = np.arange(len(doc))
    use = (at + words <= last) | (at == first)
    at = at[use]
    code = np.zeros(len(at), np.uint64)
    for j in range(words):
        there = at + j < last[at]
        code = code * np.uint64(0x9E3779B97F4A7C15) + np.where(there, word[np.minimum(at + j, len(word) - 1)], np.uint64(0)) + np.uint64(1)
    code, doc = _mix(code), doc[at]
    order = np.lexsort((code, doc))
    code, doc = code[order], doc[order]
    new = np.concatenate([[True], (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])])
    starts = np.flatnonzero(new)
    return doc[starts], code[starts], np.diff(np.append(starts, len(code)))


@lru_cache(maxsize=1)
def gamma_levels() -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution at LEVELS midpoints."""
    p = (np.arange(LEVELS) + 0.5) / LEVELS
    x = np.where(p < 0.5, np.sqrt(2 * p), 2 - np.log(1 - p))
    for _ in range(60):
        x = np.maximum(1e-9, x - (1 - (1 + x) * np.exp(-x) - p) / np.maximum(1e-12, x * np.exp(-x)))
    return x


def samples(doc: np.ndarray, code: np.ndarray, weight: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """The documents that have shingles, and the 32-bit codes of their samples, (documents, number)."""
    starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    out = np.zeros((len(starts), number), np.uint32)
    if not len(starts):
        return doc[:0], out
    r_of = gamma_levels()
    log_c = np.log(r_of)
    sizes = np.diff(np.append(starts, len(doc)))
    log_w = np.log(weight)
    mask = np.uint64(LEVELS - 1)
    for k in range(number):
        u = _mix(code + np.uint64((0x632BE59BD9B4E019 * (k + 1)) & (2**64 - 1)))
        r = r_of[(u & mask).astype(np.int32)]
        beta = (u >> np.uint64(32)).astype(np.float64) * 2.0**-32
        t = np.floor(log_w / r + beta)
        a = log_c[((u >> np.uint64(14)) & mask).astype(np.int32)] - r * (t - beta + 1)
        least = np.minimum.reduceat(a, starts)
        hits = np.flatnonzero(a == np.repeat(least, sizes))
        pick = hits[np.searchsorted(hits, starts)]
        out[:, k] = (_mix(code[pick] + t[pick].astype(np.int64).view(np.uint64) * _BASE) >> np.uint64(32)).astype(np.uint32)
    return doc[starts], out


def idf(counts: np.ndarray, documents: int) -> np.ndarray:
    """1 for a counter that every document has, 2 for an empty one."""
    return 1 + np.clip(np.log((documents + 1) / (counts + 1)) / np.log(documents + 2), 0, 1)


def document_frequencies(docs: DataFrame, text: str, words: int) -> tuple[np.ndarray, int]:
    """Hashed counters of the documents that hold a shingle, and the number of documents. DF_SLOTS numbers reach the driver."""
    rows = docs.select(text_or_empty(text).alias("__text"))
    width = DF_SLOTS // DF_SLICES
    names = ["part", "counts", "n"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(DF_SLOTS, np.int64), 0
        for batch in sliced(batches, "__text", 2 << 20):
            raws = [normal(t) for t in batch.column(0).to_pylist()]
            _, code, _ = shingles(raws, words)
            counts += np.bincount((code % np.uint64(DF_SLOTS)).astype(np.int64), minlength=DF_SLOTS)
            n += len(raws)
        if n:
            blobs = [counts[i * width : (i + 1) * width].tobytes() for i in range(DF_SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(DF_SLICES), pa.int32()), pa.array(blobs, pa.binary()), pa.array([n] + [0] * (DF_SLICES - 1), pa.int64())], names=names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for part, blob, n in zip(*(c.to_pylist() for c in batch.columns)):
                have = sums.setdefault(part, [np.zeros(width, np.int64), 0])
                have[0] += np.frombuffer(blob, np.int64)
                have[1] += n
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([c.tobytes() for c, _ in sums.values()], pa.binary()), pa.array([n for _, n in sums.values()], pa.int64())], names=names)

    schema = "part int, counts binary, n bigint"
    found = rows.mapInArrow(count, schema).repartition(DF_SLICES, "part").mapInArrow(add, schema).collect()
    counts, n = np.zeros(DF_SLOTS, np.int64), 0
    for r in found:
        counts[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r["counts"], np.int64)
        n += r["n"]
    return counts, n


def signatures(docs: DataFrame, key: str, text: str, weights, words: int, rows_: int, bands: int) -> DataFrame:
    """__key, t (text id), codes and band hashes of every row. weights: broadcast idf."""
    rows = docs.select(F.col(key).cast("long").alias("__key"), text_or_empty(text).alias("__text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = weights.value
        for batch in sliced(batches, "__text", 1 << 20):
            raws = [normal(t) for t in batch.column(1).to_pylist()]
            doc, code, count = shingles(raws, words)
            weight = count * table_[(code % np.uint64(DF_SLOTS)).astype(np.int64)]
            have, codes = samples(doc, code, weight, rows_ * bands)
            every = np.zeros((len(raws), rows_ * bands), np.uint32)
            every[have] = codes
            hashes = np.zeros((len(raws), bands), np.uint64)
            for j in range(rows_):
                hashes = _mix(hashes * _BASE + every[:, j::rows_][:, :bands].astype(np.uint64) + np.uint64(1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([text_id(r) for r in raws], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, every.size + 1, rows_ * bands), pa.int32()), pa.array(every.view(np.int32).ravel())),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, hashes.size + 1, bands), pa.int32()), pa.array(hashes.view(np.int64).ravel())),
                ],
                names=["__key", "t", "codes", "bands"],
            )

    return rows.mapInArrow(sign, "__key bigint, t bigint, codes array<int>, bands array<bigint>")


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of (sorted hashes, weights). Two texts without shingles are equal."""
    (ha, wa), (hb, wb) = a, b
    if not len(ha) or not len(hb):
        return float(len(ha) == len(hb))
    at = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
    both = hb[at] == ha
    shared = float(np.minimum(wa[both], wb[at[both]]).sum())
    return shared / (float(wa.sum()) + float(wb.sum()) - shared)


def _verified(pairs: DataFrame, texts: DataFrame, weights, words: int, threshold: float) -> DataFrame:
    """a, b, similarity of the pairs that reach the threshold. texts: t, words of every node."""
    joined = pairs.join(texts.select(F.col("t").alias("b"), F.col("words").alias("wb")), "b").join(texts.select(F.col("t").alias("a"), F.col("words").alias("wa")), "a").select("a", "b", "wa", "wb")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = weights.value
        known: dict[int, tuple] = {}
        for batch in sliced(batches, "wb", 1 << 20):
            out = []
            for a, b, wa, wb in zip(*(c.to_pylist() for c in batch.columns)):
                if a not in known:
                    known.clear()
                    known[a] = _vector(wa, table_, words)
                s = weighted_jaccard(known[a], _vector(wb, table_, words))
                if s >= threshold:
                    out.append((a, b, s))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "similarity"])

    return joined.mapInArrow(verify, "a bigint, b bigint, similarity double")


def _vector(raw: bytes, table_: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    _, code, count = shingles([raw], words)
    return code, count * table_[(code % np.uint64(DF_SLOTS)).astype(np.int64)]


def bucket_pairs(ids: list[int], codes: np.ndarray, least: int, linked: int = 1) -> list[tuple[int, int]]:
    """Pairs of a bucket that may be similar: each member with the two members before it that agree best, of every cluster so far.

    The first ``linked`` members are one cluster already. Clusters are those that the pairs themselves make, so a group of copies of n members gives 2 n pairs at most, while a
    member that joins several clusters is paired with all of them.
    """
    n, pairs = len(ids), []
    label = np.arange(n)
    label[:linked] = 0
    for i in range(max(1, linked), n):
        agreed = (codes[:i] == codes[i]).sum(axis=1)
        near = np.flatnonzero(agreed >= least)
        if not len(near):
            continue
        near = near[np.argsort(-agreed[near], kind="stable")]
        clusters, best = np.unique(label[near], return_index=True)
        others = np.delete(near, best)
        second = others[np.unique(label[others], return_index=True)[1]]
        pairs += [(ids[j], ids[i]) for j in [*near[best].tolist(), *second.tolist()]]
        label[i] = clusters[0]
        for c in clusters[1:].tolist():
            label[label == c] = clusters[0]
    return pairs


def _first_picks(left: DataFrame, nodes: DataFrame, least: int, most: int, parts: int) -> DataFrame:
    """a, b of the pairs that the buckets (band, bucket, t, linked) propose; linked: to the bucket's pivot. Buckets of more than ``most`` nodes are taken apart by the nodes' other bands first."""
    sizes = left.groupBy("band", "bucket").agg(F.count("*").alias("n"))
    keyed = left.join(sizes.where("n > 1"), ["band", "bucket"]).withColumn("g", F.xxhash64("band", "bucket"))
    small, large = keyed.where(F.col("n") <= most).select("g", "t", "linked"), keyed.where(F.col("n") > most)
    apart = large.join(nodes.select("t", "bands"), "t").select("g", "band", "t", "linked", F.posexplode("bands").alias("band2", "bucket2")).where("band2 <> band")
    groups = small.unionByName(apart.select(F.xxhash64("g", "band2", "bucket2").alias("g"), "t", "linked"))
    rows = groups.join(nodes.select("t", "codes"), "t").select("g", "t", "linked", "codes").repartition(parts, "g").sortWithinPartitions("g", F.desc("linked"), "t")

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, codes, linked = None, [], [], 0
        out: list[tuple[int, int]] = []

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])
            out.clear()
            return batch

        for batch in batches:
            g_, t_, l_ = (batch.column(i).to_pylist() for i in range(3))
            flat = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            width = len(flat) // max(1, len(g_))
            block = flat.reshape(len(g_), width)
            for k, (g, t, l) in enumerate(zip(g_, t_, l_)):
                if g != current:
                    if len(ids) > max(1, linked):
                        out.extend(bucket_pairs(ids, np.stack(codes), least, linked))
                    current, ids, codes, linked = g, [], [], 0
                ids.append(t)
                linked += l
                codes.append(block[k])
            if out:
                yield flushed()
        if len(ids) > max(1, linked):
            out.extend(bucket_pairs(ids, np.stack(codes), least, linked))
        if out:
            yield flushed()

    pairs = rows.mapInArrow(propose, "a bigint, b bigint")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def open_pairs(codes: np.ndarray, label: np.ndarray, least: int, band: int, rows_: int, side: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Each member of a bucket with the members before it that it has still to be held against, best first.

    These are of other clusters (``label``), agree on ``least`` samples or more and share no band before the bucket's: there
    the pair is met already. Labels may change between the steps. Members of the largest cluster come first and are passed over.
    Where there are two sides, members of one aren't held against each other.
    """
    n, before = len(codes), band * rows_
    if side is None or (side == side[0]).all():
        kinds, size = np.unique(label, return_counts=True)
        order = np.argsort(label != kinds[size.argmax()], kind="stable")
        first, whole = int(size.max()), True
    else:
        # the larger side comes first
        order = np.argsort(side != (2 * side.sum() > n), kind="stable")
        first, whole = int(max(side.sum(), n - side.sum())), False
    codes = codes[order]
    for x in range(first, n):
        i = int(order[x])
        to = x if whole else first
        same = codes[:to] == codes[x]
        near = np.flatnonzero((same.sum(axis=1) >= least) & (label[order[:to]] != label[i]))
        if before and len(near):
            near = near[~same[near, :before].reshape(len(near), band, rows_).all(axis=2).any(axis=1)]
        if len(near):
            yield i, order[near[np.argsort(-same[near].sum(axis=1), kind="stable")]]


def bucket_links(raws: list[bytes], codes: np.ndarray, label: np.ndarray, least: int, band: int, rows_: int, table_: np.ndarray, words: int, threshold: float, side: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """Members of a bucket that are similar, and how much: clusters grow by verified pairs only, and two clusters are held apart only when all their open pairs have failed."""
    label, out = label.copy(), []
    vectors: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    held = 0

    def vector(k: int) -> tuple[np.ndarray, np.ndarray]:
        nonlocal held
        if k not in vectors:
            if held > KEPT_SHINGLES:
                vectors.clear()
                held = 0
            vectors[k] = _vector(raws[k], table_, words)
            held += len(vectors[k][0])
        return vectors[k]

    for i, near in open_pairs(codes, label, least, band, rows_, side):
        mine = vector(i)
        at, step = 0, 4
        while at < len(near):
            some = near[at : at + step]
            at, step = at + step, min(2 * step, 64)
            for j in some[label[some] != label[i]].tolist():
                if label[j] == label[i]:
                    continue
                s = weighted_jaccard(mine, vector(j))
                if s >= threshold:
                    out.append((i, j, s))
                    label[label == label[j]] = label[i]
    return out


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """The runs of rows that are equal in the first ``keys`` columns."""
    current, some = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = list(zip(*(batch.column(i).to_pylist() for i in range(keys))))
        first = 0
        for k in range(1, len(marks) + 1):
            if k == len(marks) or marks[k] != marks[first]:
                if marks[first] != current:
                    if some:
                        yield current, some
                    current, some = marks[first], []
                some.append(batch.slice(first, k - first))
                first = k
    if some:
        yield current, some


def _columns(some: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text ids, labels (0, 1, ...), sides and codes of a group's rows (g, band, t, root, side, codes, ...)."""
    t, root, side = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in some]) for i in (2, 3, 4))
    codes = np.concatenate([b.column(5).flatten().to_numpy(zero_copy_only=False) for b in some])
    return t, np.unique(root, return_inverse=True)[1], side, codes.reshape(len(t), -1)


def _bucket_rows(left: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """g, band, t, root, side, codes of the buckets (band, bucket, t, root) that hold several clusters, each in groups that meet all pairs of different clusters.

    A bucket of ``most`` nodes or fewer is one group. Of a larger one the nodes of its largest cluster (which aren't held
    against each other) and all others are dealt into blocks of half as many: each block of the others is a group by itself,
    and with each other block, of either kind, a group of two sides. So no pair is left out, and a group holds about ``most``
    nodes. A bucket of n nodes, m of them outside its largest cluster, takes n * m comparisons, as a whole bucket would.
    """
    clusters = left.groupBy("band", "bucket", "root").agg(F.count("*").alias("n"))
    sizes = clusters.groupBy("band", "bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("clusters"))
    keyed = left.join(sizes.where("clusters > 1").drop("clusters"), ["band", "bucket"]).withColumn("g", F.xxhash64("band", "bucket"))
    small, large = keyed.where(F.col("n") <= most), keyed.where(F.col("n") > most)
    half = max(1, most // 2)
    blocks = large.withColumns({"tops": F.ceil(F.col("top.n") / half).cast("int"), "rests": F.ceil((F.col("n") - F.col("top.n")) / half).cast("int"), "is_top": F.col("root") == F.col("top.root")})
    blocks = blocks.withColumn("k", F.pmod(F.xxhash64("t"), F.when(F.col("is_top"), F.col("tops")).otherwise(F.col("rests"))).cast("int"))
    with_tops = "transform(sequence(0, tops - 1), j -> struct(0 AS kind, k AS p, j AS q, 0 AS side))"
    with_rests = "transform(sequence(0, rests - 1), j -> struct(1 AS kind, least(k, j) AS p, greatest(k, j) AS q, int(k > j) AS side))"
    of_top = "transform(sequence(0, rests - 1), j -> struct(0 AS kind, j AS p, k AS q, 1 AS side))"
    met = blocks.select("g", "band", "t", "root", F.explode(F.expr(f"if(is_top, {of_top}, concat({with_tops}, {with_rests}))")).alias("at"))
    groups = small.select("g", "band", "t", "root", F.lit(0).alias("side")).unionByName(met.select(F.xxhash64("g", "at.kind", "at.p", "at.q").alias("g"), "band", "t", "root", "at.side"))
    return groups.join(nodes.select("t", "codes"), "t").select("g", "band", "t", "root", "side", "codes")


def _bucket_links(left: DataFrame, nodes: DataFrame, texts: DataFrame, weights, words: int, threshold: float, least: int, rows_: int, most: int, parts: int) -> DataFrame:
    """a, b, similarity of the similar pairs that join clusters of a bucket; only the texts of nodes that have an open pair travel, to the bucket of its first shared band."""
    rows = _bucket_rows(left, nodes, most)
    sorted_ = lambda df: df.repartition(parts, "g").sortWithinPartitions("g", "t")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (g, band), some in _grouped(batches, 2):
            t, label, side, codes = _columns(some)
            use = np.zeros(len(t), bool)
            for i, near in open_pairs(codes, label, least, band, rows_, side):
                use[i] = True
                use[near] = True
            if use.any():
                yield pa.Table.from_batches(some).combine_chunks().to_batches()[0].take(pa.array(np.flatnonzero(use)))

    schema = "g bigint, band int, t bigint, root bigint, side int, codes array<int>"
    wanted = cut(sorted_(rows).mapInArrow(look, schema), "open")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = weights.value
        for (g, band), some in _grouped(batches, 2):
            t, label, side, codes = _columns(some)
            raws = [w for b in some for w in b.column(6).to_pylist()]
            found = bucket_links(raws, codes, label, least, band, rows_, table_, words, threshold, side)
            if found:
                a, b, s = (np.array(c) for c in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(t[a], t[b])), pa.array(np.maximum(t[a], t[b])), pa.array(s)], names=["a", "b", "similarity"])

    whole = wanted.join(texts, "t").select("g", "band", "t", "root", "side", "codes", "words")
    return sorted_(whole).mapInArrow(verify, "a bigint, b bigint, similarity double")


def _links(nodes: DataFrame, texts_of, weights, words: int, threshold: float, rows_: int, bands: int, most_bucket: int) -> DataFrame | None:
    """Verified links of the nodes (t, codes, bands); None if there is no candidate."""
    parts = max(1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    buckets = nodes.select("t", F.posexplode("bands").alias("band", "bucket"))
    number = rows_ * bands
    least = max(1, int(np.floor(number * threshold - 4 * np.sqrt(number * threshold * (1 - threshold)))))
    agreed = F.aggregate(F.zip_with("ca", "cb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    codes = nodes.select("t", "codes")
    # a pivot for each bucket of two nodes or more
    pivots = buckets.groupBy("band", "bucket").agg(F.min("t").alias("p"), F.count("*").alias("n")).where("n > 1").select("band", "bucket", "p")
    tried = cut(buckets.join(pivots, ["band", "bucket"]).where("p <> t"), "buckets")
    if tried.isEmpty():
        return None
    texts = texts_of(tried.select("t").unionByName(tried.select(F.col("p").alias("t"))).distinct())
    pairs = tried.select(F.col("p").alias("a"), F.col("t").alias("b")).distinct()
    near = pairs.join(codes.select(F.col("t").alias("b"), F.col("codes").alias("cb")), "b").join(codes.select(F.col("t").alias("a"), F.col("codes").alias("ca")), "a").where(agreed >= least)
    stars = cut(_verified(near.select("a", "b"), texts, weights, words, threshold), "links")
    # a bucket where a node isn't similar to the pivot is looked through: first that node with its best picks of all others, linked ones too
    linked = tried.join(stars.select(F.col("a").alias("p"), F.col("b").alias("t"), F.lit(1).alias("linked")), ["p", "t"], "left").select("band", "bucket", "p", "t", F.coalesce("linked", F.lit(0)).alias("linked"))
    open_ = linked.where("linked = 0").select("band", "bucket", "p").distinct()
    failed = linked.drop("p").join(open_.select("band", "bucket"), ["band", "bucket"], "left_semi").unionByName(open_.select("band", "bucket", F.col("p").alias("t"), F.lit(1).alias("linked")))
    picks = _verified(_first_picks(failed, nodes, least, most_bucket, parts), texts, weights, words, threshold)
    links = cut(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity").unionByName(picks).dropDuplicates(["a", "b"]), "links")
    # then, where a bucket still holds several clusters of verified links, all that the picks left out
    roots = cut(components(links.select("a", "b")), "clusters").withColumnRenamed("node", "t")
    left = failed.select("band", "bucket", "t").join(roots, "t", "left").withColumn("root", F.coalesce("root", "t"))
    rest = _bucket_links(left, nodes, texts, weights, words, threshold, least, rows_, most_bucket, parts)
    return cut(links.unionByName(rest).dropDuplicates(["a", "b"]), "links")


def lowest(key, name: str = "least"):
    """The key, a null one as the lowest number."""
    return F.coalesce(key, F.lit(-(2**63))).alias(name)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD, rows_: int = ROWS, bands: int = BANDS, most_bucket: int = MOST_BUCKET) -> DataFrame:
    """__key, t, class_id, links, root, first for every row of docs.

    class_id: the least key of the row's class. root: the class itself, the least text id in it; classes of texts with null or
    repeated keys may share class_id, never root. first: whether the row is the one of its class that stays, that with the
    least key and of these the least text id (rows that are equal in both stand for each other).
    """
    spark = docs.sparkSession
    counts, documents = document_frequencies(docs, text, words)
    weights = spark.sparkContext.broadcast(idf(counts, documents))  # DF_SLOTS doubles
    signed = cut(signatures(docs, key, text, weights, words, rows_, bands), "signatures")
    nodes = signed.groupBy("t").agg(F.min("__key").alias("least"), F.first("codes").alias("codes"), F.first("bands").alias("bands"))

    def texts_of(wanted: DataFrame) -> DataFrame:
        """t and words of the wanted nodes, from the row with each node's least key."""
        source = nodes.select("t", lowest("least")).join(wanted, "t", "left_semi")
        rows = docs.select(lowest(F.col(key).cast("long"), "least"), text_or_empty(text).alias("__text"))

        def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, "__text"):
                raws = [normal(t) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([text_id(r) for r in raws], pa.int64()), pa.array(raws, pa.binary())], names=["least", "t", "words"])

        # by key and text: a key may have many texts
        return cut(rows.mapInArrow(words_of, "least bigint, t bigint, words binary").join(source, ["least", "t"]).dropDuplicates(["t"]).select("t", "words"), "texts")

    links = _links(nodes, texts_of, weights, words, threshold, rows_, bands, most_bucket)
    rows = signed.select("__key", "t")
    if links is None:
        member, degree = nodes.select("t", "least", F.col("t").alias("root")), None
    else:
        roots = cut(components(links.select("a", "b")), "components")
        member = nodes.select("t", "least").join(roots.withColumnRenamed("node", "t"), "t", "left").withColumn("root", F.coalesce("root", "t"))
        degree = links.select(F.col("a").alias("t")).unionByName(links.select(F.col("b").alias("t"))).groupBy("t").agg(F.count("*").alias("links"))
    # a null key is above all others here
    ranked = member.select("root", F.struct(F.col("least").isNull().alias("none"), "least", "t").alias("by"))
    classes = ranked.groupBy("root").agg(F.min("by").alias("by")).select("root", F.col("by.least").alias("class_id"), F.col("by.t").alias("keeper"))
    of_node = member.join(classes, "root")
    of_node = of_node.withColumn("links", F.lit(0)) if degree is None else of_node.join(degree, "t", "left")
    of_node = of_node.select("t", "class_id", F.coalesce("links", F.lit(0)).cast("long").alias("links"), "root", "keeper")
    return rows.join(of_node, "t").select("__key", "t", "class_id", "links", "root", (F.col("__key").eqNullSafe(F.col("class_id")) & (F.col("t") == F.col("keeper"))).alias("first"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("__key").alias("doc_id"), "class_id", F.col("links").alias("n_links"), F.col("first").alias("is_kept"), F.col("root").alias("class_text"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows and columns of docs, one row of each class: that with the least key."""
    found = cut(near_duplicates(docs, key, text), "classes")
    chosen = found.where("first").select(F.col("__key").alias("k"), "t")
    repeated = not found.groupBy("__key").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    own, mark = fresh(docs, "__key", "__t")
    rows = docs.withColumn(own, lowest(F.col(key).cast("long"), own))
    if not repeated:
        return rows.join(chosen.select(lowest(F.col("k"), own)), own).select(*docs.columns)
    # rows are known by key and text; those that are equal in both are one
    rows = rows.withColumn(mark, F.lit(0).cast("long"))
    place = rows.columns.index(text)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text):
            ids = pa.array([text_id(normal(t or "")) for t in batch.column(place).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], names=batch.schema.names)

    kept = rows.mapInArrow(marked, rows.schema).join(chosen.select(lowest(F.col("k"), own), F.col("t").alias(mark)).distinct(), [own, mark])
    return kept.dropDuplicates([own, mark]).select(*docs.columns)
