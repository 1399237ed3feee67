"""Katz backoff language model: Good-Turing discounted n-gram counts with exactly normalised backoff weights.

P(w | h) = d(r) r / C(h) for a bigram that occurs r > 0 times in training, else alpha(h) P(w); P(w) = d(r) r / N for a word that
occurs, and what the discounts leave is the probability of any unknown word. d(r) is Katz's Good-Turing discount for
r <= 5 (for as many r as the counts of counts support), 1 beyond. alpha(h) is what the discounts leave of h, over the
unigram probability of all words that don't follow h, so the probabilities of all known words and the unknown one add up to
1 after every context. A context of frequent bigrams only would leave nothing: its probabilities are scaled by C / (C + 1).
The context of a text's first token is a start mark, that of unknown and unseen words is empty (alpha = 1).

Words are 64-bit hashes (V words share one by chance in V * V / 2**65 cases). Texts are read once, into batches of local
word numbers. Each batch sends its distinct words with their counts to the words' partitions, which add them up, number
them and answer; then its distinct bigrams to the partitions of their contexts, which hold the counts of all bigrams of a
context, weigh the backoff and answer with the count of each bigram of the batch and the total and alpha of each context,
from which the batch takes the probabilities. So a frequent word or bigram moves once per batch, never once per occurrence,
a context's followers lie in one partition in compressed arrays, and no table is broadcast but one row of N, V and the
counts of counts. Parts lie by their number in partitions of their own. All is one query of four exchanges of those rows, each
written once and used again, without files of its own.

Null texts are empty: one end token. Rows with equal keys are scored, and learned from, as often as they come. Without any
training token every probability is 1. An empty table gives an empty one. Long texts are split into tokens by position
arithmetic and join one batch whole. Columns other than key and text are never read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm._common import flat_bytes, sliced, small_batches, table, text_or_empty
from plinth.llm.quality import remainder

MOST = 5  # counts up to this one are discounted
BATCH_TOKENS = 1_200_000
READ_BYTES = 1 << 20  # of texts split into words at once, but whole texts: their numbers take many times that
END_WORD = np.uint64(1)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0xA0761D6478BD642F)
_BACK = np.uint64(pow(0xA0761D6478BD642F, -1, 1 << 64))

ROW = "kind int, batch bigint, part int, a binary, b binary, c binary"
ROW_SCHEMA = pa.schema([("kind", pa.int32()), ("batch", pa.int64()), ("part", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


def _packed(values: np.ndarray, kind: type) -> bytes:
    """Little-endian numbers by byte planes, compressed: high bytes, mostly zero, take next to nothing."""
    import zstandard

    raw = np.ascontiguousarray(values, kind)
    return zstandard.compress(np.ascontiguousarray(raw.view(np.uint8).reshape(-1, raw.itemsize).T).tobytes(), 3)


def _unpacked(blob: bytes, kind: type) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.decompress(blob), np.uint8) if blob else np.zeros(0, np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ROW_SCHEMA)], schema=ROW_SCHEMA)


def _groups(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[int, list[dict]]]:
    """A partition's rows by key, in whatever order they come: sorts would take pages of the executor's heap."""
    held: dict[int, list[dict]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            held.setdefault(row[by], []).append(row)
    while held:
        yield held.popitem()


def word_hashes(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes with one end after each text, and the number of tokens of each text."""
    low = _LOWER[flat]
    n = len(low)
    # a place between texts, so that words don't run over
    text_of = np.searchsorted(at, np.arange(n), side="right") if n else np.zeros(0, np.int64)
    inside = ~_SPACE[low]
    starts = inside & np.concatenate([[True], ~inside[:-1] | (text_of[1:] != text_of[:-1])])[:n] if n else inside
    ends = inside & np.concatenate([~inside[1:] | (text_of[1:] != text_of[:-1]), [True]])[:n] if n else inside
    w0, w1 = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    powers = np.full(n + 1, _BASE, np.uint64)
    powers[0] = 1
    sums = np.concatenate([[np.uint64(0)], np.cumsum((low.astype(np.uint64) + np.uint64(1)) * np.cumprod(powers, dtype=np.uint64)[:n], dtype=np.uint64)])
    back = np.full(n + 1, _BACK, np.uint64)
    back[0] = 1
    code = (sums[w1] - sums[w0]) * np.cumprod(back, dtype=np.uint64)[w0]
    code = (code ^ (code >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    code = (code ^ (code >> np.uint64(29))) | np.uint64(2)  # 1 is the end
    sizes = np.bincount(text_of[w0] - 1, minlength=len(at) - 1) if len(w0) else np.zeros(len(at) - 1, np.int64)
    out = np.full(len(code) + len(sizes), END_WORD, np.uint64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    out[np.arange(len(code)) + doc] = code
    return out, sizes + 1


def _read(rows: DataFrame, parts: int) -> DataFrame:
    """rows: key, __held, __text. kind 0: a batch's tokens (a), sizes (b), keys and held-out marks (c), with any part. kind 1: of a part's words in it the hashes (a), training counts (b), local numbers (c)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        tokens, sizes, keys, held, total = [], [], [], [], 0

        def emit() -> pa.RecordBatch:
            nonlocal made, total
            every, size = np.concatenate(tokens), np.concatenate(sizes)
            out_of = np.array(held, bool)
            words, local = np.unique(every, return_inverse=True)
            order = np.argsort(-np.bincount(local), kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            local, words = rank[local], words[order]
            count = np.bincount(local[np.repeat(~out_of, size)], minlength=len(words))
            number = task << 32 | made
            nulls = np.array([k is None for k in keys], bool)
            ids = np.array([0 if k is None else k for k in keys], np.int64)
            out = [(0, number, (7 * task + made) % parts, _packed(local, np.uint32), _packed(size, np.uint32), _packed(np.concatenate([ids, out_of, nulls]), np.int64))]
            part_of = (words >> np.uint64(7)) % np.uint64(parts)
            by = np.argsort(part_of, kind="stable")
            bounds = np.searchsorted(part_of[by], np.arange(parts + 1, dtype=np.uint64))
            for p in range(parts):
                mine = by[bounds[p] : bounds[p + 1]]
                if len(mine):
                    mine = mine[np.argsort(words[mine])]
                    out.append((1, number, p, _packed(np.diff(words[mine], prepend=np.uint64(0)), np.uint64), _packed(count[mine], np.uint32), _packed(mine, np.uint32)))
            made, total = made + 1, 0
            for x in (tokens, sizes, keys, held):
                x.clear()
            return _rows(out)

        for batch in sliced(batches, "__text", READ_BYTES):
            found, size = word_hashes(*flat_bytes(batch.column(2)))
            tokens.append(found)
            sizes.append(size)
            keys += batch.column(0).to_pylist()
            held += batch.column(1).to_pylist()
            total += len(found)
            if total >= BATCH_TOKENS:
                yield emit()
        if tokens:
            yield emit()

    return rows.mapInArrow(read, ROW)


class Words:
    """The distinct words of a part, over all batches, with their counts in training."""

    def __init__(self, rows: list[dict]) -> None:
        self.hashes = [np.cumsum(_unpacked(r["a"], np.uint64), dtype=np.uint64) for r in rows]
        words, self.at = np.unique(np.concatenate(self.hashes), return_inverse=True)
        self.count = np.zeros(len(words), np.int64)
        np.add.at(self.count, self.at, np.concatenate([_unpacked(r["b"], np.uint32) for r in rows]).astype(np.int64))


def _number_words(read: DataFrame, parts: int) -> DataFrame:
    """kind 0: as it is. kind 2: of a batch and part the words' numbers (a), counts in training (b), local numbers (c)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, rows in _groups(batches, "part"):
            for r in rows:
                if r["kind"] == 0:
                    yield _rows([(0, r["batch"], p, r["a"], r["b"], r["c"])])
            rows = [r for r in rows if r["kind"] == 1]
            if not rows:
                continue
            words = Words(rows)
            # frequent words have small numbers, which take less room
            rank = np.empty(len(words.count), np.int64)
            rank[np.argsort(-words.count, kind="stable")] = np.arange(len(words.count))
            first = 0
            for r, h in zip(rows, words.hashes):
                mine = words.at[first : first + len(h)]
                first += len(h)
                yield _rows([(2, r["batch"], p, _packed(rank[mine] * parts + p + 1, np.uint64), _packed(words.count[mine], np.uint64), r["c"])])

    return read.mapInArrow(add, ROW)


def _sums(rows: DataFrame, of: Callable[[list[dict]], list[int]], n: int, name: str) -> DataFrame:
    """One row: the array of n sums, over the parts, of what of() gives for a part's rows; and __one, 1. Without groups they take no hash table."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _groups(batches, "part"):
            yield pa.RecordBatch.from_pydict({f"s{i}": pa.array([int(x)], pa.int64()) for i, x in enumerate(of(group))})

    summed = rows.mapInArrow(add, ", ".join(f"s{i} bigint" for i in range(n)))
    return summed.agg(F.array(*(F.coalesce(F.sum(f"s{i}"), F.lit(0)) for i in range(n))).alias(name)).withColumn("__one", F.lit(1))


def _of_words(rows: list[dict]) -> list[int]:
    """N, V and the counts of counts, of a part's words."""
    rows = [r for r in rows if r["kind"] == 1]
    if not rows:
        return [0] * (MOST + 3)
    count = Words(rows).count
    return [count.sum(), (count > 0).sum(), *_counts_of_counts(count)]


def _of_bigrams(rows: list[dict]) -> list[int]:
    return [*_counts_of_counts(Merged(rows).count)]


def _counts_of_counts(count: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(count, MOST + 2), minlength=MOST + 3)[1 : MOST + 2]


class Tokens:
    """A batch again: its texts' tokens, the numbers and counts of its words, and its distinct bigrams."""

    def __init__(self, rows: list[dict]) -> None:
        for r in rows:
            if r["kind"] == 0:
                self.local, self.size, both = _unpacked(r["a"], np.uint32).astype(np.int64), _unpacked(r["b"], np.uint32).astype(np.int64), _unpacked(r["c"], np.int64)
        n = len(self.size)
        self.keys = [None if null else k for k, null in zip(both[:n].tolist(), both[2 * n :].tolist())]
        self.held = both[n : 2 * n].astype(bool)
        words = int(self.local.max()) + 1
        self.number, self.count = np.zeros(words + 1, np.int64), np.zeros(words, np.int64)  # the last number, 0, is the start mark's
        for r in rows:
            if r["kind"] == 2:
                mine = _unpacked(r["c"], np.uint32)
                self.number[mine] = _unpacked(r["a"], np.uint64)
                self.count[mine] = _unpacked(r["b"], np.uint64)
        self.doc = np.repeat(np.arange(n), self.size)
        before = np.concatenate([[words], self.local[:-1]])
        before[np.cumsum(self.size) - self.size] = words
        pairs, self.pair_of = np.unique(before * words + self.local, return_inverse=True)
        self.first, self.second = pairs // words, pairs % words

    def dealt(self, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct bigrams by part, and where each part begins."""
        number = self.number[self.first].astype(np.uint64)
        part = ((number * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(parts)
        order = np.lexsort((self.number[self.second], number, part))
        return order, np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))


def _bigrams(tokens: DataFrame, parts: int) -> DataFrame:
    """kind 4: of a batch and a part of the contexts, the context numbers and follower numbers (a, b), training counts and the followers' counts (c)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in _groups(batches, "batch"):
            t = Tokens(rows)
            count = np.bincount(t.pair_of[np.repeat(~t.held, t.size)], minlength=len(t.first))
            order, bounds = t.dealt(parts)
            out = []
            for p in range(parts):
                mine = order[bounds[p] : bounds[p + 1]]
                if len(mine):
                    first = t.number[t.first[mine]]
                    out.append((4, number, p, _packed(np.diff(first, prepend=0), np.int64), _packed(t.number[t.second[mine]], np.uint64), _packed(np.concatenate([count[mine], t.count[t.second[mine]]]), np.uint64)))
            yield _rows(out)

    return tokens.mapInArrow(deal, ROW)


class Merged:
    """The distinct bigrams of a part, over all batches, with their counts in training."""

    def __init__(self, rows: list[dict]) -> None:
        self.batches = [r["batch"] for r in rows]
        first = [np.cumsum(_unpacked(r["a"], np.int64)) for r in rows]
        second = [_unpacked(r["b"], np.uint64).astype(np.int64) for r in rows]
        counts = [_unpacked(r["c"], np.uint64).astype(np.int64).reshape(2, -1) for r in rows]
        self.sizes = [len(f) for f in first]
        one, two = np.concatenate(first), np.concatenate(second)
        seen, follower = np.concatenate([c[0] for c in counts]), np.concatenate([c[1] for c in counts])
        del first, second, counts
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
        group = np.cumsum(new) - 1
        self.at = np.empty(len(order), np.int64)
        self.at[order] = group
        self.context = one[new]
        self.follower = follower[order[new]]
        del one, two, follower, new
        self.count = np.bincount(group, weights=seen[order], minlength=len(self.context)).astype(np.int64)


def discounts(counts_of_counts: np.ndarray) -> np.ndarray:
    """d(0), d(1), ... d(MOST): Katz's, for as many r as the counts of counts give values between 0 and 1; 1 beyond. counts_of_counts: of r = 1 to MOST + 1."""
    n = np.concatenate([[0.0], counts_of_counts.astype(float)])
    for most in range(MOST, 0, -1):
        if (n[1 : most + 2] <= 0).any():
            continue
        common = (most + 1) * n[most + 1] / n[1]
        r = np.arange(1, most + 1)
        d = ((r + 1) * n[2 : most + 2] / n[1 : most + 1] / r - common) / (1 - common) if common != 1 else np.zeros(most)
        if ((d > 0) & (d < 1)).all():
            return np.concatenate([[1.0], d, np.ones(MOST - most)])
    return np.concatenate([[1.0, 0.5], np.ones(MOST - 1)])


class Unigrams:
    def __init__(self, total: int, words: int, counts_of_counts: np.ndarray) -> None:
        self.total, self.words = total, words
        self.d = discounts(counts_of_counts)
        r = np.arange(1, MOST + 1)
        left = float(((1 - self.d[1:]) * r * counts_of_counts[:MOST]).sum()) / max(1, total)
        self.scale = 1.0 if left > 0 else total / (total + 1)
        self.unknown = left if left > 0 else 1 / (total + 1)

    @classmethod
    def of(cls, sums: np.ndarray) -> Unigrams:
        """From what _of_words gives, over all parts."""
        return cls(int(sums[0]), int(sums[1]), sums[2:])

    def probability(self, count: np.ndarray) -> np.ndarray:
        known = self.scale * self.d[np.minimum(count, MOST + 1) * (count <= MOST)] * count / max(1, self.total)
        return np.where(count > 0, known, self.unknown)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (self.total + self.words + 1))


def discounted(count: np.ndarray, d: np.ndarray) -> np.ndarray:
    return d[np.minimum(count, MOST + 1) * (count <= MOST)] * count


def backoff(context: np.ndarray, follower: np.ndarray, count: np.ndarray, d: np.ndarray, unigrams: Unigrams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of bigrams sorted by context: where each context begins, what divides the discounted counts, and alpha. follower: the followers' counts in training, count: the bigrams'."""
    starts = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    lower = unigrams.probability(follower)
    kept = discounted(count, d)
    total = np.add.reduceat(count, starts).astype(float)
    left = total - np.add.reduceat(kept, starts)
    none = (left <= 1e-9 * np.maximum(1, total)) & (total > 0)
    left = np.where(none, 1 / (total + 1), left / np.maximum(1, total))
    others = 1 - np.add.reduceat(np.where(count > 0, lower, 0), starts)
    return starts, np.where(none, total + 1, np.maximum(1, total)), np.where(total > 0, left / np.maximum(others, 1e-300), 1.0)


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", modulus: int = 7, held_out: int = 2) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs. A part of docs that is read again, after a lost executor, must give its rows in the same order, as files do."""
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(key).cast("long"), (remainder(key, modulus) == held_out).alias("__held"), text_or_empty(text).alias("__text"))
    read = _read(rows, parts).repartitionById(parts, "part")
    dealt = _number_words(read, parts).repartition(parts, "batch")
    bigrams = _bigrams(dealt, parts).repartitionById(parts, "part")
    # the same exchanges serve the sums and, with them, the probabilities
    with_sums = bigrams.withColumn("__one", F.lit(1))
    for one in (_sums(read, _of_words, MOST + 3, "words"), _sums(bigrams, _of_bigrams, MOST + 1, "n")):
        with_sums = with_sums.join(F.broadcast(one), "__one")
    with_sums = with_sums.drop("__one")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, group in _groups(batches, "part"):
            merged = Merged(group)
            d, sums = discounts(np.array(group[0]["n"])), np.array(group[0]["words"])
            unigrams = Unigrams.of(sums)
            starts, divisor, alpha = backoff(merged.context, merged.follower, merged.count, d, unigrams)
            context_of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(merged.context))))
            first = 0
            for batch, size in zip(merged.batches, merged.sizes):
                mine = merged.at[first : first + size]
                own = context_of[mine]
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
                yield _rows([(5, batch, p, _packed(np.concatenate([sums, merged.count[mine]]), np.uint64), _packed(np.concatenate([[len(d)], d, divisor[own]]), np.float64), _packed(alpha[own], np.float64))])
                first += size

    answers = with_sums.mapInArrow(answer, ROW)
    schema = f"`{key}` bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"

    def score(tokens: pa.Table, replies: pa.Table) -> pa.Table:
        t = Tokens(tokens.to_pylist())
        n = len(t.size)
        order, bounds = t.dealt(parts)
        logs = np.zeros(len(order))
        for r in replies.to_pylist():
            mine = order[bounds[r["part"]] : bounds[r["part"] + 1]]
            seen, head, alpha = _unpacked(r["a"], np.uint64).astype(np.int64), _unpacked(r["b"], np.float64), _unpacked(r["c"], np.float64)
            unigrams, seen = Unigrams.of(seen[: MOST + 3]), seen[MOST + 3 :]
            d, divisor = head[1 : 1 + int(head[0])], head[1 + int(head[0]) :]
            first = t.number[t.first[mine]]
            of = np.cumsum(np.concatenate([[False], first[1:] != first[:-1]]))
            logs[mine] = np.log10(np.where(seen > 0, discounted(seen, d) / divisor[of], alpha[of] * unigrams.probability(t.count[t.second[mine]])))
        counts = t.count[t.local]
        return pa.table(
            {
                key: pa.array(t.keys, pa.int64()),
                "held_out": pa.array(t.held),
                "n_tokens": pa.array(t.size),
                "n_known": pa.array(np.bincount(t.doc, weights=counts > 0, minlength=n).astype(np.int64)),
                "train_tokens": pa.array(np.full(n, unigrams.total, np.int64)),
                "base_score": pa.array(np.bincount(t.doc, weights=unigrams.base(counts), minlength=n)),
                "score": pa.array(np.bincount(t.doc, weights=logs[t.pair_of], minlength=n)),
            }
        )

    # the batches' exchange serves again: only the answers move to them; scores are few bytes a text and go into few files
    return dealt.groupBy("batch").cogroup(answers.repartition(parts, "batch").groupBy("batch")).applyInArrow(score, schema).hint("rebalance")


def op1_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    return score_texts(table(spark, sf_dir, "documents"))
