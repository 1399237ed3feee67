"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line of a text gets byte-level features (length, shares of symbols, pipes, capitals, digits and punctuation, word
length, immediate word repetitions) and those of the lines beside it. The field labels each line good or bad; its weights
and transitions are fitted by gradient ascent on the conditional likelihood, with a document's label on all its lines. The
forward-backward marginals of the lines, weighted by their length, make the document's quality, which a logistic curve
fitted on the same sample turns into a score. Forward and backward passes are segmented prefix products of 2 x 2 matrices,
so one document of a million lines costs no more than many short ones.

The fit takes at most ``most_docs`` labelled documents, those with the smallest hash of their key, in that order as long as
they have ``most_lines`` lines together, each with all its lines; only their line features reach the driver. Scoring reads
every line of every text. Labels are of documents: a first fit gives all lines their document's label, a second one takes
the lines of bad documents that look good for themselves for good ones, except each document's worst, so that the
transitions learn changes within a document.

Null and empty texts have one empty line. Without labels, or with labels of one class only, the score of every row is that
class's share (0.5 without any). Rows repeat as often as they come; null keys are never labelled, of a key that has several
labels the greater one counts, of several texts under one labelled key any one is read. Empty tables give empty ones.
Columns of docs keep their names whatever these are.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.llm._common import flat_bytes, fresh, sliced, small_batches, table, text_or_empty

MOST_DOCS, MOST_LINES, ROUNDS = 1500, 200_000, 100

_CLASS = np.zeros((256, 7), bool)  # symbol, pipe, capital, digit, sentence punctuation, space, letter
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = (
        _b in b"#$%&*!@^~=+<>{}[]\\/_`",
        _c == "|",
        65 <= _b <= 90,
        48 <= _b <= 57,
        _b in b".,;:?'\"-()",
        _b in b" \t\r\x0b\x0c",
        97 <= _b <= 122 or _b >= 128,
    )
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def line_bounds(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end and document of each non-empty line; a document without any has one empty line."""
    n = len(at) - 1
    breaks = np.flatnonzero(flat == 10)
    starts = np.concatenate([at[:-1], breaks + 1])
    ends_at = np.concatenate([breaks, at[1:]])
    order = np.argsort(starts, kind="stable")
    starts = starts[order]
    ends = np.sort(ends_at, kind="stable")
    doc = np.searchsorted(at, starts, side="right") - 1
    # a break at the very end of a text starts a line that belongs to the next text: bounds by text
    ends = np.minimum(ends, at[np.minimum(doc + 1, n)])
    keep = (ends > starts) & (doc < n)
    starts, ends, doc = starts[keep], ends[keep], doc[keep]
    empty = np.setdiff1d(np.arange(n), doc, assume_unique=False)
    if len(empty):
        starts, ends, doc = np.concatenate([starts, at[empty]]), np.concatenate([ends, at[empty]]), np.concatenate([doc, empty])
        order = np.lexsort((starts, doc))
        starts, ends, doc = starts[order], ends[order], doc[order]
    return starts, ends, doc


def line_features(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines, features), length and document of each line."""
    starts, ends, doc = line_bounds(flat, at)
    length = (ends - starts).astype(np.float64)
    n = len(flat)
    shares = []
    for k in range(_CLASS.shape[1]):
        hit = _CLASS[:, k][flat]
        if k == 2 and n:  # capitals of two bytes
            hit[1:] |= (flat[:-1] == 0xC3) & (flat[1:] >= 0x80) & (flat[1:] <= 0x9E)
        total = np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])
        shares.append((total[ends] - total[starts]) / np.maximum(1, length))
    # words: runs of bytes above the space; a word equal to the one before it, or to the one before that, in the same line
    inside = flat > 32
    border = np.zeros(n + 1, bool)  # words don't run from one text into the next
    border[at] = True
    w0 = np.flatnonzero(inside & (~np.concatenate([[False], inside])[:-1] | border[:-1]))
    w1 = np.flatnonzero(inside & (~np.concatenate([inside, [False]])[1:] | border[1:])) + 1
    line_of = np.searchsorted(starts, w0, side="right") - 1
    sums = np.concatenate([[np.uint64(0)], np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * _powers(n, _BASE)[:n], dtype=np.uint64)])
    word = (sums[w1] - sums[w0]) * _powers(n, _BACK)[w0] if len(w0) else np.zeros(0, np.uint64)
    same = np.zeros(len(word), bool)
    for d in (1, 2):
        same[d:] |= (word[d:] == word[:-d]) & (line_of[d:] == line_of[:-d])
    words = np.bincount(line_of, minlength=len(starts)).astype(np.float64)
    repeats = np.bincount(line_of[same], minlength=len(starts)) / np.maximum(1, words)
    symbol, pipe, capital, digit, punct, space, letter = shares
    letters = np.maximum(capital + letter, 1e-9)
    own = np.stack([np.log1p(length) / 6, symbol * 5, pipe * 10, np.minimum(1, capital / letters), digit * 5, punct * 5, space * 3, np.minimum(30, length / np.maximum(1, words)) / 10, repeats, (length == 0) * 1.0], axis=1)
    before, after = np.zeros_like(own), np.zeros_like(own)
    joined = doc[1:] == doc[:-1]
    before[1:][joined] = own[:-1][joined]
    after[:-1][joined] = own[1:][joined]
    return np.concatenate([np.ones((len(own), 1)), own, before, after], axis=1), length, doc


def _products(m: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Prefix products of the 2 x 2 matrices within each segment, scaled; place: of each matrix in its segment."""
    a, b, c, e = (np.ascontiguousarray(m[:, i, j]) for i in (0, 1) for j in (0, 1))
    d, most = 1, int(place.max()) if len(place) else 0
    at = np.flatnonzero(place >= 1)
    while d <= most:
        at = at[place[at] >= d]
        a0, b0, c0, e0, a1, b1, c1, e1 = a[at - d], b[at - d], c[at - d], e[at - d], a[at], b[at], c[at], e[at]
        w, x, y, z = a0 * a1 + b0 * c1, a0 * b1 + b0 * e1, c0 * a1 + e0 * c1, c0 * b1 + e0 * e1
        scale = 1 / np.maximum(np.maximum(w, x), np.maximum(y, z))
        a[at], b[at], c[at], e[at] = w * scale, x * scale, y * scale, z * scale
        d *= 2
    return np.stack([a, b, c, e], axis=1).reshape(-1, 2, 2)


def marginals(emit: np.ndarray, move: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and P(label before, label) of each line but the first of its document. emit: log-odds of good."""
    n = len(doc)
    if n == 0:
        return np.zeros(0), np.zeros((0, 2, 2))
    new = np.concatenate([[True], doc[1:] != doc[:-1]])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    place = np.arange(n) - first
    last = np.concatenate([new[1:], [True]])
    e = np.stack([np.exp(-np.maximum(emit, 0)), np.exp(np.minimum(emit, 0))], axis=1)
    t = np.exp(move - move.max())
    m = np.where(new[:, None, None], np.ones((1, 2, 2)), t[None]) * e[:, None, :]
    ahead = _products(m, place).sum(axis=1)
    ahead /= ahead.sum(axis=1, keepdims=True)
    # behind[i] = T diag(e[i+1]) ... 1
    rev = np.ones((n, 2, 2))
    rev[:-1] = np.where(last[:-1, None, None], np.ones((1, 2, 2)), t[None] * e[1:, None, :])
    ends = np.maximum.accumulate(np.where(last[::-1], np.arange(n), 0))
    back_place = np.arange(n) - ends
    rt = np.transpose(rev[::-1], (0, 2, 1))
    rt[last[::-1]] = np.eye(2)
    behind = np.transpose(_products(rt, back_place), (0, 2, 1))[::-1].sum(axis=2)
    both = ahead * behind
    both /= both.sum(axis=1, keepdims=True)
    pair = np.zeros((n, 2, 2))
    k = np.flatnonzero(~new)
    pair[k] = ahead[k - 1][:, :, None] * t[None] * (e[k] * behind[k])[:, None, :]
    pair[k] /= pair[k].sum(axis=(1, 2), keepdims=True)
    return both[:, 1], pair


class Model(NamedTuple):
    weights: np.ndarray
    move: np.ndarray
    slope: float
    shift: float
    constant: float | None = None


def mean_logit(good: np.ndarray, length: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Log-odds of each document's share of good lines, weighted by length. good: the lines' marginals."""
    weight = np.maximum(length, 1)
    mean = np.bincount(doc, weights=good * weight, minlength=n) / np.maximum(1e-9, np.bincount(doc, weights=weight, minlength=n))
    mean = np.clip(mean, 1e-4, 1 - 1e-4)
    return np.log(mean / (1 - mean))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(features: np.ndarray, length: np.ndarray, doc: np.ndarray, label: np.ndarray, rounds: int = ROUNDS) -> Model:
    """label: 0 or 1 of each document."""
    n = len(label)
    share = float(label.mean()) if n else 0.5
    if n == 0 or share in (0.0, 1.0):
        return Model(np.zeros(features.shape[1] if features.ndim == 2 else 1), np.zeros((2, 2)), 1.0, 0.0, share)
    balance = np.where(label == 1, 0.5 / share, 0.5 / (1 - share))[doc]
    w, move = _climb(features, doc, label[doc], balance, rounds)
    # a bad document may hold good lines: those that look good for themselves, but never its worst line
    alone = features @ w
    worst = np.full(n, np.inf)
    np.minimum.at(worst, doc, alone)
    y = np.where((label[doc] == 0) & (alone > 0) & (alone > worst[doc]), 1, label[doc])
    if (y != label[doc]).any():
        w, move = _climb(features, doc, y, balance, rounds)
    logit = mean_logit(marginals(features @ w, move, doc)[0], length, doc, n)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of the logistic curve, lightly held
        p = _sigmoid(a * logit + b)
        r, h = label - p, p * (1 - p) + 1e-6
        g = np.array([r @ logit - 0.1 * (a - 1), r.sum() - 0.1 * b])
        hess = np.array([[h @ logit**2 + 0.1, h @ logit], [h @ logit, h.sum() + 0.1]])
        step = np.linalg.solve(hess, g)
        a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -1, 1))
    return Model(w, move, max(a, 0.05), b)


def _climb(features: np.ndarray, doc: np.ndarray, y: np.ndarray, balance: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions of the field by gradient ascent on the conditional likelihood of the lines' labels y."""
    new = np.concatenate([[True], doc[1:] != doc[:-1]])
    w, move = np.zeros(features.shape[1]), np.zeros((2, 2))
    ms, vs = [np.zeros_like(w), np.zeros_like(move)], [np.zeros_like(w), np.zeros_like(move)]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:-1][~new[1:]], y[1:][~new[1:]]), balance[1:][~new[1:]])
    lines = float(balance.sum())
    for i in range(1, rounds + 1):
        good, pair = marginals(features @ w, move, doc)
        grads = [features.T @ (balance * (y - good)) / lines - 1e-4 * w, (seen - (pair * balance[:, None, None]).sum(axis=0)) / lines - 1e-2 * move]
        for k, (x, g) in enumerate(((w, grads[0]), (move, grads[1]))):
            ms[k] = 0.9 * ms[k] + 0.1 * g
            vs[k] = 0.99 * vs[k] + 0.01 * g * g
            x += 0.15 * (ms[k] / (1 - 0.9**i)) / (np.sqrt(vs[k] / (1 - 0.99**i)) + 1e-8)
    return w, move


def remainder(key: str, modulus: int):
    """crc32 of the key's decimal text, modulo; a null key counts as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most_docs: int = MOST_DOCS, most_lines: int = MOST_LINES) -> Model:
    """Fit on the labelled rows that aren't held out."""
    chosen = (
        labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & (remainder(key, 3) != 1))
        .groupBy(F.col(key).alias("__key")).agg(F.max(F.col(label).cast("int")).alias("__label"))
        .orderBy(F.xxhash64("__key"), "__key").limit(most_docs)
    )
    rows = docs.select(F.col(key).alias("__key"), text_or_empty(text).alias("__text")).join(F.broadcast(chosen), "__key")
    # whole documents, as long as the lines of them all stay within the bound; the first one always
    lines = rows.groupBy("__key").agg(F.max(F.length("__text") - F.length(F.replace("__text", F.lit("\n"))) + 1).alias("__n"))
    sizes = sorted((r["h"], r["__key"], r["__n"]) for r in lines.withColumn("h", F.xxhash64("__key")).collect())
    total = np.cumsum([n for *_, n in sizes])
    if len(total) and total[-1] > most_lines:
        rows = rows.where(F.col("__key").isin([k for (_, k, _), n in zip(sizes, total) if n <= most_lines] or [sizes[0][1]]))
    schema = "id bigint, label int, length array<double>, features array<double>"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "__text"):
            at = {c: batch.schema.get_field_index(c) for c in ("__key", "__text", "__label")}
            features, length, doc = line_features(*flat_bytes(batch.column(at["__text"])))
            lines = np.split(np.arange(len(doc)), np.flatnonzero(np.diff(doc)) + 1)
            out = [(k, y, length[i].tolist(), features[i].ravel().tolist()) for k, y, i in zip(batch.column(at["__key"]).to_pylist(), batch.column(at["__label"]).to_pylist(), lines)]
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(("id", "label", "length", "features"), x)) for x in out], schema=pa.schema([("id", pa.int64()), ("label", pa.int32()), ("length", pa.list_(pa.float64())), ("features", pa.list_(pa.float64()))]))

    found = sorted(rows.mapInArrow(measure, schema).dropDuplicates(["id"]).collect(), key=lambda r: r["id"])
    if not found:
        return fit(np.zeros((0, 1)), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
    length = np.concatenate([r["length"] for r in found])
    features = np.concatenate([r["features"] for r in found]).reshape(len(length), -1)
    doc = np.repeat(np.arange(len(found)), [len(r["length"]) for r in found])
    return fit(features, length, doc, np.array([r["label"] for r in found]))


def scores(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The score of each text, its number of lines and of those that the field labels good."""
    n = len(column)
    features, length, doc = line_features(*flat_bytes(column))
    lines = np.bincount(doc, minlength=n)
    if model.constant is not None:
        return np.full(n, model.constant), lines, lines * (model.constant >= 0.5)
    good, _ = marginals(features @ model.weights, model.move, doc)
    found = _sigmoid(model.slope * mean_logit(good, length, doc, n) + model.shift)
    return found, lines, np.bincount(doc, weights=good >= 0.5, minlength=n).astype(np.int64)


def with_score(docs: DataFrame, model: Model, text: str = "text", name: str = "__score", lines: tuple[str, str] | None = None) -> DataFrame:
    """All rows and columns of docs, and their score; with ``lines``, also the numbers of lines and of good lines by these names."""
    read = fresh(docs, "__scored_text")[0]
    source = docs.select("*", text_or_empty(text).alias(read))
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType()), *(T.StructField(c, T.LongType()) for c in lines or ())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, read, 2 << 20):
            found = scores(model, batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, found[: 3 if lines else 1])], names=[f.name for f in schema.fields])

    return source.mapInArrow(score, schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = with_score(docs.select("doc_id", "text"), model, lines=("n_lines", "n_good_lines"))
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"), "n_lines", "n_good_lines")
