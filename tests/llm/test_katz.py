"""The language model against a dictionary version over strings."""

import collections
import functools
import math
import re
import zlib

import numpy as np
import pytest

from plinth.llm import _common, katz

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def words(text):
    return [*re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().translate(LOWER)), None]


def counts_of_counts(c):
    return np.array([sum(v == r for v in c.values()) for r in range(1, katz.MOST + 2)])


@pytest.fixture(scope="module")
def model(rows):
    texts = [(k, zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2, words(t)) for k, t in rows]
    one = collections.Counter(w for _, held, ws in texts if not held for w in ws)
    two = collections.Counter(p for _, held, ws in texts if not held for p in zip(["<s>", *ws], ws))
    uni = katz.Unigrams(sum(one.values()), len(one), counts_of_counts(one))
    d = katz.discounts(counts_of_counts(two))
    after = collections.defaultdict(dict)
    for (a, b), n in two.items():
        after[a][b] = n

    @functools.lru_cache(None)
    def p1(w):
        return float(uni.probability(np.array([one.get(w, 0)]))[0])

    @functools.lru_cache(None)
    def context(h):
        f = after[h]
        total = sum(f.values())
        kept = {w: (d[n] if n <= katz.MOST else 1) * n for w, n in f.items()}
        left, scale = (total - sum(kept.values())) / total, 1 / total
        if left <= 1e-9:
            left, scale = 1 / (total + 1), 1 / (total + 1)
        return {w: k * scale for w, k in kept.items()}, left / (1 - sum(map(p1, f)))

    def p2(h, w):
        if h not in after:
            return p1(w)
        seen, alpha = context(h)
        return seen.get(w, alpha * p1(w))

    return texts, one, p1, p2, uni


def test_probabilities_add_up(model):
    _, one, p1, p2, uni = model
    assert sum(map(p1, one)) + uni.unknown == pytest.approx(1)
    for h in ["<s>", b"the", b"never seen", b"word", *list(one)[:20]]:
        assert sum(p2(h, w) for w in one) + p2(h, b"unknown!") == pytest.approx(1)


def test_scores(spark, docs, model, monkeypatch):
    monkeypatch.setattr(katz, "BATCH_TOKENS", 5000)
    texts, one, _, p2, uni = model
    expected = collections.defaultdict(list)
    for k, held, ws in texts:
        base = sum(math.log10((one.get(w, 0) + 1) / (uni.total + uni.words + 1)) for w in ws)
        expected[k].append((held, len(ws), sum(w in one for w in ws), uni.total, pytest.approx(base, abs=1e-6), pytest.approx(sum(math.log10(p2(a, b)) for a, b in zip(["<s>", *ws], ws)), abs=1e-7, rel=1e-9)))
    got = katz.score_texts(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        assert any(tuple(r[1:]) == e for e in expected[r.doc_id])


def test_one_query_of_few_files(spark, docs, monkeypatch, tmp_path):
    """Nothing is written on the way, and scores of many partitions go into few files: each file makes an executor start processes, which share its memory for a moment."""
    monkeypatch.setattr(katz, "BATCH_TOKENS", 500)
    monkeypatch.setattr(_common, "shared_dir", lambda spark: pytest.fail("a table of its own"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        katz.score_texts(docs.repartition(8)).write.parquet(f"{tmp_path}/scores")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert spark.read.parquet(f"{tmp_path}/scores").count() == docs.count()
    assert len(list(tmp_path.glob("scores/*.parquet"))) <= 2


def test_long_texts_are_split_a_megabyte_at_a_time(spark, monkeypatch):
    plain = katz.word_hashes

    def watched(flat, at):
        assert len(flat) <= 1 << 20
        return plain(flat, at)

    monkeypatch.setattr(katz, "word_hashes", watched)
    got = katz.score_texts(spark.range(0, 40, 1, 1).selectExpr("id doc_id", "repeat('a word ', 14000) text")).collect()
    assert [r.n_tokens for r in got] == [28001] * 40


def test_empty_table(none):
    assert katz.score_texts(none).count() == 0


def test_discounts_fall_back():
    assert list(katz.discounts(np.zeros(6))) == [1.0, 0.5, 1, 1, 1, 1]
