"""Repeats against all windows of the corpus."""

import collections
import hashlib
import random
import tracemalloc
import types

import pyarrow as pa
import pytest

from plinth.llm import suffix_dedup as sd


def brute(rows, least):
    raws = [(k, (t or "").encode()) for k, t in rows]
    seen = collections.Counter(r[i : i + least] for _, r in raws for i in range(len(r) - least + 1))
    out = []
    for k, r in raws:
        held = bytearray(len(r))
        for i in range(len(r) - least + 1):
            if seen[r[i : i + least]] > 1:
                held[i : i + least] = b"\1" * least
        spans = sum(held[i] and (i == 0 or not held[i - 1]) for i in range(len(r)))
        out.append((k, len(r), sum(held), spans, hashlib.sha256(bytes(b for b, h in zip(r, held) if not h)).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def odd(rows):
    rng = random.Random(5)
    texts = [t for _, t in rows if t and 900 < len(t) < 4000][:6]
    made = [texts[0] * 2, texts[0][:700] + "zz" + texts[1][:900], "a" * 1500, "ab" * 400 + "q", "x" * 399, "x" * 399, "y" * 400, "y" * 400, "Is onhe. " * 60, "zz " + "Is onhe. " * 45 + "q", "onhe. " + "Is onhe. " * 44 + "pq", "w" + "abc" * 134 + "y", "c" + "abc" * 133 + "zz", texts[2][:450] + texts[3][:450] + texts[2][100:800]]
    for _ in range(25):
        noise = lambda n: "".join(rng.choice("abcdefg ") for _ in range(n))
        made.append(noise(rng.randint(0, 500)) + texts[4][rng.randint(0, 60) : rng.randint(480, 600)] + noise(300))
    few = [(k, t) for k, t in rows if t is None or len(t) < 6000][:60]
    return few + [(95000 + i, t) for i, t in enumerate(made)]


@pytest.mark.parametrize("least, gram, split", [(400, 32, 50_000), (400, 32, 5), (200, 32, 50_000)])
def test_digests(spark, odd, least, gram, split):
    df = spark.createDataFrame(odd, "doc_id long, text string")
    got = sorted((tuple(r) for r in sd.repeat_digests(df, least=least, gram=gram, split=split).collect()), key=repr)
    assert got == brute(odd, least)


@pytest.mark.parametrize("split", [50_000, 5])
def test_digests_with_passages(spark, odd, split):
    """Both lengths from one pass: what is removed as before, and the runs of the shorter length of over fifty words."""
    df = spark.createDataFrame(odd, "doc_id long, text string")
    got = [tuple(r) for r in sd.repeat_digests(df, split=split, passage=200).collect()]
    assert sorted((r[:5] for r in got), key=repr) == brute(odd, 400)
    raws = [(k, (t or "").encode()) for k, t in odd]
    seen = collections.Counter(r[i : i + 200] for _, r in raws for i in range(len(r) - 199))
    expected = []
    for k, r in raws:
        held = bytearray(len(r) + 1)
        for i in range(len(r) - 199):
            if seen[r[i : i + 200]] > 1:
                held[i : i + 200] = b"\1" * 200
        edges = [i for i in range(len(held)) if held[i] != (held[i - 1] if i else 0)]
        long = [(b, e) for b, e in zip(edges[::2], edges[1::2]) if len(r[b:e].split()) > 50]
        expected.append((k, len(r), len(long), sum(e - b for b, e in long)))
    assert sorted(((r[0], r[1], r[5], r[6]) for r in got), key=repr) == sorted(expected, key=repr)
    assert any(e[2] for e in expected)


def test_long_repeats_by_anchors_of_short_ones(spark):
    """Strings of about 400 bytes that hold runs, cut from their texts at different places, by the anchors of 200 bytes."""
    rng = random.Random(11)
    texts = []
    for _ in range(70):
        noise = lambda n: "".join(rng.choice("abcdefg ") for _ in range(n))
        unit = noise(rng.choice([1, 2, 7, 40, 90, 100, 130, 199]))
        run = (unit * 500)[: rng.randint(150, 650)]
        whole = noise(rng.randint(0, 300)) + run + noise(rng.randint(0, 300))
        at = rng.randint(0, max(0, len(whole) - 400))
        for _ in range(2):
            begin, end = max(0, at - rng.choice([0, 0, 3, 150])), at + 400 + rng.choice([-1, 0, 0, 1, 60])
            texts.append(noise(rng.choice([0, 50, 250])) + whole[begin:end] + noise(rng.choice([0, 50, 250])))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for split in (50_000, 1):
        assert sorted((tuple(r)[:5] for r in sd.repeat_digests(df, split=split, passage=200).collect()), key=repr) == brute(rows, 400)


def test_query_counts_the_passages(spark, sf):
    assert sd.op3_suffix_dedup(spark, sf).columns[5:] == ["n_passages", "n_passage_bytes"]


def test_segments_of_a_long_text(spark, odd, monkeypatch):
    monkeypatch.setattr(sd, "SEGMENT", 3000)
    long = [(1, "".join(t for _, t in odd[:20] if t)), (2, odd[5][1] or "x"), (3, "".join(t for _, t in odd[10:30] if t))]
    df = spark.createDataFrame(long, "doc_id long, text string")
    assert sorted(map(tuple, sd.repeat_digests(df).collect()), key=repr) == brute(long, 400)
    assert sorted((tuple(r)[:5] for r in sd.repeat_digests(df, passage=200).collect()), key=repr) == brute(long, 400)


def test_anchors_take_bounded_memory():
    """Two workers of an executor share what its heap leaves of 3000 MB; 428 MB here before."""
    rng = random.Random(5)
    texts = [bytes(rng.choices(b"abcdefgh ", k=2000)).decode() for _ in range(2000)] + ["x" * 3_000_000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64())] * 2 + [pa.array(texts)], names=["__k1", "__k2", "__text"])
    find = sd._anchor_rows(types.SimpleNamespace(mapInArrow=lambda f, schema: f), 200, 32)
    tracemalloc.start()
    assert sum(b.num_rows for b in find(iter([batch]))) > 40_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20


def test_intervals_cover_the_common_prefix_tree():
    assert sorted(sd.prefix_intervals([0, 2, 2, 1, 3])) == [(1, 0, 4), (2, 0, 2), (3, 3, 4)]


def test_removal_keeps_characters_and_columns(spark, docs):
    text = "é" * 300
    df = docs.limit(3).unionByName(docs.limit(0))
    from pyspark.sql import functions as F

    df = df.withColumn("text", F.concat(F.col("doc_id").cast("string"), F.lit(" begins "), F.lit(text)))
    got = sd.remove_repeats(df).collect()
    assert [c for c in sd.remove_repeats(df).columns] == docs.columns
    assert all(r.text == str(r.doc_id) or r.text.startswith(str(r.doc_id)) and len(r.text) < 20 for r in got)
    assert all(r.n_chars == len(r.text) and r.t == "clash" for r in got)


def test_empty_table(none):
    assert sd.repeat_digests(none).count() == 0
