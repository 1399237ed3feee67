"""Decontamination: exact distances, recall against brute force, clean texts."""

import itertools
import random

import numpy as np
import pytest

from plinth.llm import decontaminate as dc


@pytest.fixture(scope="module")
def items(spark, sf):
    return [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]


def least_distance(item, window):
    row = [0] * (len(window) + 1)
    for i, a in enumerate(item, 1):
        row, last = [i], row
        for j, b in enumerate(window, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (a != b)))
    return min(row)


def edited(rng, text, rate):
    out = []
    for c in text:
        if rng.random() < rate:
            out.append(rng.choice(["", rng.choice("abcdefgh "), c + rng.choice("abcdefgh ")]))
        else:
            out.append(c)
    return "".join(out)


def test_distance(items):
    known, rng = dc.Items(items[:5], 0.8, dc.STEPS, dc.SAMPLED, dc.REPETITIONS), random.Random(0)
    for i in range(5):
        window = dc.normal("some words before " + edited(rng, items[i][1], 0.1) + " and after")
        assert known.distance(i, window) == least_distance(known.raws[i], window)
    few = dc.Items([(0, "a"), (1, "ab" * 32), (2, "abc" * 43), (3, "x" * 64)], 0.8, dc.STEPS, dc.SAMPLED, dc.REPETITIONS)
    for i, window in itertools.product(range(4), [b"b", b"ab" * 30, b"abd" * 50, b"x" * 70, b"abcabcab" * 9]):
        assert few.distance(i, window) == least_distance(few.raws[i], window)


@pytest.mark.parametrize("rate, least", [(0.0, 1.0), (0.03, 1.0), (0.1, 0.95)])
def test_recall(items, rows, rate, least):
    known, rng = dc.Items(items, 0.8, dc.STEPS, dc.SAMPLED, dc.REPETITIONS), random.Random(3)
    hosts = [t for _, t in rows if t and len(t) > 500]
    hit = total = 0
    for _ in range(150):
        i = rng.randrange(len(items))
        host = rng.choice(hosts)[:400]
        text = dc.normal(f"{host} {edited(rng, items[i][1], rate)} {host[::-1]}")
        j = known.ids.index(items[i][0])
        if known.distance(j, text) <= known.allowed[j]:
            total += 1
            hit += any(x == j for _, x, _, _ in known.held([text]))
    assert hit >= least * total > 0


@pytest.mark.parametrize("rate", [0.15, 0.18, 0.2])
@pytest.mark.parametrize("length", [12, 20, 35, 50, 65, 90, 120, 200, 400])
def test_recall_by_length(items, rows, length, rate):
    """Scattered edits, as many as the rate says; lengths below the benchmark's are beginnings of its items."""
    raws = sorted({dc.normal(t)[: length if length < 80 else None] for _, t in items}, key=lambda r: abs(len(r) - length))[:12]
    known, rng = dc.Items([(i, r.decode(errors="ignore")) for i, r in enumerate(raws)], 0.8, dc.STEPS, dc.SAMPLED, dc.REPETITIONS), random.Random(4)
    hosts = [t for _, t in rows if t and len(t) > 500]
    hit = total = 0
    for _ in range(60):
        i = rng.randrange(len(known.raws))
        out = list(known.raws[i].decode())
        for p in rng.sample(range(len(out)), int(rate * len(out) + 1e-9)):
            out[p] = rng.choice(["", rng.choice("abcdefgh "), out[p] + rng.choice("abcdefgh ")])
        host = rng.choice(hosts)[:400]
        text = dc.normal(f"{host} {''.join(out)} {host[::-1]}")
        if known.distance(i, text) <= known.allowed[i]:
            total += 1
            hit += any(x == i for _, x, _, _ in known.held([text]))
    print(length, rate, hit, total)
    assert hit >= 0.9 * total > 0


def test_the_stretches_lose_nothing(items):
    known, rng = dc.Items(items[:40], 0.8, dc.STEPS, dc.SAMPLED, dc.REPETITIONS), random.Random(8)
    near = 0
    for _ in range(400):
        i = rng.randrange(len(known.raws))
        leak = rng.random() < 0.8
        window = dc.normal("words before " + edited(rng, known.raws[i].decode(), rng.choice([0.1, 0.2, 0.3])) + " after") if leak else known.raws[rng.randrange(40)]
        flat = np.frombuffer(window + b"\0", np.uint8)
        passed = known.plausible(flat, np.array([i]), np.array([13 if leak else 0]), np.array([0]), np.array([len(window)]))[0]
        if known.distance(i, window) <= known.allowed[i]:
            near += 1
            assert passed
    assert near > 50


def test_walks_end_early_and_lose_none(items, rows):
    """Proposals are those of all whole walks; few places are walked to the end."""
    known = dc.Items(items, 0.8, dc.STEPS, dc.SAMPLED, dc.REPETITIONS)
    hosts = [t for _, t in rows if t]
    flat = np.frombuffer(b"\0".join(dc.normal(t) for t in hosts + [f"{t[:90]} {x[20:]}" for t, (_, x) in zip(hosts, items)]) + b"\0", np.uint8)

    def samples(walk, flat, place):
        out = []
        for j in range(dc.STEPS):
            out += [int(flat[place])] if j in walk.sampled else []
            place += int(walk.moves[j][flat[place]])
        return tuple(out)

    at, expected = dc.word_starts(flat)[-1500:], set()
    for walk, keys, *_ in known.tables:
        own = {}
        for p in np.flatnonzero(known.flat).tolist():
            own.setdefault(samples(walk, known.flat, p), []).append(p)
        for p in at.tolist():
            expected |= {(i, p - o + b) for o in own.get(samples(walk, flat, p), []) for i in [int(np.searchsorted(known.begins, o, "right")) - 1] for b in [int(known.begins[i])]}
        some, mine = walk.keys(flat, dc.word_starts(flat))
        assert len(some) < 0.5 * len(dc.word_starts(flat)) and len(mine) == len(some)
    found = set(zip(*(c.tolist() for c in known.hits(flat))))
    assert expected and expected <= found


def test_windows_go_at_the_first_stretches_that_exceed(items, rows, monkeypatch):
    """As plausible as all stretches together say, for less than all of them; a long item's stretches go together."""
    long = " ".join(t for _, t in rows if t and len(t) < 5000)[:1500]
    known, rng = dc.Items([*items, (-1, long), (-2, "x" * 65)], 0.8, dc.STEPS, dc.SAMPLED, dc.REPETITIONS), random.Random(5)
    hosts = [dc.normal(t) for _, t in rows if t and len(t) > 900]
    item = np.array([rng.randrange(len(items)) for _ in range(60)] + [len(items), len(items) + 1])
    texts = [rng.choice(hosts)[:900] if rng.random() < 0.7 else dc.normal("before " + edited(rng, items[i][1], 0.25)) for i in item[:60].tolist()] + [dc.normal("before " + edited(rng, long, 0.1)), b"x" * 55]
    flat = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    end = np.cumsum([len(t) + 1 for t in texts]) - 1
    begin = end - [len(t) for t in texts]
    start = begin + 7
    expected, stretches = [], 0
    for i, s, a, b in zip(item.tolist(), start.tolist(), begin.tolist(), end.tolist()):
        raw, k, least = known.raws[i], known.allowed[i], 0
        for o in range(0, len(raw), 64):
            piece = raw[o : o + 64]
            low = min(max(s + o - k, a), b)
            least += least_distance(piece, flat[low : max(low, min(s + o + len(piece) + k + k // 4 + 2, b))].tobytes())
            stretches += 1
        expected.append(least <= k)
    calls, least = [], dc.Items.least
    monkeypatch.setattr(dc.Items, "least", lambda self, *a: calls.append(len(a[1])) or least(self, *a))
    monkeypatch.setattr(dc, "TOGETHER", 16)
    assert known.plausible(flat, item, start, begin, end).tolist() == expected and 0 < sum(expected) < 62
    assert sum(calls) < stretches
    calls.clear()
    monkeypatch.setattr(dc, "TOGETHER", 1 << 12)
    assert known.plausible(flat, item[60:], start[60:], begin[60:], end[60:]).tolist() == expected[60:] == [True, True]
    assert len(calls) == 1


def test_too_many_items(spark, docs, monkeypatch):
    monkeypatch.setattr(dc, "MOST_BYTES", 10)
    with pytest.raises(ValueError):
        dc.find_items(docs, spark.createDataFrame([(1, "more than ten bytes")], "item_id long, text string"))


def test_query_and_filter(spark, docs, rows, items, sf):
    held = {k for k, t in rows if t and any(dc.normal(x) in dc.normal(t) for _, x in items)}
    leaks = [(92000 + i, f"Before it. {t} After it.") for i, (_, t) in enumerate(items[:10])]
    odd = spark.createDataFrame([(98000, None), (98001, ""), (98002, "short phrase")], "item_id long, text string")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").unionByName(odd)
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(leaks, "doc_id long, text string"))
    for block_bytes in (8 << 20, 4000):
        found = {r.doc_id for r in dc.find_items(every, bench, block_bytes=block_bytes).collect()}
        assert held | {k for k, _ in leaks} <= found
        assert {r.doc_id for r in dc.drop_contaminated(every, bench, block_bytes=block_bytes).collect()} == {k for k, _ in rows + leaks} - found
    assert dc.drop_contaminated(docs, bench).columns == docs.columns


def test_empty_tables(docs, none, spark):
    no_items = spark.createDataFrame([], "item_id long, text string")
    assert dc.find_items(docs, no_items).count() == 0
    assert dc.drop_contaminated(none, no_items).count() == 0
    assert dc.drop_contaminated(docs, no_items).count() == docs.count()
