"""Near duplicates against all pairs, and the sampling against its own law."""

import collections
import random

import numpy as np
import pytest

from plinth.llm import near_dedup as nd
from plinth.llm._graph import components


def test_samples_agree_as_often_as_texts_do():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 2**63, 600).astype(np.uint64))
    b = np.unique(np.concatenate([a[:480], rng.integers(0, 2**63, 90).astype(np.uint64)]))
    wa, wb = rng.uniform(1, 2, len(a)), rng.uniform(1, 2, len(b))
    _, s = nd.samples(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), np.concatenate([wa, wb]), 3000)
    assert (s[0] == s[1]).mean() == pytest.approx(nd.weighted_jaccard((a, wa), (b, wb)), abs=0.03)


def test_classes_match_all_pairs(spark, docs, rows):
    rng = random.Random(2)
    base = [t for _, t in rows if t and len(t.split()) > 150][:8]
    more = []
    for i, t in enumerate(base):
        for j in range(6):
            w = t.split()
            for _ in range(rng.randint(0, max(1, len(w) // 60))):
                w[rng.randrange(len(w))] = "changed"
            more.append((91000 + 10 * i + j, " ".join(w)))
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    texts = [(r.doc_id, r.text) for r in every.collect()]
    counts, n = nd.document_frequencies(every, "text", 5)
    assert n == len(texts)
    weights = nd.idf(counts, n)
    vectors, least = {}, {}
    for k, t in texts:
        raw = nd.normal(t or "")
        i = nd.text_id(raw)
        vectors[i] = nd._vector(raw, weights, 5)
        least[i] = min((x for x in (least.get(i), k) if x is not None), default=None)
    root = {i: i for i in vectors}

    def find(i):
        return i if root[i] == i else find(root[i])

    ids = list(vectors)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            if nd.weighted_jaccard(vectors[a], vectors[b]) >= nd.THRESHOLD:
                root[find(a)] = find(b)
    members = collections.defaultdict(list)
    for i in ids:
        members[find(i)].append(i)
    expected = {i: min((least[j] for j in m if least[j] is not None), default=None) for m in members.values() for i in m}
    got = nd.near_duplicates(every).collect()
    assert len(got) == len(texts) and all(r.class_id == expected[r.t] for r in got)
    kept = nd.keep_one(every).collect()
    assert len(kept) == len(members)


def test_classes_that_share_their_least_key_stay_apart(spark):
    """Null and repeated keys: one row of every class stays, whatever the keys of its rows."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(50)) for x in "abcd")
    rows = [(None, a), (None, b), (5, a), (5, c), (5, d), (5, d), (3, c), (None, None), (None, ""), (None, d)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected = [(5, a), (None, b), (3, c), (5, d)]
    kept = [(r.doc_id, r.text) for r in nd.keep_one(docs).collect()]
    assert len(kept) == 5 and [k for k in kept if not k[1]][0][0] is None
    assert sorted((k for k in kept if k[1]), key=str) == sorted(expected, key=str)
    found = nd.near_duplicates(docs).collect()
    assert len({r.root for r in found}) == 5
    assert {(r["__key"], r.t) for r in found if r.first} == {(k, nd.text_id(nd.normal(t))) for k, t in [*expected, (None, "")]}


def test_bucket_pairs_join_clusters_without_all_pairs():
    codes = np.repeat(np.arange(36)[None], 50, axis=0)
    pairs = nd.bucket_pairs(list(range(50)), codes, 19)
    assert len(pairs) <= 100 and {b for _, b in pairs} == set(range(1, 50))
    between = np.stack([np.zeros(36), np.ones(36), np.repeat([0, 1], 18)]).astype(int)
    assert sorted(nd.bucket_pairs([10, 11, 12], between, 18)) == [(10, 12), (11, 12)]


def one_partner(seed, n, own, shared):
    """Texts that are nearly similar to each other, and last two that are similar; the second of these is more so to the first of the others."""
    common = [f"c{seed}x{i}" for i in range(400)]
    others = [[f"o{seed}x{k}x{i}" for i in range(own)] for k in range(n)]
    lone = [f"l{seed}x{i}" for i in range(own)]
    return [" ".join(common + w) for w in (*others, lone, lone[:shared] + others[0][shared:])]


@pytest.mark.parametrize("seed", [0, 1, 3])
def test_a_partner_that_the_picks_miss_is_found(seed):
    table_ = np.ones(nd.DF_SLOTS)
    raws = [nd.normal(t) for t in one_partner(seed, 200, 62, 20)]
    vectors = [nd._vector(r, table_, 5) for r in raws]
    codes = np.stack([nd.samples(np.zeros(len(c), int), c, w, 36)[1][0] for c, w in vectors])
    n = len(raws)
    similar = {(j, i) for i in range(n) for j in range(i) if nd.weighted_jaccard(vectors[i], vectors[j]) >= nd.THRESHOLD}
    assert similar == {(0, n - 1), (n - 2, n - 1)}
    assert not similar <= set(nd.bucket_pairs(list(range(n)), codes, 19))
    links = nd.bucket_links(raws, codes, np.arange(n), 19, 0, 3, table_, 5, nd.THRESHOLD)
    assert {(min(a, b), max(a, b)) for a, b, _ in links} == similar


def test_classes_among_many_that_are_nearly_similar(spark):
    every = [t for seed in range(6) for t in one_partner(seed, 150, 40, 15)]
    docs = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string").repartition(4)
    weights = nd.idf(*nd.document_frequencies(docs, "text", 5))
    vectors = [nd._vector(nd.normal(t), weights, 5) for t in every[:152]]
    assert [(j, i) for i in range(152) for j in range(i) if nd.weighted_jaccard(vectors[i], vectors[j]) >= nd.THRESHOLD] == [(0, 151), (150, 151)]
    expected = {k: k - k % 152 if k % 152 >= 150 else k for k in range(len(every))}
    assert {r["__key"]: r.class_id for r in nd.near_duplicates(docs).collect()} == expected


def test_large_buckets_are_taken_apart(spark, docs):
    whole = {(r.t, r.class_id) for r in nd.near_duplicates(docs).collect()}
    assert whole == {(r.t, r.class_id) for r in nd.near_duplicates(docs, most_bucket=2).collect()}


def test_large_bucket_meets_each_pair_of_clusters_once(spark):
    root = [0] * 40 + [100 + i % 11 for i in range(23)]
    left = spark.createDataFrame([(3, 7, t, r) for t, r in enumerate(root)] + [(4, 7, 0, 0), (4, 7, 50, 110), (5, 7, 0, 0), (5, 7, 1, 0)], "band int, bucket long, t long, root long")
    nodes = spark.createDataFrame([(t, [t], [t] * 12) for t in range(len(root))], "t long, codes array<int>, bands array<long>")
    groups = {}
    for r in nd._bucket_rows(left, nodes, 10).collect():
        groups.setdefault((r.band, r.g), []).append((r.t, r.root, r.side))
    met = [(band, *sorted((a[0], b[0]))) for (band, _), g in groups.items() for i, a in enumerate(g) for b in g[:i] if a[1] != b[1] and (a[2] != b[2] or len({x[2] for x in g}) == 1)]
    every = [(3, a, b) for b in range(len(root)) for a in range(b) if root[a] != root[b]]
    assert sorted(met) == sorted([*every, (4, 0, 50)])


def test_partners_that_share_only_the_band_of_a_large_bucket(spark):
    raws = [nd.normal(t) for t in one_partner(0, 60, 62, 20)]
    table_, n = np.ones(nd.DF_SLOTS), len(raws)
    codes = [nd.samples(np.zeros(len(c), int), c, w, 36)[1][0].view(np.int32).tolist() for c, w in (nd._vector(r, table_, 5) for r in raws)]
    # all share band 0 and no other
    nodes = spark.createDataFrame([(t, codes[t], [1, *(100 * t + k for k in range(2, 13))]) for t in range(n)], "t long, codes array<int>, bands array<long>")
    texts = spark.createDataFrame([(t, bytearray(r)) for t, r in enumerate(raws)], "t long, words binary")
    weights = spark.sparkContext.broadcast(table_)
    for most in (6, 20, 1000):
        links = nd._links(nodes, lambda wanted: texts.join(wanted, "t", "left_semi"), weights, 5, nd.THRESHOLD, 3, 12, most)
        assert {(r.a, r.b) for r in links.collect()} == {(0, n - 1), (n - 2, n - 1)}


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in components(chain).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_empty_table(none):
    assert nd.near_duplicates(none).count() == 0 and nd.keep_one(none).count() == 0
