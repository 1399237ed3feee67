"""Packing: the ids against the library, the plan against best-fit decreasing, the sequences against the contract."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from plinth.llm import byte_bpe, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "  ", " a", "a ", "a  b", "a\tb", "a\n\nb", "a \nb", "it's <|endoftext|> x", "a\nb c\nd", "x y z", "don't\n'll go", "1234 567\n89", "é\nÀ !!\n??", "\0 a", "日本 語\nx"]


def test_ids_are_the_library_s(rows):
    coder = byte_bpe.ByteBPE(PATH)
    texts = ODD + [t or "" for _, t in rows]
    for a, t in zip(coder.encode(texts), texts):
        assert a.tolist() == coder.tokenizer.encode(t, add_special_tokens=False).ids


#: Other white space that makes up for a doubled or trailing space or line end in the count of words.
BALANCED = ["un\u00a0deux\n\ntrois", "a\tb\n\nc", "a\u00a0b\n", "a\tb\tc d", "a\tb  c", " a\tb", "a\u2003b ", "a\r\nb\tc", "\n", " ", "\t", "a\u0085b\n\nc d"]


def test_other_white_space_goes_to_the_library():
    coder = byte_bpe.ByteBPE(PATH)
    for texts in (BALANCED, *([t] for t in BALANCED)):
        for a, t in zip(coder.encode(texts), texts):
            assert a.tolist() == coder.tokenizer.encode(t, add_special_tokens=False).ids
    assert not any(set("\t\r\u00a0\u0085\u2003") & set(p) or p == "" for p in coder.place)


def test_memory_is_bounded(monkeypatch, rows):
    monkeypatch.setattr(byte_bpe, "MOST_PARTS", 50)
    coder = byte_bpe.ByteBPE(PATH)
    for t in [t for _, t in rows if t][:20]:
        assert coder.encode([t])[0].tolist() == coder.tokenizer.encode(t, add_special_tokens=False).ids


def test_plan_is_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(100):
        capacity = rng.choice([8, 16, 64])
        histogram = {rng.randint(1, capacity): rng.randint(1, 30) for _ in range(rng.randint(1, 12))}
        used = collections.defaultdict(list)
        for length, slots in packing.plan(histogram, capacity).items():
            starts = [s.rank_from for s in slots]
            for r in range(histogram[length]):
                s = slots[int(np.searchsorted(starts, r, side="right")) - 1]
                used[s.sequence + (r - s.rank_from) // s.per].append((s.offset + (r - s.rank_from) % s.per * length, length))
        bins = []
        for length in sorted(histogram, reverse=True):
            for _ in range(histogram[length]):
                fits = [i for i, x in enumerate(bins) if x >= length]
                if fits:
                    bins[min(fits, key=bins.__getitem__)] -= length
                else:
                    bins.append(capacity - length)
        assert len(used) == len(bins)
        for slots in used.values():
            at = 0
            for offset, length in sorted(slots):
                assert offset == at
                at += length
            assert at <= capacity


@pytest.mark.parametrize("capacity", [1024, 64])
def test_contract(docs, rows, capacity):
    got = packing.pack(docs, PATH, capacity=capacity).collect()
    coder = byte_bpe.bpe(PATH)
    expected = collections.Counter()
    for (k, _), ids in zip(rows, coder.encode([t or "" for _, t in rows])):
        ids = np.append(ids, 2).astype("<u4")
        for i, (start, length) in enumerate(packing.piece_bounds(len(ids), capacity)):
            expected[k, i, start, length, zlib.crc32(ids[start : start + length].tobytes())] += 1
    assert collections.Counter(tuple(r[:5]) for r in got) == expected
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for slots in by.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in got)
    assert len(by) <= -(-total // capacity) * 1.05 + 1


def test_empty_table(none):
    assert packing.pack(none, PATH).count() == 0


def test_ids_of_mixed_white_space():
    """No text of odd white space, scripts and special strings has other ids than the library's, or fails."""
    import random

    rng, coder = random.Random(5), byte_bpe.ByteBPE(PATH)
    marks = [" ", "\t", "\n", " ", "\x1c", "\x85", "　", "\r", "a", "b", "é", "漢", "字", "'s", "1", "!", "<|", "\0"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(1, 14))) for _ in range(30_000)] + ["a\tb\n", "un deux\n\ntrois", "a\tb\tc d"]
    for i in range(0, len(texts), 500):
        for t, ids in zip(texts[i : i + 500], coder.encode(texts[i : i + 500])):
            assert ids.tolist() == coder.tokenizer.encode(t, add_special_tokens=False).ids
