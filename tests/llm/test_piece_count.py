"""Token counts against the library on whole texts."""

import public_tokenizers
import pytest

from plinth.llm import piece_count

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("chunk, overlap", [(300, 16), (1000, 64), (1 << 15, 512)])
def test_spliced_counts(rows, chunk, overlap):
    model = piece_count.counter(PATH)
    assert model.proven
    odd = ["x" * 5000 + " y" * 300 + "\t\n  " + "é" * 900, " a  b " * 600, "ab\n" * 2000, "日本語" * 900 + " " + "<0x0A> </s> <s> <unk>" * 30, "a" * 6000, "▁ ▁▁x " * 300]
    for text in odd + sorted((t or "" for _, t in rows), key=len)[-6:]:
        raw = text.encode()
        assert model.count(raw, chunk, overlap) == model.count_whole(raw)


def test_long_text_without_spaces():
    """Each byte is encoded a bounded number of times, whether places to splice at are none, few or late."""
    import time

    model = piece_count.counter(PATH)
    base = "".join(chr(0x3042 + (i * i + 7 * i) % 80) for i in range(700_000))
    for text in (base, base[:300_000] + " x " + base[300_000:], "a b " * 30_000 + base, base + " c d" * 30_000):
        raw, began = text.encode(), time.process_time()
        whole = model.count_whole(raw)
        alone, began = time.process_time() - began, time.process_time()
        assert model.count(raw) == whole
        assert time.process_time() - began < 6 * alone + 1


def test_query(docs, rows):
    model = piece_count.counter(PATH)
    got = piece_count.count_tokens(docs, PATH, limit=500, chunk=2000, overlap=64).collect()
    expected = sorted(((k, len((t or "").encode()), n := len(model.model.encode(t or "")), n > 500) for k, t in rows), key=repr)
    assert sorted(map(tuple, got), key=repr) == expected


def test_empty_table(none):
    assert piece_count.count_tokens(none, PATH).count() == 0
