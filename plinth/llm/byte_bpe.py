"""Byte-level BPE ids of whole texts, by a tokenizer file of the tokenizers library, with a memory for repeated pieces.

The file's pre-tokeniser never joins a byte that isn't white space to white space after it. So a text whose white space is
single spaces and single line ends between other characters falls apart before each space and around each line end, and
each part has the ids that it has in the whole text. Parts are encoded once per worker and remembered up to a bound; any
other text (runs of white space, other white space, the special token's string) goes to the library whole.

New parts of Latin characters are encoded with the same vocabulary by tiktoken, which merges the same pairs in the same
order several times faster: ids rise with the rank of their merge, which is checked when the file is loaded. If they don't,
and for all other characters (the two libraries may know different versions of Unicode's classes), the library of the file
does it. Tests hold both against the library on whole texts.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

MOST_PARTS = 700_000
#: Characters up to here have had the same classes for decades.
LATIN = "\u024f"
#: The pre-tokeniser's pattern of byte-level files. A fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteBPE:
    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # a byte-level vocabulary writes each byte as one character
        vocabulary = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for piece, i in vocabulary.items():
            self.width[i] = len(piece)
        self.fast = self._fast(vocabulary)
        self.forget()

    def _fast(self, vocabulary: dict[str, int]):
        """The same vocabulary as a tiktoken encoding, or None if its ids aren't in the order of the merges."""
        import json

        import tiktoken

        model = json.loads(self.tokenizer.to_str())
        if (model.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or model["pre_tokenizer"].get("add_prefix_space") or model.get("normalizer"):
            return None
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        ids = [vocabulary["".join(m)] for m in merges]
        if ids != sorted(ids):
            return None
        # the printable characters that stand for the bytes of byte-level files
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in vocabulary.items() if piece not in special}
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.filled = np.zeros(1 << 20, np.uint32), 0
        self.start, self.size = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)

    def learn(self, parts: list[str]) -> None:
        """Parts that start with a space are encoded as one text, whose ids fall apart at the parts' ends."""
        latin = [p for p in parts if self.fast is not None and max(p) <= LATIN]
        others = [p for p in parts if self.fast is None or max(p) > LATIN]
        spaced, rest = [p for p in others if p[0] == " "], [p for p in others if p[0] != " "]
        joined = [p for p in latin if p[0] == " "]
        alone = [p for p in latin if p[0] != " "]
        first, n = len(self.place), len(parts)
        ids, sizes = [], []
        for some_parts, encode in ((joined, self._encode_fast), (spaced, self._encode_slow)):
            for i in range(0, len(some_parts), 4096):
                some = some_parts[i : i + 4096]
                found = encode("".join(some))
                ends = np.searchsorted(np.cumsum(self.width[found]), np.cumsum([len(p.encode()) for p in some])) + 1
                ids.append(found)
                sizes.append(np.diff(ends, prepend=0))
        if alone:
            found_alone = [self._encode_fast(p) for p in alone]
            ids.append(np.concatenate(found_alone))
            sizes.append(np.array([len(f) for f in found_alone]))
        if rest:
            found_rest = [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
            ids.append(np.concatenate([np.array(f, np.uint32) for f in found_rest]))
            sizes.append(np.array([len(f) for f in found_rest]))
        flat, size = np.concatenate(ids), np.concatenate(sizes).astype(np.int64)
        while first + n > len(self.start):
            self.start, self.size = np.resize(self.start, 2 * len(self.start)), np.resize(self.size, 2 * len(self.size))
        while self.filled + len(flat) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.filled : self.filled + len(flat)] = flat
        self.start[first : first + n] = self.filled + np.cumsum(size) - size
        self.size[first : first + n] = size
        self.filled += len(flat)
        self.place.update(zip(joined + spaced + alone + rest, range(first, first + n)))

    def _encode_fast(self, text: str) -> np.ndarray:
        return np.asarray(self.fast.encode_ordinary(text), np.uint32)

    def _encode_slow(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, without added special tokens."""
        if len(self.place) > MOST_PARTS:
            self.forget()
        parts: list[list[str] | None] = []
        for t in texts:
            # any other white space, and white space in runs or at the ends, would come out changed
            regular = t != "" and " ".join(t.split()) == t.replace("\n", " ") and "<|" not in t and "\0" not in t
            parts.append(t.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0") if regular else None)
        place = self.place
        new = {p for ps in parts if ps for p in ps if p not in place}
        if new:
            self.learn(list(new))
        out = []
        for t, ps in zip(texts, parts):
            if ps is None:
                out.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32))
                continue
            at = np.fromiter(map(place.__getitem__, ps), np.int64, len(ps))
            size = self.size[at]
            ends = np.cumsum(size)
            out.append(self.flat[np.repeat(self.start[at] - ends + size, size) + np.arange(ends[-1])])
        return out


@lru_cache(maxsize=2)
def bpe(path: str) -> ByteBPE:
    return ByteBPE(path)
