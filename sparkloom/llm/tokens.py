"""Byte-level BPE ids from a tokenizer file, with a bounded cache of words."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

#: Words kept by a worker before its cache is dropped and begun anew.
CACHE_WORDS = 300_000


def _byte_of() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Ids equal to `tokenizers` on the same file, special strings included.

    A text splits before every space that a non-space follows: the pre-tokenizer always cuts there, so the ids of the
    pieces join to the ids of the text. Pieces repeat, so each is encoded once while the cache holds it. Texts with
    runs of spaces or with a special string are encoded whole.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        byte_of = _byte_of()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.slow = Tokenizer.from_file(path)
        self.size = self.slow.get_vocab_size()
        self.fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.after_space = np.zeros(self.size, dtype=bool)
        for token, i in ranks.items():
            self.after_space[i] = token[:1] == b" "
        self.odd = re.compile(r" (?:\s|\Z)|\A\s")
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.flat = np.empty(1 << 16, dtype=np.uint16)
        self.begin = np.empty(1 << 14, dtype=np.int64)
        self.count = np.empty(1 << 14, dtype=np.int64)
        self.used = 0

    def _learn(self, words: set[str]) -> None:
        if len(self.at) + len(words) > CACHE_WORDS:
            self._clear()
        new = list(words)
        ids = np.array(self.fast.encode_ordinary("".join([" " + w for w in new])), dtype=np.uint16)
        starts = np.flatnonzero(self.after_space[ids])
        if len(starts) != len(new):
            raise AssertionError("a piece without its own first token")
        need, rows = self.used + len(ids), len(self.at) + len(new)
        if need > len(self.flat):
            self.flat = np.concatenate((self.flat[: self.used], np.empty(need * 2 - self.used, dtype=np.uint16)))
        if rows > len(self.begin):
            self.begin = np.concatenate((self.begin, np.empty(rows * 2 - len(self.begin), dtype=np.int64)))
            self.count = np.concatenate((self.count, np.empty(rows * 2 - len(self.count), dtype=np.int64)))
        first = len(self.at)
        self.flat[self.used : need] = ids
        self.begin[first:rows] = starts + self.used
        self.count[first:rows] = np.diff(np.append(starts, len(ids)))
        self.at.update(zip(new, range(first, rows), strict=True))
        self.used = need

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text as uint16; null: none."""
        out: list[np.ndarray | None] = [None] * len(texts)
        pieces: list[list[str]] = []
        where: list[int] = []
        for i, text in enumerate(texts):
            if not text:
                out[i] = np.empty(0, dtype=np.uint16)
            elif any(s in text for s in self.special):
                out[i] = np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint16)
            elif self.odd.search(text):
                out[i] = np.array(self.fast.encode_ordinary(text), dtype=np.uint16)
            else:
                pieces.append(text.split(" "))
                where.append(i)
        for i, words in zip(where, pieces, strict=True):
            head = np.array(self.fast.encode_ordinary(words[0]), dtype=np.uint16)
            rest = words[1:]
            get = self.at.get
            found = [get(w, -1) for w in rest]
            if -1 in found:
                self._learn({w for w, k in zip(rest, found, strict=True) if k < 0} if len(self.at) + len(rest) <= CACHE_WORDS else set(rest))
                get = self.at.get
                found = [get(w, -1) for w in rest]
            at = np.array(found, dtype=np.int64)
            count = self.count[at]
            ends = np.cumsum(count)
            total = int(ends[-1]) if len(ends) else 0
            out[i] = np.concatenate((head, self.flat[np.repeat(self.begin[at] - ends + count, count) + np.arange(total)]))
        return out  # type: ignore[return-value]


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    """One for each worker process and file."""
    return ByteBpe(path)
