"""Words as 64-bit hashes, and hashes of runs of words."""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Distinct words a worker remembers; the table is emptied when full.
WORDS = 150_000
_M, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(32)


class Words(dict):
    """The hash of a word."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= WORDS:
                self.clear()
            self[word] = h
        return h

    def of(self, text: bytes) -> np.ndarray:
        found = WORD.findall(text)
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> _B) * _A
    return x ^ x >> _B


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k words, by its first word; none where there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = mixed(words[:n])
    for j in range(1, k):
        h = mixed(h * _M + words[j : n + j])
    return h


@cache
def shared_words() -> Words:
    """The worker process's own table."""
    return Words()
