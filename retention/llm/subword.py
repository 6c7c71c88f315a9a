"""Words and character n-grams of many texts at once, as numpy arrays of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def char_table(is_word: Callable[[str], bool]) -> np.ndarray:
    """Per code point, whether it belongs to a word."""
    return np.fromiter((not 0xD800 <= c < 0xE000 and is_word(chr(c)) for c in range(0x110000)), bool, 0x110000)


class Words:
    """The words of a list of texts: ``doc`` (index of the text) and ``key`` (hash) of each."""

    def __init__(self, texts: list[str], table: np.ndarray):
        joined = "\n" + "\n".join(texts) + "\n"  # a line feed is in no word
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        self.inside = inside = table[codes]
        edge = np.diff(inside.view(np.int8))
        self.start, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
        self.length = end - self.start
        self.codes = np.where(inside, codes, 0).astype(np.uint64)
        heads = np.cumsum([0, *[len(t) + 1 for t in texts]]) + 1
        self.doc = np.searchsorted(heads, self.start, "right") - 1
        self.of = np.cumsum(edge == 1) - 1  # word of the character after each place but the last
        if not len(self.start):
            self.key = np.zeros(0, np.uint64)
            return
        chars = np.flatnonzero(inside)
        first = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        place = np.arange(len(chars)) - np.repeat(first, self.length) + 1
        terms = mix64(self.codes[chars] * _M1 + place.astype(np.uint64) * _M3)
        self.key = mix64(np.add.reduceat(terms, first))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, hash) of every n-gram; a word's neighbours outside count as one boundary mark."""
        inside, codes, count = self.inside, self.codes, len(self.codes) - n + 1
        if count <= 0 or not len(self.start):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if n == 1:
            at = np.flatnonzero(inside)
            return self.of[at - 1], mix64(codes[at] * _M1 + np.uint64(1))
        if n == 2:
            valid = inside[:-1] | inside[1:]
            at = np.flatnonzero(valid)
            word = np.where(inside[at + 1], self.of[at], self.of[np.maximum(at - 1, 0)])
        else:
            valid = inside[1:count + 1].copy()
            for k in range(2, n - 1):
                valid &= inside[k:k + count]
            at = np.flatnonzero(valid)
            word = self.of[at]
        h = codes[at]
        for k in range(1, n):
            h = h * _M1 + codes[at + k]
        return word, mix64(h + np.uint64(n))


def chunks(texts: list[str | None], chars: int = 200_000):
    """Runs of texts of about ``chars`` characters, so the arrays of a run stay in cache."""
    run, size = [], 0
    for t in texts:
        run.append(t or "")
        size += len(run[-1]) + 1
        if size >= chars:
            yield run
            run, size = [], 0
    if run:
        yield run
