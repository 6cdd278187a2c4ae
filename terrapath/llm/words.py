"""Per-word values, computed once per distinct word of a task and looked up afterwards."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

#: A word is a maximal run of letters and digits.
WORD = re.compile(r"[^\W_]+")


class WordRows(dict):
    """Maps words to rows of a float table; ``make`` computes the rows of a list of new words.

    A memo only: it is emptied once it holds ``limit`` words, so memory stays bounded and no
    result depends on it.
    """

    def __init__(self, make: Callable[[list[str]], np.ndarray], limit: int = 200_000):
        super().__init__()
        self.make, self.limit, self.new, self.rows = make, limit, [], None

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at

    def begin(self) -> None:
        """Call before a batch: empties a full table."""
        if len(self) > self.limit:
            self.clear()
            self.rows, self.new = None, []

    def ids(self, words: list[str]) -> np.ndarray:
        """Row numbers of the words; ``rows`` then holds all of them."""
        found = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            made = self.make(self.new)
            used = len(self) - len(self.new)
            if self.rows is None or len(self) > len(self.rows):
                grown = np.zeros((max(1024, 2 * len(self)), made.shape[1]), made.dtype)
                if used:
                    grown[:used] = self.rows[:used]
                self.rows = grown
            self.rows[used : len(self)] = made
            self.new = []
        return found


def join_words(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of ``<word>`` after ``<word>``, and where each begins (one more entry for the end)."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    points = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points.astype(np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def ngram_hashes(points: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and word number of every character n-gram that lies inside a word."""
    if len(points) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = len(points) - n + 1
    h = np.full(size, n, np.uint64)
    for i in range(n):
        h = h * np.uint64(0x100000001B3) + points[i : i + size]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9E3779B97F4A7C15)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[:size]
    inside = np.arange(size) + n <= starts[owner + 1]
    return h[inside], owner[inside]
