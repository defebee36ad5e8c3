"""A bidirectional FM-index over word ids, searched for many patterns at once.

The text is an array of ids where 0 stands for a break between pieces; no pattern holds a break. Two
sides are kept: the Burrows-Wheeler transform of the text and of its reversal, each with the starts of
the ids' blocks (C) and the sorted places of every id in the transform, so that an id's rank is a binary
search. A pattern is a pair of intervals of one size. Extending it by the words before it narrows the
interval of the text's side by ranks and shifts that of the reversal by the number of smaller words, and
the other way round for the words after it.

Suffixes are sorted by their first ``depth`` ids, which suffices for patterns of up to ``depth`` words:
an interval's borders separate suffixes that differ within them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def suffix_order(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places sorted by the ``depth`` ids that begin there (0 beyond the end); ties in text order."""
    span = int(ids.max(initial=0)) + 1
    ahead = lambda k: np.concatenate([ids[k:], np.zeros(min(k, len(ids)), np.int64)])
    key, top = ahead(depth - 1).astype(np.int64), span
    for k in range(depth - 2, -1, -1):
        if top > (1 << 62) // span:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            top = int(key.max(initial=0)) + 1
        key += ahead(k) * top
        top *= span
    return np.argsort(key, kind="stable")


class Side:
    """The transform of one direction."""

    def __init__(self, ids: np.ndarray, depth: int):
        self.n, self.span = len(ids), int(ids.max(initial=0)) + 1
        self.bwt = ids[suffix_order(ids, depth) - 1]
        counts = np.bincount(ids, minlength=self.span)
        self.c = np.cumsum(counts) - counts
        self.places = np.sort(self.bwt * np.int64(self.n + 1) + np.arange(self.n))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands in the first ``at`` places of the transform."""
        return np.searchsorted(self.places, symbol * np.int64(self.n + 1) + at) - self.c[symbol]

    def before(self, low: np.ndarray, size: np.ndarray):
        """(interval, id, rows with it, rows with smaller ids) for every id in the intervals."""
        begin = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(low)), size)
        key = owner * np.int64(self.span) + self.bwt[np.arange(len(owner)) + np.repeat(low - begin, size)]
        key.sort()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        owner, symbol = np.divmod(key[first], self.span)
        return owner, symbol, np.diff(np.append(first, len(key))), first - begin[owner]


@dataclass
class Patterns:
    words: np.ndarray  # a row of ids per pattern
    low: np.ndarray  # interval of the text's side
    mirrored: np.ndarray  # interval of the reversal's side
    size: np.ndarray

    def where(self, kept: np.ndarray) -> "Patterns":
        return Patterns(self.words[kept], self.low[kept], self.mirrored[kept], self.size[kept])


class BidirectionalIndex:
    def __init__(self, ids: np.ndarray, depth: int):
        text = np.concatenate([[0], ids, [0]]).astype(np.int64)
        self.text, self.mirror = Side(text, depth), Side(text[::-1], depth)

    def words(self) -> Patterns:
        ids = np.arange(1, self.text.span, dtype=np.int64)
        size = np.diff(np.append(self.text.c, self.text.n))[1:]
        found = Patterns(ids[:, None], self.text.c[1:], self.mirror.c[1:], size)
        return found.where(size > 0)

    def extend_left(self, p: Patterns) -> Patterns:
        owner, word, size, smaller = self.text.before(p.low, p.size)
        real = word > 0
        owner, word, size, smaller = owner[real], word[real], size[real], smaller[real]
        return Patterns(np.column_stack([word, p.words[owner]]),
                        self.text.c[word] + self.text.rank(word, p.low[owner]), p.mirrored[owner] + smaller, size)

    def extend_right(self, p: Patterns) -> Patterns:
        owner, word, size, smaller = self.mirror.before(p.mirrored, p.size)
        real = word > 0
        owner, word, size, smaller = owner[real], word[real], size[real], smaller[real]
        return Patterns(np.column_stack([p.words[owner], word]), p.low[owner] + smaller,
                        self.mirror.c[word] + self.mirror.rank(word, p.mirrored[owner]), size)
