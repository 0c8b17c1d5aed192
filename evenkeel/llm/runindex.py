"""A run-length index of many short byte strings, for the matches of the strings with one another.

The strings, each with an end of its own, are one text. Its Burrows-Wheeler
transform is kept as runs; at the border of two runs the index samples the text
positions on both sides (the end of one run, the head of the next) and the length
that the two suffixes share. That is all that matching statistics need: between
two sampled positions the best match of a text position is that of the last
sample, moved on by as many places, and shorter by as many. So the statistics
stream over the text as phrases (start, source, length), of which a repetitive
text has few.

A byte of 0xFF does not occur in UTF-8, so bytes plus one leave 0 for the ends.
"""

from __future__ import annotations

import numpy as np

WORD = 8


class Strings:
    """Byte strings laid out one after the other, with an end (0) after each."""

    def __init__(self, raw: np.ndarray, sizes: np.ndarray):
        self.sizes = sizes.astype(np.int64)
        self.low = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.n = int(self.sizes.sum()) + len(self.sizes)
        inside = np.ones(self.n, bool)
        inside[self.low + self.sizes] = False
        self.text = np.zeros(self.n, np.uint8)
        self.text[inside] = raw + np.uint8(1)
        # bytes from each place to its string's end
        self.left = (np.repeat(self.low + self.sizes, self.sizes + 1) - np.arange(self.n)).astype(np.int32)
        self.words = self._packed()

    def _packed(self) -> np.ndarray:
        """The next WORD bytes of each place as a number, without what follows its string's end."""
        packed, width = self.text.astype(np.uint64), 1
        while width < WORD:
            later = np.zeros(self.n, np.uint64)
            later[: max(0, self.n - width)] = packed[width:]
            later[self.left <= width] = 0
            packed, width = (packed << np.uint64(8 * width)) | later, 2 * width
        return packed

    def some(self, chosen: np.ndarray) -> "Strings":
        held = np.repeat(chosen, self.sizes + 1) & (self.left > 0)
        return Strings(self.text[held] - np.uint8(1), self.sizes[chosen])

    def word(self, at: np.ndarray) -> np.ndarray:
        return self.words[np.minimum(at, self.n - 1)]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many bytes the suffixes at a and at b share, up to the ends of their strings."""
        most = np.minimum(self.left[a], self.left[b]).astype(np.int64)
        out, open_ = np.zeros(len(a), np.int64), np.arange(len(a))
        while len(open_):
            x = self.word(a[open_] + out[open_]) ^ self.word(b[open_] + out[open_])
            same = np.full(len(open_), WORD)
            for k in range(WORD):
                same[x >= np.uint64(1) << np.uint64(8 * (WORD - 1 - k))] -= 1
            same[x == 0] = WORD
            out[open_] += same
            open_ = open_[(same == WORD) & (out[open_] < most[open_])]
        return np.minimum(out, most)


def _heads(keys: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], keys[1:] != keys[:-1]])


def _starts(heads: np.ndarray) -> np.ndarray:
    """For each entry the place of the last head up to it."""
    return np.maximum.accumulate(np.where(heads, np.arange(len(heads)), 0))


def suffix_order(strings: Strings) -> np.ndarray:
    """All places in the order of their suffixes; equal suffixes, which end with their strings, in order of place.

    Ranks are refined by doubling, only where they still tie and bytes are left.
    """
    n, left = strings.n, strings.left
    order = np.argsort(strings.words)
    heads = _heads(strings.words[order])
    rank = np.empty(n, np.int64)
    rank[order] = _starts(heads)
    alone = heads & np.append(heads[1:], True)
    open_, have = order[~alone], WORD
    while True:
        open_ = open_[left[open_] >= have]
        if not len(open_):
            break
        later = np.where(left[open_] > have, rank[np.minimum(open_ + have, n - 1)] + 1, 0)
        keys = (rank[open_] << 32) | later
        by = np.argsort(keys)
        open_, keys = open_[by], keys[by]
        heads, before = _heads(keys), keys >> 32
        rank[open_] = before + _starts(heads) - _starts(_heads(before))
        open_, have = open_[~(heads & np.append(heads[1:], True))], 2 * have
    return np.sort((rank << 32) | np.arange(n)) & 0xFFFFFFFF


class RunIndex:
    """Runs of the transform with the samples at their borders, sorted by text position."""

    def __init__(self, strings: Strings):
        order = suffix_order(strings)
        before = strings.text[order - 1]
        before[order == 0] = 0
        # an end is a symbol of its own, so what follows one begins a run
        head = _heads(before) | (before == 0)
        at = np.flatnonzero(head)
        self.symbols, self.lengths = before[at], np.diff(np.append(at, len(order)))
        start, source = order[at], order[at - 1]
        shared = strings.common(start, source)
        shared[at == 0] = 0
        by = np.argsort(start)
        self.n, self.start, self.source, self.shared = strings.n, start[by], source[by], shared[by]

    def statistics(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases (start, source, count): `count` places from start on match those from source on over `least` bytes or more."""
        room = np.diff(np.append(self.start, self.n))
        count = np.minimum(self.shared - least + 1, room)
        used = count > 0
        return self.start[used], self.source[used], count[used]


def repeated(strings: Strings, least: int) -> np.ndarray:
    """Places whose `least` bytes occur at a smaller place too, ascending."""
    start, source, count = RunIndex(strings).statistics(least)
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at, to = np.repeat(start, count) + step, np.repeat(source, count) + step
    # matches are chains; follow them to their ends, and keep the smallest place of each
    link = np.arange(strings.n)
    link[at] = to
    while True:
        further = link[link[at]]
        if np.array_equal(further, link[at]):
            break
        link[at] = further
    ends = link[at]
    first = np.arange(strings.n)
    np.minimum.at(first, ends, at)
    members = np.unique(np.concatenate([at, ends]))
    return members[first[link[members]] != members]
