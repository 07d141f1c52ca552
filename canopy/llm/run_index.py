"""A run-compressed Burrows-Wheeler transform of several byte strings, with sampled run ends.

Each string ends in a terminator of its own. The transform is kept as runs: symbol, first row and, sampled from the suffix
array, the positions at the first and last row of each run. Among suffixes in order, the longest match that a position has with the
suffix before it falls by exactly one from one position of the text to the next, except where a run begins; with the suffix after it,
except where a run ends. So the matches at the run ends, compared byte for byte, give the matching statistics of all
positions in one pass over the text. In repetitive strings there are few runs.

All steps are array operations over the whole index; memory is about 60 bytes per byte indexed while it is built.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def suffix_array(symbols: np.ndarray, packed: int = 4) -> np.ndarray:
    """Order of the suffixes of symbols (int64, unique terminators below all others), by prefix doubling.

    After the first round only suffixes that still share their rank are sorted again.
    """
    n = len(symbols)
    bits = int(symbols.max(initial=0)).bit_length() + 1
    packed = max(1, min(packed, 63 // bits))
    key = np.zeros(n, np.uint64)
    for k in range(packed):
        part = np.zeros(n, np.uint64)
        part[: max(n - k, 0)] = symbols[k:] + 1
        key = (key << np.uint64(bits)) | part
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    todo = np.argsort(key)
    key = key[todo]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[start, n])
    rank[todo] = np.repeat(start, sizes)
    todo = todo[np.repeat(sizes > 1, sizes)]
    h = packed
    while len(todo):
        old = rank[todo]
        key = (old.astype(np.uint64) << np.uint64(32)) | (rank[np.minimum(todo + h, n)] + 1).astype(np.uint64)
        order = np.argsort(key)
        todo, key, old = todo[order], key[order], old[order]
        new = np.r_[True, key[1:] != key[:-1]]
        start = np.flatnonzero(new)
        sizes = np.diff(np.r_[start, len(todo)])
        group = np.flatnonzero(np.r_[True, old[1:] != old[:-1]])
        before = np.repeat(group, np.diff(np.r_[group, len(todo)]))
        rank[todo] = old + np.repeat(start, sizes) - before
        todo = todo[np.repeat(sizes > 1, sizes)]
        h *= 2
    out = np.empty(n, np.int64)
    out[rank[:n]] = np.arange(n)
    return out


class RunIndex:
    """The index of strings of symbols of width bytes each (1 or 4). run_symbol, run_first: the transform; run_head, run_tail: positions sampled at each run's ends.

    Positions and lengths are in symbols.
    """

    def __init__(self, strings: Sequence[bytes], width: int = 1):
        m = len(strings)
        sizes = np.fromiter(map(len, strings), np.int64, m) // width
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        n = int(sizes.sum()) + m
        ends = self.starts + sizes
        data = np.frombuffer((b"\0" * width).join([*strings, b""]), np.uint8 if width == 1 else "<u4") if m else np.zeros(0, np.uint8)
        if width > 1:  # numbers in the order of the symbols
            data = np.unique(data, return_inverse=True)[1]
        symbols = data.astype(np.int64) + m
        symbols[ends] = np.arange(m)
        self.n = n
        self.left = np.repeat(ends, sizes + 1) - np.arange(n)  # symbols up to each position's terminator
        #: eight bytes' worth of symbols from each position on
        self.per, self.bits = 8 // width, 8 * width
        padded = np.r_[data, np.zeros(self.per, data.dtype)].astype(np.uint64)
        self.words = np.zeros(n, np.uint64)
        for k in range(self.per):
            self.words = (self.words << np.uint64(self.bits)) | padded[k : k + n]
        sa = suffix_array(symbols)
        bwt = symbols[sa - 1]
        self.run_first = np.flatnonzero(np.r_[True, bwt[1:] != bwt[:-1]]) if n else np.zeros(0, np.int64)
        last = np.r_[self.run_first[1:], n][: len(self.run_first)] - 1
        self.run_symbol = bwt[self.run_first]
        self.run_head, self.run_tail = sa[self.run_first], sa[last]
        # the neighbours outside the run, -1 at the ends of the order
        self.before_head = np.where(self.run_first > 0, sa[self.run_first - 1], -1)
        self.after_tail = np.where(last + 1 < n, sa[np.minimum(last + 1, max(n - 1, 0))], -1)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at a and at b have in common; 0 where b is -1."""
        out = np.zeros(len(a), np.int64)
        most = np.where(b >= 0, np.minimum(self.left[a], self.left[np.maximum(b, 0)]), 0)
        todo = np.flatnonzero(most > 0)
        at = 0
        while len(todo):
            x, y = a[todo] + at, b[todo] + at
            differ = self.words[np.minimum(x, self.n - 1)] ^ self.words[np.minimum(y, self.n - 1)]
            same = (differ == 0) & (most[todo] > at + self.per)
            done = todo[~same]
            d = differ[~same]
            # equal leading symbols of a difference
            lead = np.full(len(d), self.per)
            for k in range(self.per):
                lead = np.where((lead == self.per) & ((d >> np.uint64(64 - self.bits * (k + 1))) & np.uint64((1 << self.bits) - 1) != 0), k, lead)
            out[done] = np.minimum(at + lead, most[done])
            todo = todo[same]
            at += self.per
        return out

    def matching_statistics(self) -> np.ndarray:
        """For each position, the length of the longest match that starts there and elsewhere, too."""
        best = np.zeros(self.n, np.int64)
        place = np.arange(self.n)
        for sampled, other in ((self.run_head, self.before_head), (self.run_tail, self.after_tail)):
            value = np.zeros(self.n, np.int64)
            last = np.zeros(self.n, np.int64)
            value[sampled] = self.common(sampled, other)
            last[sampled] = sampled
            last = np.maximum.accumulate(last)
            best = np.maximum(best, value[last] - (place - last))
        return best
