"""An FM-index over integer text: suffix array, Burrows-Wheeler transform, wavelet-tree ranks, sampled positions.

Symbol 0 ends a run; no pattern contains it, and each of its occurrences counts as a different, smaller symbol, so that
suffixes never compare beyond their own run.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; the number of rounds is the logarithm of the longest repeat inside runs."""
    n = len(text)
    zeros = text == 0
    rank = text.astype(np.int64) + int(zeros.sum())
    rank[zeros] = np.arange(int(zeros.sum()))
    order = np.argsort(rank, kind="stable")
    h = 1
    while True:
        first = np.empty(n, bool)
        first[:1] = True
        ordered = rank[order]
        first[1:] = ordered[1:] != ordered[:-1]
        if h > 1:
            second = beyond[order]  # noqa: F821  (bound in the round before)
            first[1:] |= second[1:] != second[:-1]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(first) - 1
        rank = new
        if first.all():
            return order
        beyond = np.full(n, -1, np.int64)
        beyond[: max(0, n - h)] = rank[h:]
        order = np.argsort(rank * (n + 1) + beyond + 1, kind="stable")
        h *= 2


class WaveletTree:
    """Ranks of symbols, one bit vector a level (the levelwise form: zeros move before ones)."""

    def __init__(self, text: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        now = text
        for level in range(self.levels - 1, -1, -1):
            bit = (now >> level) & 1
            ones = np.zeros(len(now) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(now) - int(ones[-1]))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        self.start = self._down(np.arange(symbols), np.zeros(symbols, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            ones = self.ones[k][at].astype(np.int64)
            at = np.where((symbol >> level) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of symbol in text[:at]."""
        return self._down(symbol, at) - self.start[symbol]


class FMIndex:
    def __init__(self, text: np.ndarray, symbols: int, sample: int = 16):
        """text: ends with 0.  sample: the distance of the text positions whose suffixes are kept."""
        sa = suffix_array(text)
        self.bwt = text[sa - 1]  # of position 0 the last symbol, which is 0
        self.tree = WaveletTree(self.bwt, symbols)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.kept = (sa % sample == 0) | (self.bwt == 0)  # a walk back stops where its run begins
        self.slot = np.cumsum(self.kept) - 1
        self.places = sa[self.kept]
        self.n = len(text)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """patterns: one a row, of one length.  The ranges of suffixes that begin with each, by backward search."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.n, np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[:, k]
            lo = self.below[c] + self.tree.rank(c, lo)
            hi = self.below[c] + self.tree.rank(c, hi)
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix array: walk back to a kept one, and count the steps."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        todo = np.flatnonzero(~self.kept[rows])
        while len(todo):
            c = self.bwt[rows[todo]]
            rows[todo] = self.below[c] + self.tree.rank(c, rows[todo])
            steps[todo] += 1
            todo = todo[~self.kept[rows[todo]]]
        return self.places[self.slot[rows]] + steps
