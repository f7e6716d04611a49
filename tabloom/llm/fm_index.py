"""FM-index of one shard of symbols: wavelet-tree ranks and sampled suffix positions (numpy)."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; the last symbol must be the unique smallest."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.r_[0, np.diff(text[order]) != 0])
    step = 1
    while rank[order[-1]] < n - 1:
        after = np.zeros(n, np.int64)
        after[:-step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        rank[order] = np.cumsum(np.r_[0, np.diff(key[order]) != 0])
        step *= 2
    return order


class WaveletTree:
    """Levelwise wavelet tree (most significant bit first) with cumulative bit counts."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.ones, self.zeros = [], []
        cur = symbols
        for b in range(self.bits - 1, -1, -1):
            bit = (cur >> b) & 1
            self.ones.append(np.r_[0, np.cumsum(bit, dtype=np.int32)].astype(np.int32))
            self.zeros.append(int(len(cur) - self.ones[-1][-1]))
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol c[k] before position i[k], for all k."""
        lo, hi = np.zeros_like(i), i
        for level in range(self.bits):
            one, zeros = self.ones[level], self.zeros[level]
            bit = ((c >> (self.bits - 1 - level)) & 1).astype(bool)
            lo = np.where(bit, zeros + one[lo], lo - one[lo])
            hi = np.where(bit, zeros + one[hi], hi - one[hi])
        return hi - lo


class FMIndex:
    """Index of ``text`` (symbols >= 1, of which 1 is a separator); 0 ends the text."""

    def __init__(self, text: np.ndarray, top: int, sample: int = 8):
        text = np.r_[text, 0].astype(np.int64)
        sa = suffix_array(text)
        self.n = len(text)
        self.last = text[sa - 1]                      # Burrows-Wheeler transform
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=top + 1))]
        self.tree = WaveletTree(self.last, top)
        self.held = sa % sample == 0                  # rows whose suffix position is kept
        self.slot = np.cumsum(self.held) - 1
        self.kept = sa[self.held]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of all phrases (padded rows of symbols), by backward search."""
        lo = np.zeros(len(lengths), np.int64)
        hi = np.full(len(lengths), self.n, np.int64)
        for j in range(int(lengths.max(initial=0))):
            on = np.flatnonzero((j < lengths) & (lo < hi))
            c = phrases[on, lengths[on] - 1 - j]
            lo[on] = self.before[c] + self.tree.rank(c, lo[on])
            hi[on] = self.before[c] + self.tree.rank(c, hi[on])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back to a kept position and add the steps."""
        out = np.empty(len(rows), np.int64)
        todo, cur, steps = np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            hit = self.held[cur]
            out[todo[hit]] = self.kept[self.slot[cur[hit]]] + steps
            todo, cur = todo[~hit], cur[~hit]
            c = self.last[cur]
            cur = self.before[c] + self.tree.rank(c, cur)
            steps += 1
        return out
