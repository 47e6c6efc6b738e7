"""An FM-index in numpy: a suffix array's Burrows-Wheeler transform under a wavelet matrix, with sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes, by doubling from as many symbols as one number holds. The last symbol must be the smallest and occur once."""
    n = len(text)
    bits = max(1, int(text.max()).bit_length()) if n else 1
    step = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for i in range(min(step, n)):
        key[: n - i] |= text[i:].astype(np.int64) << (bits * (step - 1 - i))
    while True:
        order = np.argsort(key)
        new = np.r_[False, np.diff(key[order]) != 0]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        second = np.zeros(n, np.int64)
        second[: max(0, n - step)] = rank[step:] + 1
        key = rank * (n + 1) + second
        step *= 2


class FMIndex:
    """Counts and locates phrases in a text of small integers; symbol 0 is reserved for the end."""

    def __init__(self, text: np.ndarray, every: int = 16) -> None:
        text = np.append(np.asarray(text, np.int64), 0)
        sa = suffix_array(text)
        self.n = len(text)
        bwt = text[sa - 1]
        sigma = int(text.max()) + 1
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.levels = max(1, (sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        row = bwt
        for level in reversed(range(self.levels)):
            bit = (row >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(self.n - bit.sum()))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        # of the suffix positions only every n-th is kept; others are reached by walking back
        sampled = sa % every == 0
        self.sampled = sampled
        self.sample_rank = np.concatenate([[0], np.cumsum(sampled)]).astype(np.int32)
        self.samples = sa[sampled]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform before each place."""
        lo, hi = np.zeros_like(at), at.copy()
        for i in range(self.levels):
            ones, z = self.ones[i], self.zeros[i]
            bit = (symbol >> (self.levels - 1 - i)) & 1
            a, b = ones[lo], ones[hi]
            lo, hi = np.where(bit == 1, z + a, lo - a), np.where(bit == 1, z + b, hi - b)
        return hi - lo

    def symbol_at(self, row: np.ndarray) -> np.ndarray:
        """The transform's symbols at rows."""
        at, out = row.copy(), np.zeros_like(row)
        for i in range(self.levels):
            ones, z = self.ones[i], self.zeros[i]
            a = ones[at]
            bit = ones[at + 1] - a
            out = out * 2 + bit
            at = np.where(bit == 1, z + a, at - a)
        return out

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of phrases of one length (a row each): the row ranges [lo, hi) of the suffixes they begin."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for c in np.asarray(phrases, np.int64).T[::-1]:
            known = c < len(self.before) - 1
            c = np.where(known, c, 0)
            lo, hi = self.before[c] + self.rank(c, lo), self.before[c] + self.rank(c, hi)
            hi = np.where(known, hi, lo)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back to a sampled one."""
        rows, out, steps = rows.copy(), np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            r = rows[todo]
            hit = self.sampled[r]
            out[todo[hit]] = self.samples[self.sample_rank[r[hit]]] + steps[todo[hit]]
            todo = todo[~hit]
            r = rows[todo]
            c = self.symbol_at(r)
            rows[todo] = self.before[c] + self.rank(c, r)
            steps[todo] += 1
        return out
