"""FM-index over a sequence of small integers: wavelet-tree ranks, backward search, sampled suffix positions (numpy)."""

from __future__ import annotations

import numpy as np

SAMPLE = 4


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by prefix doubling."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order, width = np.argsort(rank, kind="stable"), 1
    while n and rank[order[-1]] < n - 1:
        second = np.zeros(n, np.int64)
        second[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        moved = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank[order] = moved
        width *= 2
    return order


class WaveletTree:
    """Levels of bits, highest first, each level stably split into zeros and ones; ``ones`` holds counts before each place."""

    def __init__(self, seq: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.ones, self.zeros, x = [], [], seq
        for level in range(self.bits - 1, -1, -1):
            b = (x >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(b, dtype=np.int32)]))
            self.zeros.append(int(len(x) - self.ones[-1][-1]))
            x = np.concatenate([x[b == 0], x[b == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        lo, hi = np.zeros_like(end), end
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            one, ones = ((symbol >> level) & 1).astype(bool), self.ones[k]
            lo = np.where(one, self.zeros[k] + ones[lo], lo - ones[lo])
            hi = np.where(one, self.zeros[k] + ones[hi], hi - ones[hi])
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for k in range(self.bits):
            ones = self.ones[k]
            b = ones[at + 1] - ones[at]
            out = out * 2 + b
            at = np.where(b == 1, self.zeros[k] + ones[at], at - ones[at])
        return out


class FMIndex:
    """Index of ``text`` (symbols from 1; 0 ends a run and matches nothing)."""

    def __init__(self, text: np.ndarray):
        text = np.concatenate([text, [0]]).astype(np.int64)
        order = suffix_array(text)
        last = text[order - 1]
        self.n, top = len(text), int(text.max(initial=0))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.tree = WaveletTree(last, top)
        # the symbols that end runs are equal in the text; suffixes that start with them are told apart by what follows
        kept = (order % SAMPLE == 0) | (last == 0)
        self.kept = kept
        self.kept_before = np.cumsum(kept) - kept
        self.position = order[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of the suffixes that start with each phrase (a matrix of symbols, a phrase a row)."""
        m, length = phrases.shape
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        top = len(self.before) - 2
        for j in range(length - 1, -1, -1):
            c = phrases[:, j]
            live = (lo < hi) & (c <= top)
            lo[~live] = hi[~live] = 0
            k = np.flatnonzero(live)
            if not len(k):
                break
            start = self.before[c[k]]
            lo[k], hi[k] = start + self.tree.rank(c[k], lo[k]), start + self.tree.rank(c[k], hi[k])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row: step back through the text until a row whose position was kept."""
        rows, steps = rows.astype(np.int64), np.zeros(len(rows), np.int64)
        while len(k := np.flatnonzero(~self.kept[rows])):
            c = self.tree.access(rows[k])
            rows[k] = self.before[c] + self.tree.rank(c, rows[k])
            steps[k] += 1
        return self.position[self.kept_before[rows]] + steps
