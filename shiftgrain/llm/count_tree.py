"""R-tree over count vectors: which sets can reach a Jaccard similarity at all.

The hashes of a set fall into a fixed number of groups; the counts by group are a point. The overlap
of two sets is at most the sum of the smaller counts, coordinate by coordinate, and the overlap of
any two members of two nodes is at most the same sum over the nodes' largest counts. Similarity
n/d of sets of sizes a and b needs an overlap of n (a + b) / (n + d).
"""

from __future__ import annotations

import numpy as np

GROUPS = 512
FANOUT = 16


def count_vector(hashes: np.ndarray) -> np.ndarray:
    return np.bincount((hashes & hashes.dtype.type(GROUPS - 1)).astype(np.int64), minlength=GROUPS).astype(np.int32)


class CountTree:
    """Points packed into nodes by size; each node keeps its largest counts and its range of sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, num: int = 4, den: int = 5):
        self.num, self.den = num, den
        self.order = np.lexsort((points[:, 1], points[:, 0], sizes))
        level = (points[self.order], sizes[self.order], sizes[self.order])
        self.levels = [level]
        while len(level[0]) > FANOUT:
            cuts = np.arange(0, len(level[0]), FANOUT)
            level = (np.maximum.reduceat(level[0], cuts), np.minimum.reduceat(level[1], cuts), np.maximum.reduceat(level[2], cuts))
            self.levels.append(level)

    def _reachable(self, depth: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of entries of one level can hold similar members."""
        most, low, high = self.levels[depth]
        fits = (self.den * high[a] >= self.num * low[b]) & (self.den * high[b] >= self.num * low[a])
        a, b = a[fits], b[fits]
        found = np.empty(len(a), bool)
        for k in range(0, len(a), 8192):
            x, y = a[k : k + 8192], b[k : k + 8192]
            overlap = np.minimum(most[x], most[y]).sum(axis=1)
            found[k : k + 8192] = (self.num + self.den) * overlap >= self.num * (low[x] + low[y])
        fits[fits] = found
        return fits

    def leaf_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs a <= b of leaves, nearest in size first, that can hold similar members."""
        if len(self.levels) == 1:
            return np.zeros(1, np.int64), np.zeros(1, np.int64)
        top = len(self.levels[-1][0])
        a, b = np.triu_indices(top)
        for depth in range(len(self.levels) - 1, 0, -1):
            keep = self._reachable(depth, a, b) | (a == b)
            a, b = a[keep], b[keep]
            if depth > 1:
                n = len(self.levels[depth - 1][0])
                x = (a[:, None, None] * FANOUT + np.arange(FANOUT)[None, :, None] + np.zeros(FANOUT, np.int64)).ravel()
                y = (b[:, None, None] * FANOUT + np.arange(FANOUT)[None, None, :] + np.zeros(FANOUT, np.int64)[:, None]).ravel()
                fits = (x <= y) & (y < n)
                a, b = x[fits], y[fits]
        first = np.argsort(b - a, kind="stable")
        return a[first], b[first]

    def candidates(self, labels: np.ndarray):
        """Yield arrays (i, j, bound of the overlap) of points that can be similar, leaf pair by leaf pair.

        Points whose entries of `labels` agree are left out; the caller may join labels in between.
        """
        n = len(self.order)
        for p, q in zip(*self.leaf_pairs()):
            a = np.arange(p * FANOUT, min(n, (p + 1) * FANOUT))
            b = np.arange(q * FANOUT, min(n, (q + 1) * FANOUT))
            la, lb = labels[self.order[a]], labels[self.order[b]]
            differ = la[:, None] != lb[None, :]
            if p == q:
                differ &= a[:, None] < b[None, :]
            x, y = np.nonzero(differ)
            if not len(x):
                continue
            x, y = a[x], b[y]
            keep = self._reachable(0, x, y)
            if keep.any():
                x, y = x[keep], y[keep]
                yield self.order[x], self.order[y], np.minimum(self.levels[0][0][x], self.levels[0][0][y]).sum(axis=1)


def similar(a: np.ndarray, b: np.ndarray, num: int = 4, den: int = 5) -> bool:
    """Whether two sorted sets of hashes reach Jaccard similarity num / den, in integers."""
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    both = int((a[at] == b).sum()) if len(a) else 0
    return den * both >= num * (len(a) + len(b) - both)
