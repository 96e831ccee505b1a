"""A packed R-tree over count vectors and its self-join by an overlap bound."""

from __future__ import annotations

import numpy as np

LEAF = 16


def count_vectors(sets: list[np.ndarray], groups: int) -> np.ndarray:
    """How many members of each set fall in each of ``groups`` hash groups."""
    n = np.array([len(s) for s in sets], np.int64)
    every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), n)
    group = (every % np.uint64(groups)).astype(np.int64)
    return np.bincount(owner * groups + group, minlength=len(sets) * groups).reshape(len(sets), groups).astype(np.int32)


def needed(a, b, percent: int):
    """Least intersection of sets of sizes a and b that link: 100 * i >= percent * (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


class RTree:
    """Points packed into leaves by sort-tile-recursive order (size, then the widest coordinates); inner nodes bound LEAF children.

    A node keeps, of all points below it, the coordinate-wise maximum and the least and largest size. Two
    points share at most the sum of their coordinate-wise minima, and two nodes no more than the sum of the
    minima of their maxima.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        wide = np.argsort(-points.var(0), kind="stable")[:2] if len(points) else []
        slabs = max(1, int(np.sqrt(len(points) / LEAF)))
        order = np.argsort(sizes, kind="stable")
        per = -(-len(points) // slabs)
        self.order = np.concatenate([part[np.lexsort(tuple(points[part][:, w] for w in wide))] if len(wide) else part for part in (order[i : i + per] for i in range(0, len(order), per))]) if len(points) else order
        self.levels = []
        low, high, top = sizes[self.order], sizes[self.order], points[self.order]
        while len(low) > 1 or not self.levels:
            at = np.arange(0, len(low), LEAF)
            if not len(at):
                break
            low, high, top = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(top, at, axis=0)
            self.levels.append((low, high, top))

    def candidates(self, other: RTree, percent: int):
        """Blocks (rows here, rows there) of points whose bound reaches the needed overlap; for a self-join each pair once."""
        if not self.levels or not other.levels:
            return
        same = self is other
        depth = max(len(self.levels), len(other.levels))
        a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
        for level in range(depth - 1, -1, -1):
            mine, its = (t.levels[min(level, len(t.levels) - 1)] for t in (self, other))
            keep = self._reach(mine, its, a, b, percent)
            a, b = a[keep], b[keep]
            if level:
                down_a, down_b = level < len(self.levels), level < len(other.levels)
                a, b = self._expand(a, b, len(self.levels[level - 1][0]) if down_a else 0, len(other.levels[level - 1][0]) if down_b else 0)
                if same:
                    a, b = a[a <= b], b[a <= b]
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            x, y = self.order[i * LEAF : (i + 1) * LEAF], other.order[j * LEAF : (j + 1) * LEAF]
            bound = np.minimum(self.points[x][:, None, :], other.points[y][None, :, :]).sum(2)
            ok = bound >= needed(self.sizes[x][:, None], other.sizes[y][None, :], percent)
            if same and i == j:
                ok &= np.tri(len(x), len(y), -1, dtype=bool).T
            p, q = np.nonzero(ok)
            if len(p):
                yield x[p], y[q], bound[p, q]

    @staticmethod
    def _reach(mine, its, a, b, percent):
        low_a, high_a, low_b, high_b = mine[0][a], mine[1][a], its[0][b], its[1][b]
        keep = (100 * high_a >= percent * low_b) & (100 * high_b >= percent * low_a)
        for i in range(0, len(a), 4096):
            s = slice(i, i + 4096)
            keep[s] &= np.minimum(mine[2][a[s]], its[2][b[s]]).sum(1) >= needed(low_a[s], low_b[s], percent)
        return keep

    @staticmethod
    def _expand(a, b, na, nb):
        """Children of node pairs; a side without a level below stays as it is (na or nb is 0)."""
        ca = [a] if not na else [a * LEAF + k for k in range(LEAF)]
        cb = [b] if not nb else [b * LEAF + k for k in range(LEAF)]
        x = np.concatenate([p for p in ca for _ in cb])
        y = np.concatenate([q for _ in ca for q in cb])
        ok = np.ones(len(x), bool)
        if na:
            ok &= x < na
        if nb:
            ok &= y < nb
        return x[ok], y[ok]


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


def links(sets: list[np.ndarray], percent: int, groups: int = 64, split: int | None = None) -> tuple[list[tuple[int, int]], Union]:
    """Verified links that connect all that is linked: pairs already connected are not looked at again.

    With ``split``, only pairs across sets[:split] and sets[split:] are joined.
    """
    union, found = Union(len(sets)), []
    sizes = np.array([len(s) for s in sets], np.int64)
    points = count_vectors(sets, groups)

    def tree(lo, hi):
        return RTree(points[lo:hi], sizes[lo:hi])

    if split is None:
        t = tree(0, len(sets))
        blocks = t.candidates(t, percent)
        shift = 0
    else:
        blocks = tree(0, split).candidates(tree(split, len(sets)), percent)
        shift = split
    for x, y, bound in blocks:
        for k in np.argsort(-bound, kind="stable").tolist():
            i, j = int(x[k]), int(y[k]) + shift
            if union.find(i) == union.find(j):
                continue
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                union.join(i, j)
                found.append((i, j))
    return found, union
