"""R-tree of integer vectors, packed by sort-tile-recursive, and best-first search by inner product in score windows.

The numpy half of hard-negative mining: one tree holds the rows of one tile, of which a task reads one at a time.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np

LEAF, FANOUT = 64, 16


def tiles(vectors: np.ndarray, rows: np.ndarray, leaves: int, axes: Sequence[int]) -> Iterator[np.ndarray]:
    """Sort by the first axis, cut into slabs of whole leaves, and go on in every slab with the next axis."""
    if leaves <= 1:
        yield rows
        return
    if not axes:
        axes = [0]
    slabs = leaves if len(axes) == 1 else int(np.ceil(leaves ** (1 / len(axes)) - 1e-9))
    per_slab = -(-leaves // slabs)
    rows = rows[np.argsort(vectors[rows, axes[0]], kind="stable")]
    for i in range(0, len(rows), per_slab * LEAF):
        part = rows[i : i + per_slab * LEAF]
        yield from tiles(vectors, part, -(-len(part) // LEAF), axes[1:])


def str_order(vectors: np.ndarray) -> np.ndarray:
    """The rows in the order of their leaves: every ``LEAF`` rows are one, the last may be shorter."""
    n, dims = vectors.shape
    leaves = -(-n // LEAF)
    if leaves <= 1 or dims == 0:
        return np.arange(n)
    spread = np.argsort(-vectors.var(axis=0), kind="stable")
    parts = list(tiles(vectors, np.arange(n), leaves, [int(a) for a in spread[: max(1, int(np.ceil(np.log2(leaves))))]]))
    return np.concatenate(parts)


def exact_type(*arrays: np.ndarray) -> type:
    """float64 if no sum of products can pass its 53 bits, which lets BLAS do the work; int64 otherwise."""
    largest = max([1.0, *(float(np.abs(a.astype(float)).max()) for a in arrays if a.size)])
    return np.float64 if largest * largest * max(1, arrays[0].shape[-1]) < 2.0**52 else np.int64


class Tree:
    """Boxes of all levels over rows in leaf order; ``levels[0]`` holds the leaves, the last level one root."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        starts = np.arange(0, len(vectors), LEAF)
        self.levels = [(np.minimum.reduceat(vectors, starts), np.maximum.reduceat(vectors, starts))]
        while len(self.levels[-1][0]) > 1:
            low, high = self.levels[-1]
            starts = np.arange(0, len(low), FANOUT)
            self.levels.append((np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)))

    def intervals(self, queries: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per level the least and the largest inner product of each query with a point of each box.

        A coordinate of the box between ``lo`` and ``hi`` adds between ``min(q*lo, q*hi)`` and ``max(q*lo, q*hi)``.
        """
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        return [(up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T) for lo, hi in self.levels]


class Best:
    """The first ``k`` of what was added: higher scores first, then lower ``tie``."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    def kth(self) -> float:
        return self.heap[0][0] if len(self.heap) == self.k else -np.inf

    def add(self, score: int, tie: int) -> None:
        item = (score, -tie)
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, item)
        elif item > self.heap[0]:
            heapq.heapreplace(self.heap, item)


def search(tree: Tree, bounds: Sequence[tuple[np.ndarray, np.ndarray]], query: np.ndarray, allowed: np.ndarray, windows: Sequence[tuple[float, float]], k: int, tie: np.ndarray) -> tuple[list[list[tuple[int, int]]], int]:
    """Per window the first ``k`` allowed rows with ``low <= score <= high``, as ``(score, row)``, and the leaves read.

    ``bounds``: the intervals of this query, per level. Boxes are taken from a queue in order of their largest score.
    A box is dropped if for every window it lies outside or strictly below the kth score; an equal one may still
    hold an earlier row. ``tie``: the order of the rows at equal scores.
    """
    best, read = [Best(k) for _ in windows], 0

    def wanted(low: float, high: float) -> bool:
        return any(high >= lo and low <= hi and high >= b.kth() for (lo, hi), b in zip(windows, best))

    top = len(tree.levels) - 1
    queue = [(-bounds[top][1][0], top, 0)]
    while queue:
        minus, level, node = heapq.heappop(queue)
        low = bounds[level][0][node]
        if not wanted(low, -minus):
            continue
        if level:
            lows, highs = bounds[level - 1]
            for child in range(node * FANOUT, min((node + 1) * FANOUT, len(lows))):
                if wanted(lows[child], highs[child]):
                    heapq.heappush(queue, (-highs[child], level - 1, child))
            continue
        read += 1
        part = slice(node * LEAF, (node + 1) * LEAF)
        scores = tree.vectors[part] @ query
        free = allowed[part]
        for (lo, hi), b in zip(windows, best):
            for i in np.flatnonzero(free & (scores >= lo) & (scores <= hi) & (scores >= b.kth())):
                b.add(int(scores[i]), int(tie[part][i]))
    place = np.argsort(tie)
    return [[(s, int(place[-t])) for s, t in b.heap] for b in best], read
