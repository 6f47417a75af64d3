"""Optimal one-to-one assignment on a sparse graph of scores."""

from __future__ import annotations

import heapq

import numpy as np

#: Scores are compared in millionths. Of assignments with equal sums, that with the larger sum of ties is taken.
SCALE, TIES = 1_000_000, 1 << 16
_UNIT = 1 << 20


def weights(score: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """What an edge adds to an assignment, as an integer; tie: from 0 to TIES - 1."""
    return np.rint(score * SCALE).astype(np.int64) * _UNIT + tie.astype(np.int64) % TIES


def best_pairs(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Indexes of the edges (a[k], b[k], weight[k] > 0) of a matching with the largest sum of weights.

    Each end of side a in turn takes the cheapest augmenting path over the edges that there are, to a free end of
    side b or to an end of side a that is left alone. Potentials keep the paths' steps at no negative cost, so the
    search stays where it begins, and its memory grows with the edges, not with the ends of both sides.
    """
    keep = np.flatnonzero(weight > 0)
    left, x = np.unique(a[keep], return_inverse=True)
    right, y = np.unique(b[keep], return_inverse=True)
    order = np.lexsort((-weight[keep], x))
    begin = np.searchsorted(x[order], np.arange(len(left) + 1)).tolist()
    ends, edge = y[order].tolist(), keep[order].tolist()
    most = int(weight[keep].max()) if len(keep) else 0
    cost = (most - weight[keep][order]).tolist()
    alone = most  # what it costs an end of side a to have no edge
    u, v = [0] * len(left), [0] * len(right)
    owner: list[int] = [-1] * len(right)
    taken: list[int] = [-1] * len(left)  # the edge's place in order
    for start in range(len(left)):
        near: dict[int, int] = {}
        came: dict[int, tuple[int, int]] = {}
        done: list[int] = []
        heap: list[tuple[int, int]] = []
        at, so_far = start, 0
        stop, end = (alone - u[start], None)
        give_up = start
        while True:
            if (cheaper := so_far + alone - u[at]) < stop:
                stop, give_up = cheaper, at
            base = so_far - u[at]
            for k in range(begin[at], begin[at + 1]):
                j = ends[k]
                through = base + cost[k] - v[j]
                if through < stop and through < near.get(j, stop):
                    near[j], came[j] = through, (at, k)
                    heapq.heappush(heap, (through, j))
            while heap and heap[0][0] != near[heap[0][1]]:
                heapq.heappop(heap)
            if not heap or heap[0][0] >= stop:
                break
            so_far, j = heapq.heappop(heap)
            near[j] = -1 - so_far  # done
            if owner[j] < 0:
                stop, end = so_far, j
                break
            done.append(j)
            at = owner[j]
        u[start] += stop
        for j in done:
            gap = stop - (-1 - near[j])
            v[j] -= gap
            u[owner[j]] += gap
        if end is None:  # give_up is left alone, and what it had goes to the one that came for it
            if give_up == start:
                continue
            end, taken[give_up] = ends[taken[give_up]], -1
        while True:
            at, k = came[end]
            owner[end], before, taken[at] = at, taken[at], k
            if at == start:
                break
            end = ends[before]
    return np.array(sorted(edge[k] for k in taken if k >= 0), np.int64)
