"""Karmarkar-Karp multiway differencing of sizes into ``k`` parts.

A partial partition is a list of (sum, members) of its non-empty parts, largest sum first.
The two partial partitions with the largest spread are combined with opposite order, the
largest part of one with the smallest of the other, until one is left.
"""

from __future__ import annotations

import heapq

Parts = list[tuple[int, object]]


def _spread(parts: Parts, k: int) -> int:
    return parts[0][0] - (parts[-1][0] if len(parts) == k else 0)


def _opposed(a: Parts, b: Parts, k: int) -> Parts:
    overlap = len(a) + len(b) - k
    if overlap <= 0:
        merged = a + b
    else:
        # Zeros of one lie opposite the large parts of the other.
        alone_a, alone_b = len(a) - overlap, len(b) - overlap
        merged = a[:alone_a] + b[:alone_b]
        low_b = b[alone_b:][::-1]
        merged += [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[alone_a:], low_b)]
    merged.sort(key=lambda p: -p[0])
    return merged


def combine(partials: list[Parts], k: int) -> Parts:
    """One partition from many partial ones. Ties go by position, so a re-run gives the same."""
    heap = [(-_spread(p, k), i, p) for i, p in enumerate(partials) if p]
    heapq.heapify(heap)
    tick = len(partials)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        merged = _opposed(a, b, k)
        heapq.heappush(heap, (-_spread(merged, k), tick, merged))
        tick += 1
    return heap[0][2] if heap else []


def members(tree: object) -> list[int]:
    """Leaves of the pairs that ``combine`` has built, without recursion."""
    out, todo = [], [tree]
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            todo.extend(x)
        else:
            out.append(x)
    return out


def partition(sizes: list[int], k: int) -> list[list[int]]:
    """``k`` lists of positions in ``sizes`` with near-equal sums (some may be empty)."""
    parts = combine([[(s, i)] for i, s in enumerate(sizes)], k)
    out = [sorted(members(tree)) for _, tree in parts]
    return out + [[] for _ in range(k - len(out))]
