"""Hashes that are near each other, compared by numpy inside tasks that hold two blocks of them."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np

#: Bands of 16 bits of a hash.
BANDS = 4
#: Pairs that are looked at together: the arrays of so many stay in a core's cache.
TILE = 1 << 16
WIDE = 4096


def tiles(v: np.ndarray, u: np.ndarray, same: bool = False) -> Iterator[tuple[int, int, np.ndarray]]:
    """(i, j, distances) of all rectangles of v and u, which are unsigned; where both are the same those with i <= j are enough."""
    for j in range(0, len(u), WIDE):
        w = u[j : j + WIDE]
        rows = max(1, TILE // len(w))
        x, d = np.empty((rows, len(w)), np.uint64), np.empty((rows, len(w)), np.uint8)
        for i in range(0, min(len(v), j + len(w)) if same else len(v), rows):
            part = v[i : i + rows, None]
            yield i, j, np.bitwise_count(np.bitwise_xor(part, w, out=x[: len(part)]), out=d[: len(part)])


def compared(v: np.ndarray, u: np.ndarray, most: int, same: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) arrays of the pairs v[i], u[j] within a distance; where both are the same every pair once."""
    for i, j, d in tiles(v, u, same):
        at = np.flatnonzero(d <= most)
        if len(at):
            a, b = np.divmod(at, d.shape[1])
            a, b, d = a + i, b + j, d.ravel()[at]
            if same:
                once = a < b
                a, b, d = a[once], b[once], d[once]
            yield a, b, d


def masks(radius: int, width: int = 16) -> list[int]:
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def banded(v: np.ndarray, u: np.ndarray, most: int, same: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same pairs by way of bands: in some band two of them differ by most // BANDS bits at most, so that every v looks up the
    u of the values that near. A pair is kept in its first such band."""
    radius, low = most // BANDS, np.uint64(0xFFFF)
    turned = np.array(masks(radius), np.int64)
    deal = max(1, TILE // max(1, len(v)))
    for band in range(BANDS):
        own, other = (((h >> np.uint64(16 * band)) & low).astype(np.int64) for h in (v, u))
        order = np.argsort(other, kind="stable")
        begin = np.searchsorted(other[order], np.arange((1 << 16) + 1))
        for m in range(0, len(turned), deal):
            some = turned[m : m + deal]
            w = (own[:, None] ^ some).ravel()
            held = begin[w + 1] - begin[w]
            full = np.flatnonzero(held)
            ends = np.cumsum(held[full])
            at = 0
            while at < len(full):  # so many at once that their partners are few; one has no more than u has
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TILE, "right")))
                some_full = full[at:upto]
                n = held[some_full]
                i = np.repeat(some_full // len(some), n)
                j = order[np.arange(n.sum()) + np.repeat(begin[w[some_full]] - np.cumsum(n) + n, n)]
                at = upto
                x = v[i] ^ u[j]
                d = np.bitwise_count(x)
                fine = d <= most
                if same:
                    fine &= i < j
                for before in range(band):
                    fine &= np.bitwise_count((x >> np.uint64(16 * before)) & low) > radius
                if fine.any():
                    yield i[fine], j[fine], d[fine]


def nearest(v: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distance, place in u) of the nearest other hash of each v, the first of equally near ones; an equal one is not another.
    The distance is 255 where u has none."""
    best, place = np.full(len(v), 255, np.uint8), np.zeros(len(v), np.int64)
    for i, j, d in tiles(v, u):
        d -= np.uint8(1)  # 0 becomes the largest
        at = d.argmin(1)
        least = d[np.arange(len(d)), at]
        rows = slice(i, i + len(d))
        better = least < best[rows]
        best[rows][better], place[rows][better] = least[better], at[better] + j
    return np.where(best == 255, 255, best + 1), place


def united(part: np.ndarray, pairs: Iterator) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(root, edges): which of the parts 0.. the pairs (i, j, _) of rows connect, as each part's smallest connected one, and no more
    edges (of parts) than connect them; ``part`` has the part of each row. What is in one part already is passed over."""
    root = np.arange(int(part.max()) + 1 if len(part) else 0)
    left, edges = len(root), []
    for i, j, _ in pairs:
        a, b = root[part[i]], root[part[j]]
        open_ = a != b
        if not open_.any():
            continue
        a, b = a[open_], b[open_]
        both = np.unique(np.minimum(a, b) * len(root) + np.maximum(a, b))
        up: dict[int, int] = {}

        def find(x):
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        for a, b in zip((both // len(root)).tolist(), (both % len(root)).tolist()):
            x, y = find(a), find(b)
            if x != y:
                up[max(x, y)] = min(x, y)
                edges.append((a, b))
                left -= 1
        moved = np.arange(len(root))
        for x in list(up):
            moved[x] = find(x)
        root = moved[root]
        if left == 1:
            break
    return root, edges
