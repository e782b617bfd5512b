"""Self-join of a bounded group of sets by a tree of signatures.

Sets stand in order of size. A node of the tree covers `FAN` neighbours: the OR of their token bitmaps, their smallest
and largest size and their largest number of tokens that share a bit. Two sets of sizes a and b with Jaccard similarity
of at least p/q share at least p (a + b) / (p + q) tokens; two nodes share at most the common bits plus the smaller
number of shared-bit tokens, and no more than the smaller size. Pairs of nodes that cannot reach the least overlap are
dropped with all below them; the rest go down both trees at once. Pairs of sets that are left are counted exactly, unless
their sets are joined already.
"""

from __future__ import annotations

import numpy as np

FAN = 8
PAIRS = 1 << 15  # node pairs compared together


class Joined:
    """Sets that are joined so far."""

    def __init__(self, labels: np.ndarray):
        self.up = np.unique(labels, return_index=True, return_inverse=True)
        self.up = self.up[1][self.up[2].ravel()].tolist()

    def top(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, a: int, b: int) -> None:
        a, b = self.top(a), self.top(b)
        self.up[max(a, b)] = min(a, b)


def bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    out = np.zeros((len(sets), bits >> 3), np.uint8)
    for row, tokens in zip(out, sets):
        flags = np.zeros(bits, np.uint8)
        flags[(tokens & np.uint64(bits - 1)).astype(np.int64)] = 1
        row[:] = np.packbits(flags)
    return out.view(np.uint64)


def levels(maps: np.ndarray, sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """From the sets up to the root: bitmaps, smallest size, largest size, most tokens that share a bit."""
    doubled = sizes - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
    out = [(maps, sizes, sizes, doubled)]
    while len(out[-1][0]) > 1:
        m, low, high, twice = out[-1]
        at = np.arange(0, len(m), FAN)
        out.append((np.bitwise_or.reduceat(m, at, axis=0), np.minimum.reduceat(low, at),
                    np.maximum.reduceat(high, at), np.maximum.reduceat(twice, at)))
    return out


def can_link(level: tuple, x: np.ndarray, y: np.ndarray, p: int, q: int) -> np.ndarray:
    """Which node pairs may hold a pair with similarity p/q or more."""
    maps, low, high, twice = level
    possible = (q * high[x] >= p * low[y]) & (q * high[y] >= p * low[x])
    at = np.flatnonzero(possible)
    for k in range(0, len(at), PAIRS):
        i = at[k:k + PAIRS]
        a, b = x[i], y[i]
        common = np.empty(len(i), np.int64)
        step = max(1, (1 << 22) // maps.shape[1])
        for j in range(0, len(i), step):
            common[j:j + step] = np.bitwise_count(maps[a[j:j + step]] & maps[b[j:j + step]]).sum(
                axis=1, dtype=np.int64)
        most = np.minimum(common + np.minimum(twice[a], twice[b]), np.minimum(high[a], high[b]))
        possible[i] = (p + q) * most >= p * (low[a] + low[b])
    return possible


def tree_links(sets: list[np.ndarray], labels: np.ndarray, p: int, q: int,
               side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Verified pairs (places in `sets`) that join all sets linked by chains inside the group.

    labels: sets with one label are joined from the start. side: pairs of two sets marked True are left out.
    """
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sizes = np.array([len(sets[i]) for i in order], np.int64)
    bits = 1 << int(np.clip(np.ceil(np.log2(max(1, sizes.max(initial=1)) * 4)), 10, 16))
    tree = levels(bitmaps([sets[i] for i in order], bits), sizes)
    joined, found = Joined(np.asarray(labels)[order]), []
    apart = None if side is None else np.asarray(side)[order]
    x = y = np.zeros(min(1, len(sets)), np.int64)
    for depth in range(len(tree) - 1, -1, -1):
        keep = can_link(tree[depth], x, y, p, q)
        x, y = x[keep], y[keep]
        if not depth:
            break
        n = len(tree[depth - 1][0])
        child = np.arange(FAN)
        a = np.repeat(x[:, None] * FAN + child, FAN, axis=1).ravel()
        b = np.tile(y[:, None] * FAN + child, (1, FAN)).ravel()
        inside = (a < n) & (b < n) & (a <= b)
        x, y = a[inside], b[inside]
    real = x < y
    if apart is not None:
        real &= ~(apart[x] & apart[y])
    for a, b in zip(x[real].tolist(), y[real].tolist()):
        if joined.top(a) == joined.top(b):
            continue
        one, two = sets[order[a]], sets[order[b]]
        at = np.minimum(np.searchsorted(two, one), len(two) - 1)
        shared = int((two[at] == one).sum())
        if q * shared >= p * (len(one) + len(two) - shared):
            joined.join(a, b)
            found.append((order[a], order[b]))
    return found
