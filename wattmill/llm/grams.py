"""Hashed byte n-grams of whole texts, in bounded slices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SLICE = 1 << 20  # bytes of a text looked at together
SPREAD = np.uint32(2654435769)  # odd, near 2**32 divided by the golden ratio
SPREAD_64 = np.uint64(0x9E3779B97F4A7C15)  # the same of 2**64


def gram_buckets(text: str | None, bits: int, size: int = 3) -> Iterator[np.ndarray]:
    """Bucket (0 to 2**bits - 1) of each run of `size` bytes of the UTF-8 text; nothing for shorter texts and null."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    for at in range(0, max(0, len(raw) - size + 1), SLICE):
        part = raw[at:at + SLICE + size - 1].astype(np.uint32)
        n = len(part) - size + 1
        code = part[:n].copy()
        for k in range(1, size):
            code = code << np.uint32(8) | part[k:k + n]
        yield (code * SPREAD) >> np.uint32(32 - bits)


def gram_counts(text: str | None, bits: int, size: int = 3) -> np.ndarray:
    """How often each bucket occurs in the text."""
    total = np.zeros(1 << bits, np.int64)
    for buckets in gram_buckets(text, bits, size):
        total += np.bincount(buckets, minlength=1 << bits)
    return total


def hashed_grams(text: str | None, size: int, buckets: int) -> Iterator[np.ndarray]:
    """Bucket (0 to buckets - 1, below 2**32) of each run of `size` bytes (at most 8) of the UTF-8 text, slice by slice."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    for at in range(0, max(0, len(raw) - size + 1), SLICE):
        part = raw[at:at + SLICE + size - 1].astype(np.uint64)
        n = len(part) - size + 1
        code = part[:n].copy()
        for k in range(1, size):
            code = code << np.uint64(8) | part[k:k + n]
        code = (code ^ code >> np.uint64(29)) * SPREAD_64
        yield ((code >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint32)


def added(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(codes, counts, ...) of several parts as one, sorted, with the counts of equal codes added up."""
    parts = [p for p in parts if len(p[0])] or parts[:1]
    if len(parts) < 2:
        return parts[0]
    codes = np.concatenate([p[0] for p in parts])
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return codes[first], *(np.add.reduceat(np.concatenate(c)[order], first) for c in list(zip(*parts))[1:])
