"""64-bit codes of white-space words and of their 5-word shingles, computed on byte arrays without a loop over words.

A word's code is the sum over its bytes of a fixed random number for the byte times an odd factor to the power of the
byte's place, then mixed. Words are runs of bytes other than blank and 0x09 to 0x0D.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

SLICE = 1 << 20  # bytes looked at together
RUN = 5  # words of a shingle
FACTOR = np.uint64(0xD1342543DE82EF95)
MIX = np.uint64(0x9E3779B97F4A7C15)
BYTE_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) \
    + np.uint64(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), FACTOR, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def codes_of(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words of raw, and where each word starts."""
    data = np.frombuffer(raw, np.uint8)
    inside = ~IS_SPACE[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    at = np.flatnonzero(inside)
    lengths = ends - starts
    firsts = np.cumsum(lengths) - lengths
    place = np.arange(len(at)) - np.repeat(firsts, lengths)
    values = BYTE_VALUES[data[at]] * powers(int(lengths.max()))[place]
    return mixed(np.add.reduceat(values, firsts) + lengths.astype(np.uint64)), starts


def _pieces(raw: bytes) -> Iterator[bytes]:
    """Slices of a long text that end where a word ends."""
    at = 0
    while at < len(raw):
        end = at + SLICE
        while end < len(raw) and not IS_SPACE[raw[end]]:
            end += 1
        yield raw[at:end]
        at = end


def word_codes(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Codes of the words of each text, in order; short texts are handled together."""
    part: list[bytes] = []
    size = 0

    def together() -> Iterator[np.ndarray]:
        codes, starts = codes_of(b" ".join(part))
        ends = np.cumsum([len(t) + 1 for t in part])
        yield from np.split(codes, np.searchsorted(starts, ends)[:-1])

    for text in texts:
        if part and size + len(text) > SLICE:
            yield from together()
            part, size = [], 0
        if len(text) > SLICE:
            yield np.concatenate([codes_of(p)[0] for p in _pieces(text)])
        else:
            part.append(text)
            size += len(text)
    if part:
        yield from together()


def run_codes(codes: np.ndarray, run: int = RUN) -> np.ndarray:
    """A code of each run of `run` words; of fewer words, of the whole sequence; none without words."""
    n = len(codes) - run + 1
    if n < 1:
        run, n = len(codes), min(len(codes), 1)
    out = codes[:n] + np.uint64(run)
    for k in range(1, run):
        out = mixed(out) + codes[k:k + n]
    return mixed(out)


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The distinct shingle codes of each text, ascending; ASCII letters count as lower case, null as empty."""
    for codes in word_codes([(t or "").encode().lower() for t in texts]):
        yield np.unique(run_codes(codes))


def set_code(codes: np.ndarray) -> int:
    """A code of 63 bits that equal sets share."""
    return int.from_bytes(hashlib.blake2b(codes.tobytes(), digest_size=8).digest(), "little") >> 1
