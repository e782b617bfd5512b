"""CRC-32 of many spans of a byte array at once, by tables of what a byte at a place adds.

CRC-32 without its start value is linear: the value of a span is the XOR, over its bytes, of what each byte adds at its
distance from the span's end. `ADDS[distance, byte]` holds these for a block of 64 places; a constant for each length
puts the start value and the final inversion back. Longer spans are cut into blocks from their end; neighbouring blocks
are then folded, the left one carried over the right one's length, in as many rounds as the block count has bits.
"""

from __future__ import annotations

import zlib

import numpy as np

POLYNOMIAL = 0xEDB88320  # fixed by the CRC-32 in general use, bits reflected
BLOCK = 64


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ POLYNOMIAL, table >> 1).astype(np.uint32)
    return table


def _place_table() -> np.ndarray:
    """ADDS[d, b]: byte b, then d zero bytes."""
    rows = [_byte_table()]
    for _ in range(BLOCK - 1):
        last = rows[-1]
        rows.append(rows[0][last & 255] ^ last >> 8)
    return np.stack(rows)


ADDS = _place_table()
EMPTY = np.array([zlib.crc32(bytes(n)) for n in range(BLOCK + 1)], np.uint32)  # of n zero bytes


def _carried(values: np.ndarray, over: np.ndarray) -> np.ndarray:
    """values after as many zero bytes as the four tables `over` stand for."""
    out = over[0][values & 255]
    for k in (1, 2, 3):
        out = out ^ over[k][values >> np.uint32(8 * k) & 255]
    return out


def _block_carry() -> np.ndarray:
    """The four tables for one block: what each byte of a value becomes after BLOCK zero bytes."""
    bytes_at = (np.arange(256, dtype=np.uint32) << np.array([[0], [8], [16], [24]], np.uint32)).astype(np.uint32)
    for _ in range(BLOCK):
        bytes_at = ADDS[0][bytes_at & 255] ^ bytes_at >> 8
    return bytes_at


CARRY = _block_carry()


def _linear(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The linear part for spans of 1 to BLOCK bytes."""
    firsts = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(firsts, lengths)
    at = np.repeat(starts, lengths) + place
    return np.bitwise_xor.reduceat(ADDS[np.repeat(lengths, lengths) - 1 - place, data[at]], firsts)


def span_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The unsigned CRC-32 of data[start:end] for each span; spans are not empty and may overlap."""
    lengths = ends - starts
    if not len(lengths):
        return np.zeros(0, np.uint32)
    if lengths.max() <= BLOCK:
        return _linear(data, starts, lengths) ^ EMPTY[lengths]
    blocks = -(-lengths // BLOCK)
    span = np.repeat(np.arange(len(blocks)), blocks)
    from_end = np.repeat(np.cumsum(blocks), blocks) - 1 - np.arange(len(span))
    block_end = ends[span] - from_end * BLOCK
    block_start = np.maximum(starts[span], block_end - BLOCK)
    values, over = _linear(data, block_start, block_end - block_start), CARRY
    while len(span) > len(blocks):  # fold pairs of neighbours, counted from the end
        left = from_end & 1 == 1
        values[left] = _carried(values[left], over)
        from_end >>= 1
        first = np.flatnonzero(np.r_[True, (span[1:] != span[:-1]) | (from_end[1:] != from_end[:-1])])
        values, span, from_end = np.bitwise_xor.reduceat(values, first), span[first], from_end[first]
        over = _carried(over, over)
    seen, which = np.unique(lengths, return_inverse=True)
    return values ^ np.array([zlib.crc32(bytes(n)) for n in seen.tolist()], np.uint32)[which]
