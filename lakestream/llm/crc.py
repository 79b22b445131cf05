"""CRC-32 of very many short spans at once, from a table of positions.

The CRC of a message is the XOR of one contribution per byte, which depends on the byte and its distance from the
end, and of a constant that depends on the length. So the contributions of all bytes of all spans are one gather from
a table, and each span is one segment of ``bitwise_xor.reduceat``. Spans longer than the table is deep are cut into
blocks from their end; a block's value is moved on by as many bytes as the table is deep, and XORed to the next.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np

#: Distances from the end that the table has.
DEPTH = 64
#: The reflected polynomial of CRC-32, a fixed value.
POLYNOMIAL = 0xEDB88320


@lru_cache(1)
def positions() -> np.ndarray:
    """``[distance, byte]``: what a byte adds with that many bytes after it."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(POLYNOMIAL), step >> 1).astype(np.uint32)
    table = np.empty((DEPTH, 256), np.uint32)
    table[0] = step
    for d in range(1, DEPTH):
        table[d] = step[table[d - 1] & 255] ^ (table[d - 1] >> 8)
    return table


@lru_cache(1)
def constants() -> np.ndarray:
    """By length: the CRC of so many zero bytes."""
    return np.array([zlib.crc32(bytes(n)) for n in range(DEPTH + 1)], np.uint32)


def moved_on(value: np.ndarray) -> np.ndarray:
    """Values after ``DEPTH`` more zero bytes: their four bytes stand first among those."""
    table = positions()
    low, high = table[DEPTH - 1][value & 255] ^ table[DEPTH - 2][value >> 8 & 255], value >> 16
    return low ^ table[DEPTH - 3][high & 255] ^ table[DEPTH - 4][high >> 8]


def crc32_of_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of ``data[starts[i]:ends[i]]`` for every ``i``; spans may overlap, and an empty one has 0."""
    lengths = ends - starts
    out = np.zeros(len(starts), np.uint32)
    if not lengths.all():
        out[lengths > 0] = crc32_of_spans(data, starts[lengths > 0], ends[lengths > 0])
        return out
    if not len(starts):
        return out
    stops = np.cumsum(lengths)
    place = np.arange(stops[-1])
    to_end = np.repeat(stops - 1, lengths) - place
    bytes_of = data[place + np.repeat(starts - (stops - lengths), lengths)]
    adds = positions().ravel()[(to_end % DEPTH) * 256 + bytes_of]
    if lengths.max() <= DEPTH:
        return np.bitwise_xor.reduceat(adds, stops - lengths) ^ constants()[lengths]
    begins = (to_end % DEPTH) == DEPTH - 1
    begins[stops - lengths] = True
    blocks = np.bitwise_xor.reduceat(adds, np.flatnonzero(begins))
    n_blocks = -(-lengths // DEPTH)
    first = np.cumsum(n_blocks) - n_blocks
    out = blocks[first]
    for i in range(1, int(n_blocks.max())):
        more = np.flatnonzero(n_blocks > i)
        out[more] = moved_on(out[more]) ^ blocks[first[more] + i]
    sizes, which = np.unique(lengths, return_inverse=True)
    return out ^ np.array([zlib.crc32(bytes(int(n))) for n in sizes], np.uint32)[which]
