"""Whole texts as byte arrays in bounded blocks, and hashes of words and n-grams.

The helpers run inside tasks on Arrow batches. A block holds at most ``BLOCK`` bytes
of text, or one text that is longer, so memory follows the longest text and not the
batch. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Separators of words: blank and the ASCII line and tab characters.
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
#: Lower-cases A-Z only.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finisher of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LETTER = mix(np.arange(1, 257, dtype=np.uint64))


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_MULTIPLIER, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


def blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Gives ``(first row, bytes, offsets)``; text k of a block is ``bytes[offsets[k]:offsets[k + 1]]``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64, len(column) + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + BLOCK, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, whole[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and where the words of each text begin in that array."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~blank[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    cut[[0, n]] = True
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    begin = np.flatnonzero(inside & (~before | cut[:-1]))
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    power, inverse = _power(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTER[FOLD[data]] * power[:n], out=total[1:])
    hashes = mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
    return hashes, np.searchsorted(begin, offsets)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``size`` words; all words as one run if there are fewer."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    n = min(size, len(hashes))
    runs = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        runs = runs * np.uint64(_MULTIPLIER) + hashes[k : k + len(runs)]
    return np.unique(mix(runs + np.uint64(n)))


def grams(data: np.ndarray, size: int, bits: int) -> np.ndarray:
    """Slot of the ``size`` bytes from each place, in ``2 ** bits`` slots (the last places are cut off)."""
    n = max(0, len(data) - size + 1)
    key = np.zeros(n, np.uint32)
    for k in range(size):
        key = key * np.uint32(0x01000193) ^ data[k : k + n].astype(np.uint32) + np.uint32(1)
    key = (key ^ (key >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (key ^ (key >> np.uint32(13))) * np.uint32(0x9E3779B1) >> np.uint32(32 - bits)
