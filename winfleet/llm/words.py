"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is a run of bytes other than space and 0x09 to 0x0D. These bytes never occur inside a longer UTF-8 sequence, so words of
bytes and words of characters are the same.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_random = np.random.default_rng(20240901)
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_OTHER_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OTHER_STEP = np.uint64(0xD1342543DE82EF95)
_SHINGLE = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    hashes: np.ndarray  # a 64-bit name for each word
    starts: np.ndarray  # byte positions in data
    ends: np.ndarray
    offsets: np.ndarray  # the words of text i are offsets[i] to offsets[i + 1]
    data: np.ndarray  # the bytes of all texts
    seconds: np.ndarray | None = None  # another 64-bit name for each word, independent of the first


def split_words(texts: pa.Array, twice: bool = False) -> Words:
    """Words of a string array; a null text has none. With ``twice``, words get two independent names."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    if len(data) == 0:
        empty = np.zeros(0, dtype=np.int64)
        return Words(empty.astype(np.uint64), empty, empty, np.zeros(len(texts) + 1, dtype=np.int64), data, empty.astype(np.uint64))
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = bounds[:-1][bounds[:-1] < len(data)]
    first[cut] = inside[cut]
    last = np.empty_like(inside)
    last[-1] = inside[-1]
    last[:-1] = inside[:-1] & (~inside[1:] | first[1:])
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    lengths = ends - starts
    hashes = seconds = np.zeros(0, dtype=np.uint64)
    if len(starts):
        chosen = data[inside]
        at = np.cumsum(lengths) - lengths
        place = np.arange(len(chosen)) - np.repeat(at, lengths)

        def names(table: np.ndarray, step: np.uint64) -> np.ndarray:
            powers = np.multiply.accumulate(np.full(int(lengths.max()), step))
            return mix(np.add.reduceat(table[chosen] * powers[place], at) ^ mix(lengths.astype(np.uint64)))

        hashes = names(_BYTE, _STEP)
        seconds = names(_OTHER_BYTE, _OTHER_STEP) if twice else None
    return Words(hashes, starts, ends, np.searchsorted(starts, bounds), data, seconds)


def runs_of(hashes: np.ndarray, size: int, factor: np.uint64 = _SHINGLE) -> np.ndarray:
    """A 64-bit name for every run of ``size`` words, by its first word; empty if there are fewer."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        total = total * factor + hashes[k : k + n]
    return mix(total)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Names of the runs of ``size`` words of one text; a shorter text that has words is one shingle by itself."""
    if 0 < len(hashes) < size:
        return runs_of(hashes, len(hashes)) ^ np.uint64(len(hashes))
    return runs_of(hashes, size)
