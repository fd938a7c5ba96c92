"""Words of many texts at once, from their UTF-8 bytes in Arrow buffers."""

from __future__ import annotations

import numpy as np

from .common import span_hashes

#: Bytes hashed at a time: eight times as much is held for their prefix sums.
_BLOCK = 4 << 20


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags: false for the bytes in `ranges` (inclusive), which separate words."""
    out = np.ones(256, bool)
    for low, high in ranges:
        out[low : high + 1] = False
    return out


#: A-Z to a-z, every other byte itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Separators are the ASCII white space characters.
SPACED = byte_class((0x20, 0x20), (0x09, 0x0D))
#: Separators are the ASCII characters that are neither digits nor lower-case letters.
LETTERED = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def bounds(raw: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words in raw[at[0]:at[-1]], none of which crosses one of the row bounds `at`."""
    flag = inside[raw]
    if not flag.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before, after = np.zeros_like(flag), np.zeros_like(flag)
    before[1:], after[:-1] = flag[:-1], flag[1:]
    before[at[at < len(raw)]] = False
    after[at[at > 0] - 1] = False
    return np.flatnonzero(flag & ~before), np.flatnonzero(flag & ~after) + 1


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words; equal words have equal hashes."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _BLOCK, "right")))
        base = starts[i]
        out[i:j] = span_hashes(raw[base : ends[j - 1]], starts[i:j] - base, ends[i:j] - base)
        i = j
    return out


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each (start, size), one after the other."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
