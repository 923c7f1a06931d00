"""Word shingles of whole texts as 64-bit hashes, computed on byte arrays.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. A text with fewer words than a
shingle takes is one shingle of all its words; a text without words has none.
"""

from __future__ import annotations

import numpy as np

from tablescope.llm.utf8 import lower_table, mix

WORDS = 5
BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))
CODES = mix(np.arange(1, 257, dtype=np.uint64) * BASE)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, and for every row the index of its first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    data = lower_table()[data]
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    breaks = np.zeros(len(data) + 1, bool)
    breaks[offsets] = True
    begins = np.flatnonzero(inside & (breaks[:-1] | np.append(True, ~inside[:-1])))
    ends = np.flatnonzero(inside & (breaks[1:] | np.append(~inside[1:], True))) + 1
    # A polynomial in the byte codes: the difference of two prefix sums, moved to power 0.
    powers = np.full(len(data), BASE, np.uint64)
    powers[0] = 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(CODES[data] * np.cumprod(powers), out=sums[1:])
    powers[1:] = UNBASE
    hashes = (sums[ends] - sums[begins]) * np.cumprod(powers)[begins]
    return mix(hashes + (ends - begins).astype(np.uint64)), np.searchsorted(begins, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingles of every row."""
    words, first = word_hashes(data, offsets)
    rolled = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        rolled = rolled * BASE + words[k : k + len(rolled)]
    rolled = mix(rolled)
    found = []
    for low, high in zip(first[:-1], first[1:]):
        if high - low >= WORDS:
            found.append(np.unique(rolled[low : high - WORDS + 1]))
        elif high > low:
            short = np.array([high - low], np.uint64)
            for word in words[low:high]:
                short = mix(short * BASE + word)
            found.append(short)
        else:
            found.append(np.zeros(0, np.uint64))
    return found
