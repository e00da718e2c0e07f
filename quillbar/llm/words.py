"""Words, shingles and feature sets of whole texts as numpy arrays, many texts at a time."""

from __future__ import annotations

import numpy as np

# Bytes that end a word, and odd 64-bit multipliers.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that do not belong to words of letters and digits.
NOT_ALNUM = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE, _STEP, _MIX_1, _MIX_2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(255, _BASE)]), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes], between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, begin, end of each word, number of words of each text). Words are runs of bytes other
    than those in `between` (white space), with A-Z in lower case; begin and end count from the start of the text."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = ~between[raw]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    length = end - begin
    first = np.cumsum(size + 1) - size - 1
    of = np.searchsorted(first, begin, "right") - 1
    if not len(begin):
        return np.zeros(0, np.uint64), begin, end, np.zeros(len(texts), np.int64)
    letters = raw[inside]
    start = np.cumsum(length) - length
    place = np.arange(len(letters)) - np.repeat(start, length)
    wide = place >= 256
    power = _POWERS[np.minimum(place, 255)]
    if wide.any():
        power[wide] = mix(place[wide].astype(np.uint64)) | np.uint64(1)
    value = np.add.reduceat((_LOWER[letters] + np.uint64(1)) * power, start)
    return mix(value + length.astype(np.uint64) * _STEP), begin - first[of], end - first[of], np.bincount(of, minlength=len(texts))


def word_counts(texts: list[bytes], between: np.ndarray = _SPACE) -> np.ndarray:
    """Number of words of each text."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    inside = ~between[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = np.cumsum(size + 1) - size - 1
    return np.add.reduceat(begins, first, dtype=np.int64) if len(texts) else size


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` words of one text; with fewer words, of the whole as one."""
    n = len(words)
    if n == 0:
        return words
    k = min(width, n)
    total = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        total = total * _STEP + words[i : n - k + 1 + i]
    return mix(total + np.uint64(k))


def feature_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, _, _, count = word_hashes(texts)
    return [np.unique(shingle_hashes(w, width)) for w in np.split(words, np.cumsum(count)[:-1])] if texts else []
