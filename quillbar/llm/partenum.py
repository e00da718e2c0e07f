"""PartEnum signatures of sets: two sets of a size band that are similar enough share one.

Sets with Jaccard similarity of at least 3/4 differ in at most (a + b) / 7 features, a and b being their
sizes. Band c holds the pairs whose larger set has 2^c to 2^(c+1) - 1 features, so its difference is
bounded by `bound(c)`. The feature domain is cut into `groups(c)` first-level partitions of CELLS cells
each, and the subsets of CELLS - 1 cells of each partition are enumerated; a signature is the hash of a
set's features in one subset. Differing features spoil all subsets of a partition only if they lie in two
of its cells, so any similar pair agrees on `agreed` subsets at least (pigeonhole), which is above zero.

Empty subsets would make unlike sets agree, so they count only where they must: a set with so many
empty ones that they might be its only agreement emits them too, as does, then, its partner.
"""

from __future__ import annotations

import numpy as np

from quillbar.llm.words import mix

_STEP = np.uint64(0x9FB21C651E98DF25)
CELLS = 3
#: The cells of each subset.
_FIRST, _SECOND = np.array([0, 0, 1]), np.array([1, 2, 2])


def bound(band: int) -> int:
    """Most features in which a similar pair of this band can differ."""
    return 2 * (2 ** (band + 1) - 1) // 7


def groups(band: int) -> int:
    """First-level partitions: more than half the bound, so that some subset is never spoilt; by how much
    decides how many agreements tell similar pairs from others."""
    return -(-(bound(band) + max(6, -(-3 * bound(band) // 20))) // 2)


def parts(band: int) -> int:
    """Signatures of a set."""
    return CELLS * groups(band)


def agreed(band: int, difference: int) -> int:
    """Subsets on which two sets agree at least. In a partition, a first differing cell spoils two of its
    three subsets and a second one the third, so a difference spoils most by meeting every partition once."""
    once = min(difference, groups(band))
    return parts(band) - 2 * once - min(difference - once, groups(band))


def bands(size: int) -> list[tuple[int, int]]:
    """(band, most difference to any partner in it) of a set: its own band, and the next if a similar
    set may be that large."""
    own, largest = size.bit_length() - 1, 4 * size // 3
    out = [(own, (size + min(largest, 2 ** (own + 1) - 1)) // 7)]
    if largest >= 2 ** (own + 1):
        out.append((own + 1, (size + largest) // 7))
    return [(c, d) for c, d in out if c >= 2]  # smaller sets are similar only if equal


def signatures(features: np.ndarray, band: int, difference: int) -> tuple[np.ndarray, int]:
    """(signatures of a set in a band, how many it surely shares with any similar set)."""
    n = parts(band)
    cell = ((features >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
    total = np.zeros(n, np.uint64)
    np.add.at(total, cell, mix(features))
    total, held = total.reshape(-1, CELLS), np.bincount(cell, minlength=n).reshape(-1, CELLS) > 0
    held = (held[:, _FIRST] | held[:, _SECOND]).ravel()
    surely = agreed(band, difference) - int((~held).sum())
    number = mix((np.arange(n, dtype=np.uint64) + (np.uint64(band) << np.uint64(40))) * _STEP + np.uint64(1))
    found = mix(mix(total[:, _FIRST].ravel() + number) + total[:, _SECOND].ravel())
    return (found[held], surely) if surely > 0 else (found, 0)
