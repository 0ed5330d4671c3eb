"""Minimal perfect hashing of fixed digests in numpy.

Levels of bit arrays (Limasset, Rizk, Chikhi and Peterlongo 2017): a key that is alone on its bit
at a level is placed there, the others go on to the next level; the slot of a key is the number of
set bits before its own. Building and probing are whole-array operations.
"""

from __future__ import annotations

import numpy as np

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)
#: Bits of a level for each key that reaches it.
_SPREAD = 2


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x + _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


def _place(words: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = mix(words[:, 0] + np.uint64(level) * _GOLDEN)
        for k in range(1, words.shape[1]):
            h = mix(h ^ words[:, k])
    return (h % np.uint64(size)).astype(np.int64)


def build(words: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Levels (boolean arrays) and the slot of each row of `words`, whose rows must be distinct."""
    slots = np.empty(len(words), np.int64)
    levels: list[np.ndarray] = []
    left, before = np.arange(len(words)), 0
    while len(left):
        size = _SPREAD * len(left)
        at = _place(words[left], len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        placed = alone[at]
        slots[left[placed]] = before + (np.cumsum(alone) - 1)[at[placed]]
        before += int(placed.sum())
        levels.append(alone)
        left = left[~placed]
    return levels, slots


def probe(levels: list[np.ndarray], words: np.ndarray) -> np.ndarray:
    """The slot of each row, -1 where no level holds it; a slot proves nothing until its key is compared."""
    out = np.full(len(words), -1, np.int64)
    left, before = np.arange(len(words)), 0
    for k, bits in enumerate(levels):
        if not len(left):
            break
        at = _place(words[left], k, len(bits))
        hit = bits[at]
        out[left[hit]] = before + (np.cumsum(bits) - 1)[at[hit]]
        before += int(bits.sum())
        left = left[~hit]
    return out
