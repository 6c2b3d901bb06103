"""Minimal perfect hash of distinct 64-bit keys.

Keys are hashed into a bit array of twice their number; those that are alone at
their bit stay there, the others go on to a further, smaller array, until none
is left. A key's slot is the number of set bits before its own, over all arrays:
n keys have the slots 0 to n - 1. A key is found in a bounded expected number of
steps, whatever n; a key that was not hashed gets some slot or none, so slots
hold fingerprints. NumPy works on all keys at once.
"""

from __future__ import annotations

import numpy as np

#: bits a key in each array, and the bits of a word
ROOM, WORD = 2, 64


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A one-to-one hash of 64-bit keys."""
    x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


def build(keys: np.ndarray) -> list[bytes]:
    """The bit arrays for distinct ``keys``."""
    levels, left = [], keys.astype(np.uint64)
    while len(left):
        size = -(-ROOM * len(left) // WORD) * WORD
        at = (mixed(left, len(levels)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(np.packbits(alone, bitorder="little").tobytes())
        left = left[~alone[at]]
    return levels


def slots(levels: list[bytes], keys: np.ndarray) -> np.ndarray:
    """The slot of each key, -1 for keys that surely were not hashed."""
    keys = keys.astype(np.uint64)
    found, left, before = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys)), 0
    for seed, level in enumerate(levels):
        words = np.frombuffer(level, dtype="<u8")
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        at = (mixed(keys[left], seed) % np.uint64(WORD * len(words))).astype(np.int64)
        word, bit = words[at // WORD], (at % WORD).astype(np.uint64)
        here = (word >> bit & np.uint64(1)).astype(bool)
        below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
        found[left[here]] = (before + ranks[at // WORD] + below)[here]
        left, before = left[~here], before + int(ranks[-1])
    return found
