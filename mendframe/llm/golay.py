"""The perfect binary Golay code (23, 12, 7) as a fuzzy hash.

Every 23-bit word lies within three bit flips of exactly one of the 4096
codewords, so *decoding* maps a word to a 12-bit index that near words tend to
share.  Two facts make that a lossless blocking key:

* ``a`` and ``b`` differ in at most one bit: ``index(a)`` is among the indices
  of the words within one flip of ``b``.
* ``a`` and ``b`` differ in at most two bits: some word is within one flip of
  both, so their sets of indices meet.

The set for one word (itself and its 23 neighbours decoded) has one or six
members.  Shorter segments are padded with zero bits, which never differ.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

#: Fixed value: generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0xC75
LENGTH, CHECK_BITS = 23, 11


def codewords() -> np.ndarray:
    """The 4096 codewords in systematic form: index << 11 | remainder."""
    rest = np.arange(4096, dtype=np.int64) << CHECK_BITS
    for bit in range(LENGTH - 1, CHECK_BITS - 1, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - CHECK_BITS)), rest)
    return (np.arange(4096, dtype=np.int64) << CHECK_BITS) | rest


@lru_cache(maxsize=1)
def decoder() -> np.ndarray:
    """Index of the nearest codeword for each of the 2**23 words (16 MB)."""
    errors = [0, *(sum(1 << b for b in bits) for n in (1, 2, 3) for bits in combinations(range(LENGTH), n))]
    words = codewords()
    table = np.empty(1 << LENGTH, dtype=np.int16)
    for error in errors:
        table[words ^ error] = np.arange(4096, dtype=np.int16)
    return table


def index(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of each word."""
    return decoder()[words].astype(np.int64)


def fuzzy_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) pairs: the distinct indices of all words within one flip."""
    flips = np.concatenate(([0], 1 << np.arange(LENGTH, dtype=np.int64)))
    found = np.sort(decoder()[words[:, None] ^ flips[None, :]], axis=1)
    fresh = np.ones(found.shape, dtype=bool)
    fresh[:, 1:] = found[:, 1:] != found[:, :-1]
    row, _ = np.nonzero(fresh)
    return row, found[fresh].astype(np.int64)
