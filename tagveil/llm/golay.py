"""The perfect binary Golay code [23, 12, 7] on numpy arrays: decoding and keys of nearby words."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

LENGTH, DATA = 23, 12
CHECK = LENGTH - DATA
#: The code's generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def _remainder(word: int) -> int:
    for i in range(LENGTH - 1, CHECK - 1, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - CHECK)
    return word


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low and the high part of a word and of each bit; the error that each remainder stands for.

    All patterns of up to three errors have distinct remainders and use up all 2048 of them.
    """
    bits = np.array([_remainder(1 << i) for i in range(LENGTH)], np.int32)
    parts = []
    for low, n in ((0, CHECK), (CHECK, DATA)):
        table = np.zeros(1 << n, np.int32)
        for i in range(n):
            table[1 << i : 2 << i] = table[: 1 << i] ^ bits[low + i]
        parts.append(table)
    errors = np.zeros(1 << CHECK, np.int32)
    for weight in (1, 2, 3):
        for places in combinations(range(LENGTH), weight):
            errors[np.bitwise_xor.reduce(bits[list(places)])] = sum(1 << p for p in places)
    return parts[0], parts[1], bits, errors


def decode(words: np.ndarray) -> np.ndarray:
    """Index (the 12 data bits) of the one codeword within three bits of each 23-bit word."""
    low, high, _, errors = _tables()
    words = words.astype(np.int32)
    return (words ^ errors[low[words & ((1 << CHECK) - 1)] ^ high[words >> CHECK]]) >> CHECK


def near_keys(words: np.ndarray, width: int = LENGTH) -> np.ndarray:
    """Indices that the words within one bit of each word decode to, one row a word, repeats as -1.

    Two words at most two bits apart have a word within one bit of both, so they share an
    index. Full-length words have one index or six. Only the low ``width`` bits can differ.
    """
    words = words.astype(np.int32)
    flips = np.concatenate([[0], 1 << np.arange(width)]).astype(np.int32)
    found = np.sort(decode(words[:, None] ^ flips[None, :]), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return found
