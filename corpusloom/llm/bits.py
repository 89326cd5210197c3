"""Vectorised bit votes and Hamming distances over 64-bit words."""

from __future__ import annotations

import numpy as np

#: Rows of unpacked bits held at once.
_ROWS = 1 << 15
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits each depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


def bit_sums(hashes: np.ndarray, weights: np.ndarray | None, starts: np.ndarray) -> np.ndarray:
    """For documents d with hashes starts[d]:starts[d+1], the weight of the hashes with each bit set.

    Shape (documents, 64), the most significant bit first. ``weights`` are integers under 256.
    """
    out = np.zeros((len(starts) - 1, 64), np.int64)
    for a in range(0, len(hashes), _ROWS):
        b = min(a + _ROWS, len(hashes))
        bits = np.unpackbits(hashes[a:b].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        if weights is not None:
            bits *= weights[a:b, None].astype(np.uint8)
        first, last = np.searchsorted(starts, a, "right") - 1, np.searchsorted(starts, b, "left")
        docs = np.arange(first, last)
        docs = docs[starts[docs + 1] > np.maximum(starts[docs], a)]  # those with a hash in here
        out[docs] += np.add.reduceat(bits, np.maximum(starts[docs] - a, 0), axis=0, dtype=np.int64)
    return out


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of 64 booleans as 64-bit words."""
    return np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)
