"""Texts of a batch as one array of code points."""

from __future__ import annotations

import sys
from functools import cache

import numpy as np

#: Code points that are worked on at once.
CHUNK = 1 << 19


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, each followed by a line feed, and where each text starts (and the end)."""
    whole = "\n".join([*texts, ""])
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    return np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32), starts


@cache
def table_of(predicate: str) -> np.ndarray:
    """For each code point, whether the str method of this name holds."""
    test = getattr(str, predicate)
    return np.fromiter((test(chr(c)) for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def sums_by_text(values: np.ndarray, at: int, starts: np.ndarray, into: np.ndarray) -> None:
    """Add ``values`` (those of positions at, at + 1, ...) to the rows of ``into``, by the text that each position is in."""
    end = at + len(values)
    first, last = np.searchsorted(starts, at, "right") - 1, np.searchsorted(starts, end, "left")
    docs = np.arange(first, min(last, len(starts) - 1))
    if len(docs):
        into[docs] += np.add.reduceat(values, np.maximum(starts[docs] - at, 0), axis=0, dtype=into.dtype)
