"""Content-defined sampling of text positions, in numpy.

Of the ``LENGTH - GRAM + 1`` grams within a string of ``LENGTH`` bytes the one
with the least hash (the leftmost of equals) is sampled, so that equal strings
have theirs at equal places.  At most 16 MB are sampled at once.
"""

from __future__ import annotations

import numpy as np

from stocktake.llm._shingles import _INVERSE, mix, powers

LENGTH, GRAM = 400, 200

_INVERSES = np.ones(1, np.uint64)


def inverses(n: int) -> np.ndarray:
    global _INVERSES
    if len(_INVERSES) < n:
        _INVERSES = np.concatenate(([np.uint64(1)], np.cumprod(np.full(max(n, 1 << 20) - 1, _INVERSE, np.uint64), dtype=np.uint64)))
    return _INVERSES[:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of the bytes times growing powers; ``spans`` takes hashes of substrings from them."""
    return np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), dtype=np.uint64)))


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the substrings ``[start, end)``."""
    return mix((sums[end] - sums[start]) * inverses(len(sums))[start] + (end - start).astype(np.uint64))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` values: block-wise running minima from both sides."""
    n = len(x) - width + 1
    padded = np.concatenate((x, np.full(-len(x) % width, ~np.uint64(0), np.uint64))).reshape(-1, width)
    right = np.minimum.accumulate(padded, axis=1).reshape(-1)
    left = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(left[:n], right[width - 1 : width - 1 + n])


def sample(sums: np.ndarray, ends: np.ndarray, length: int = LENGTH, size: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sampled grams of several texts that stand one after another, ``ends`` being theirs.

    Position, hash, and the first and last start of the strings of ``LENGTH``
    bytes (or of ``length`` symbols, with grams of ``size``) whose sampled gram it is: which one that is depends on the string
    alone, and the starts of one gram are neighbours.
    """
    n = len(sums) - 1
    starts = np.concatenate(([0], ends[:-1]))
    counts = np.maximum(0, ends - starts - length + 1)
    if not counts.sum():
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), none, none
    grams = mix((sums[size:] - sums[: n - size + 1]) * inverses(len(sums))[: n - size + 1] + np.uint64(size))
    key = (grams >> np.uint64(24) << np.uint64(24)) | np.arange(len(grams), dtype=np.uint64)
    least = sliding_least(key, length - size + 1)
    # Strings that reach over the end of a text aren't any.
    at = np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
    place = (least[at] & np.uint64(0xFFFFFF)).astype(np.int64)
    head = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    tail = np.concatenate((head[1:], [len(place)])) - 1
    place = place[head]
    return place, grams[place], at[head], at[tail]
