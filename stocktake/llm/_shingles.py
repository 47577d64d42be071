"""Words, their hashes and hashed word shingles of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the base of the rolling sums, kept between calls."""
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.concatenate(([np.uint64(1)], np.cumprod(np.full(max(n, 1 << 20) - 1, _BASE, np.uint64), dtype=np.uint64)))
    return _POWERS[:n]


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of some lower-cased texts, in order, and each text's number of words."""
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    space = _IS_SPACE[data]
    inside = ~space
    first = np.flatnonzero(inside & np.concatenate(([True], space[:-1])))
    last = np.flatnonzero(inside & np.concatenate((space[1:], [True]))) + 1
    ends = np.cumsum([len(r) + 1 for r in raw])
    per_text = np.diff(np.concatenate(([0], np.searchsorted(first, ends))))
    size = last - first
    # A word's sum is taken relative to the start of its own bytes, so that place doesn't matter.
    sums = np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _place(len(data)), dtype=np.uint64)))
    h = (sums[last] - sums[first]) * _unplace(first)
    return mix(h ^ (size.astype(np.uint64) << np.uint64(56))), per_text


def _place(n: int) -> np.ndarray:
    return powers(n)


_BACK = np.ones(1, np.uint64)


def _unplace(at: np.ndarray) -> np.ndarray:
    """Inverse powers of the base at some places."""
    global _BACK
    n = int(at[-1]) + 1 if len(at) else 1
    if len(_BACK) < n:
        _BACK = np.concatenate(([np.uint64(1)], np.cumprod(np.full(max(n, 1 << 20) - 1, _INVERSE, np.uint64), dtype=np.uint64)))
    return _BACK[at]


def windows(words: np.ndarray, per_text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``width`` words (a shorter text is one window), and each text's number of windows."""
    counts = np.where(per_text >= width, per_text - width + 1, (per_text > 0).astype(per_text.dtype))
    starts = np.concatenate(([0], np.cumsum(per_text)[:-1]))
    total = int(counts.sum())
    out = np.zeros(total, np.uint64)
    if not total:
        return out, counts
    owner = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + starts[owner]
    full = per_text[owner] >= width
    padded = np.concatenate((words, np.zeros(width, np.uint64)))
    for k in range(width):
        out = mix(out * np.uint64(3) + padded[at + k]) if k else mix(padded[at])
    for i in np.flatnonzero(~full):
        own = words[at[i] : at[i] + per_text[owner[i]]]
        h = mix(own[:1])
        for j in range(1, len(own)):
            h = mix(h * np.uint64(3) + own[j : j + 1])
        out[i] = mix(h + np.uint64(len(own)))[0]
    return out, counts


def distinct(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's windows, sorted and without repeats."""
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[keep], np.bincount(owner[keep], minlength=len(counts))


def shingle_sets(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one after another, and the size of each set."""
    words, per_text = word_hashes([t.encode().lower() for t in texts])
    return distinct(*windows(words, per_text, width))
