"""Merging front-coded sorted runs with a loser tree that keeps common prefixes.

A run is sorted; each string is held as the length of the prefix that it
shares with its predecessor, and the rest.  In the tree a string carries the
length of the prefix that it shares with the last string put out.  The longer
such prefix wins without looking at any byte; of equal ones only the bytes
behind the prefix are compared, and the loser keeps what was found.
"""

from __future__ import annotations

from collections.abc import Iterator


def common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix, ``at`` bytes of which are known."""
    n = min(len(a), len(b))
    step = 16
    while at < n:
        x, y = a[at : at + step], b[at : at + step]
        if x != y:
            if step == 16:
                for u, v in zip(x, y, strict=False):
                    if u != v:
                        return at
                    at += 1
                return at
            step = 16
            continue
        at += len(x)
        step = min(4096, step * 4)
    return n


def front_code(ordered: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Shared prefix lengths and rests of sorted strings."""
    shared, rests, last = [], [], b""
    for s in ordered:
        h = common(last, s, 0)
        shared.append(h)
        rests.append(s[h:])
        last = s
    return shared, rests


def merge(runs: list[Iterator[tuple[int, bytes, object]]]) -> Iterator[tuple[int, bytes, object]]:
    """All strings in order, each with the length of the prefix shared with its predecessor, and its load.

    A run gives (shared with its predecessor, rest, load).
    """
    k = len(runs)
    word: list[bytes | None] = [b""] * k
    load: list = [None] * k
    known = [0] * k

    def advance(i: int) -> None:
        for h, rest, x in runs[i]:
            word[i], load[i], known[i] = word[i][:h] + rest, x, h  # the last one put out was this run's own
            return
        word[i] = None

    def play(i: int, j: int) -> tuple[int, int]:
        """Winner and loser; ended runs lose."""
        a, b = word[i], word[j]
        if a is None or b is None:
            return (j, i) if a is None else (i, j)
        if known[i] != known[j]:
            return (i, j) if known[i] > known[j] else (j, i)
        h = common(a, b, known[i])
        first = h == len(a) or (h < len(b) and a[h] < b[h])
        winner, loser = (i, j) if first else (j, i)
        known[loser] = h
        return winner, loser

    for i in range(k):
        advance(i)
    size = 1
    while size < k:
        size *= 2
    losers = [-1] * size
    entrants = [*range(k), *[-1] * (size - k)]
    node = size
    while len(entrants) > 1:
        node //= 2
        nxt = []
        for m in range(0, len(entrants), 2):
            i, j = entrants[m], entrants[m + 1]
            w, lost = (i, j) if j < 0 else play(i, j)
            losers[node + m // 2] = lost
            nxt.append(w)
        entrants = nxt
    winner = entrants[0] if entrants else -1
    while winner >= 0 and word[winner] is not None:
        yield known[winner], word[winner], load[winner]
        advance(winner)
        at = (size + winner) // 2
        while at:
            if losers[at] >= 0:
                winner, losers[at] = play(winner, losers[at])
            at //= 2
