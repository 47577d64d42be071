"""Byte-pair merging with a heap and a linked list, over a tokenizers JSON file.

Symbols are kept as integers.  ``Merges.count`` returns the number of symbols
that are left and builds no identifiers; ``Merges.encode`` returns them.
"""

from __future__ import annotations

import json
from heapq import heapify, heappop, heappush

import regex

#: White space as the Unicode property has it; ``\\s`` of the regex module has more.
SPACE = r"\t-\r \x85\xa0  -     　"


_POSITION = (1 << 40) - 1


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves; the other bytes take
    the code points from 256 upwards, in order.
    """
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Merges:
    """A vocabulary and its merge rules, read from a tokenizers JSON file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in self.vocab.items()}
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        alphabet = byte_alphabet()
        self.first = [self.vocab[c] for c in alphabet]
        self.last = [self.vocab[c + self.end] for c in alphabet]
        #: A pair of symbols, as one number, to its rank; the rank to the merged symbol.
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[self.vocab[a] << 20 | self.vocab[b]] = len(self.merged)
            self.merged.append(self.vocab[a + b])

    def symbols(self, word: bytes, final: bool = True) -> list[int]:
        """One symbol for each byte; the last one carries the word end if ``final``."""
        out = [self.first[b] for b in word]
        if final and out:
            out[-1] = self.last[word[-1]]
        return out

    def spell(self) -> None:
        """Fill ``spelled``: the bytes that each token stands for."""
        back = {c: b for b, c in enumerate(byte_alphabet())}
        self.spelled = {i: bytes(back[c] for c in (t[: -len(self.end)] if self.end and t.endswith(self.end) else t)) for t, i in self.vocab.items()}

    def _merge(self, sym: list[int]) -> int:
        """Merge in place until no rule applies; returns the number of merges.

        Merged-away positions hold -1.  A heap entry is ``rank << 40 | position``:
        the lowest rank comes first, and among equal ranks the leftmost pair.
        It is stale when the pair at its position has another rank by now.
        """
        n, rank_of, merged = len(sym), self.rank.get, self.merged
        heap = [r << 40 | i for i in range(n - 1) if (r := rank_of(sym[i] << 20 | sym[i + 1])) is not None]
        if not heap:
            return 0
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapify(heap)
        merges = 0
        while heap:
            top = heappop(heap)
            i, rank = top & _POSITION, top >> 40
            j = after[i]
            if sym[i] < 0 or j >= n or rank_of(sym[i] << 20 | sym[j]) != rank:
                continue
            sym[i] = new = merged[rank]
            sym[j] = -1
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of(new << 20 | sym[k])) is not None:
                    heappush(heap, r << 40 | i)
            h = before[i]
            if h >= 0 and (r := rank_of(sym[h] << 20 | new)) is not None:
                heappush(heap, r << 40 | h)
        return merges

    def count(self, word: bytes) -> int:
        """Tokens of a word: its initial symbols less the merges."""
        return len(word) - self._merge(self.symbols(word))

    def encode(self, word: bytes, final: bool = True) -> list[int]:
        """Token identifiers of a word."""
        sym = self.symbols(word, final)
        self._merge(sym)
        return [s for s in sym if s >= 0]

    def encode_short(self, word: bytes, final: bool = True) -> list[int]:
        """``encode`` for a few bytes, where the lowest rank is found sooner by looking through all than with a heap."""
        sym = self.symbols(word, final)
        rank_of, merged, none = self.rank.get, self.merged, len(self.merged)
        ranks = [rank_of(a << 20 | b, none) for a, b in zip(sym, sym[1:], strict=False)]
        while ranks and (low := min(ranks)) < none:
            i = ranks.index(low)
            sym[i] = merged[low]
            del sym[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of(sym[i] << 20 | sym[i + 1], none)
            if i:
                ranks[i - 1] = rank_of(sym[i - 1] << 20 | sym[i], none)
        return sym


class Remembered(dict):
    """word -> value, filled on demand and emptied at ``limit`` entries (under 300 bytes each); long words aren't kept."""

    def __init__(self, make, limit: int = 300_000, longest: int = 40) -> None:
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest

    def __missing__(self, word: str):
        value = self.make(word)
        if len(word) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[word] = value
        return value
