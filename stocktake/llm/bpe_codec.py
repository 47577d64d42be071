"""BPE encoding and decoding with tree concatenation (operator 6).

Texts are cut into words, and each distinct word is encoded once.  A word is cut
into leaves of ``LEAF_BYTES``; the leaves are encoded, and neighbours are then
concatenated pairwise as a tree.  At each join the last tokens of the left side
and the first ones of the right side are encoded again as one string; the
window grows until both of its edges agree with what stands beside it.

A text of over ``LONG_CHARS`` characters is cut into pieces that Spark encodes in
parallel: runs of whole words, and parts of words of over ``PIECE_BYTES``.  The
parts of one word are concatenated by the same tree.

Agreement is exact: a token sequence is the encoding of its string if and
only if each adjacent pair of tokens is the encoding of that pair's string.
Inside both sides and inside the window all pairs are so by construction, so
only the two pairs at the window's edges are tested.

Null and empty texts give no tokens and an empty decoded text.  Repeated rows
give repeated results; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stocktake.llm._bpe import SPACE, Merges, Remembered, byte_alphabet
from stocktake.llm._rows import map_texts, narrow, stream

#: Bytes of a leaf of a word.
LEAF_BYTES = 12
#: Characters from which on a text is encoded in pieces, and bytes of a piece.
LONG_CHARS, PIECE_BYTES = 1 << 16, 1 << 15

_PACKED, _SHOWN = itemgetter(0), itemgetter(1)
_PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿŒœ]*")
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿœ]+|[0-9]|[^\t-\r a-z0-9ß-öø-ÿœ]+")
_GAPS = regex.compile(rf"[{SPACE}]+")
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
_DDL = "doc_id long, ids array<int>, decoded string"


class Codec:
    """Encodes and decodes texts word by word; remembers short words."""

    def __init__(self, path: str) -> None:
        self.merges = Merges(path)
        remember(self.merges)
        self.library = Tokenizer.from_file(path)
        self.bytes_of = {c: b for b, c in enumerate(byte_alphabet())}
        self.ids_of_word = Remembered(self.packed)
        self.coded = Remembered(self.code)
        self.words_of_stretch = Remembered(self.library_words, 50_000)

    def packed(self, word: str) -> bytes:
        """Identifiers of a word, four bytes each."""
        return array("i", grown(self.merges, word.encode(), True)).tobytes()

    def code(self, word: str) -> tuple[bytes, str]:
        """Identifiers of a word, four bytes each, and what they are decoded to."""
        ids = grown(self.merges, word.encode(), True)
        return array("i", ids).tobytes(), self.decode(ids)

    def words(self, part: str) -> list[str]:
        """The words of a text without special strings, composed and in lower case.

        Plain Latin letters need no composing and have one lower case in all
        versions of Unicode.  In other texts each stretch between white space that
        holds something else goes through the library's rules; white space is dropped
        by this kind of vocabulary and never lies within a word.
        """
        if _PLAIN.fullmatch(part):
            return _WORDS.findall(part.lower())
        # The first four are white space to str.split() alone.
        stretches = [s for s in _GAPS.split(part) if s] if any(c in part for c in "\x1c\x1d\x1e\x1f") else part.split()
        words: list[str] = []
        for s in stretches:
            words += _WORDS.findall(s.lower()) if _PLAIN.fullmatch(s) else self.words_of_stretch[s]
        return words

    def library_words(self, stretch: str) -> list[str]:
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(stretch))
        return [bytes(map(self.bytes_of.__getitem__, w)).decode() for w, _ in cut]

    def parts(self, text: str) -> Iterator[tuple[int | None, str]]:
        """The text cut at special strings: (its identifier, nothing) or (None, what stands between)."""
        for part in self.merges.split_special.split(text) if any(s in text for s in self.merges.special) else [text]:
            if part in self.merges.special:
                yield self.merges.special[part], ""
            else:
                yield None, part

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in the file, the tokens are joined by a space."""
        return " ".join(map(self.merges.names.__getitem__, ids))

    def round_trip(self, text: str) -> tuple[bytes, str]:
        """Identifiers, four bytes each, and the text decoded from them."""
        ids, shown = [], []
        for special, part in self.parts(text):
            if special is not None:
                ids.append(array("i", [special]).tobytes())
                shown.append(self.merges.names[special])
            else:
                both = list(map(self.coded.__getitem__, self.words(part)))
                ids.extend(map(_PACKED, both))
                shown.extend(map(_SHOWN, both))
        return b"".join(ids), " ".join(shown)


@lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    """Kept by the worker process, with what it remembers."""
    return Codec(path)


def remember(merges: Merges) -> None:
    """Give the merges a memory of short strings, by whether they end a word, and of pairs of tokens."""
    merges.spell()
    merges.leaves = [Remembered(lambda raw, f=f: tuple(merges.encode_short(raw, f) if len(raw) <= 2 * LEAF_BYTES else merges.encode(raw, f)), 100_000) for f in (False, True)]

    def pair(key: int) -> bool:
        x, y, final = key >> 21, key >> 1 & 0xFFFFF, bool(key & 1)
        return list(_leaf(merges, merges.spelled[x] + merges.spelled[y], final)) == [x, y]

    merges.pairs = Pairs(pair)


class Pairs(dict):
    """Answers by number, filled on demand and emptied at a million."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, key: int) -> bool:
        if len(self) >= 1_000_000:
            self.clear()
        self[key] = value = self.make(key)
        return value


def lists(packed: list[bytes]) -> pa.Array:
    """Arrow lists of identifiers from packed ones."""
    offsets = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(packed))]))


def concatenate(merges: Merges, left: list[int], right: list[int], final: bool) -> list[int]:
    """The encoding of two neighbouring strings from their own encodings.

    ``final`` says whether the right string ends the word.
    """
    if not left or not right:
        return left or right
    size = 2
    while True:
        a, b = max(0, len(left) - size), min(size, len(right))
        middle = _again(merges, left[a:] + right[:b], final and b == len(right))
        before = a == 0 or _pair(merges, left[a - 1], middle[0], final and b == len(right) and len(middle) == 1)
        behind = b == len(right) or _pair(merges, middle[-1], right[b], final and b + 1 == len(right))
        if before and behind:
            return left[:a] + middle + right[b:]
        size *= 2


def _again(merges: Merges, ids: list[int], final: bool) -> list[int]:
    return list(_leaf(merges, b"".join(merges.spelled[i] for i in ids), final))


def _leaf(merges: Merges, raw: bytes, final: bool) -> tuple[int, ...]:
    """The encoding of a few bytes, from the memory where they were met before."""
    return merges.leaves[final][raw]


def _pair(merges: Merges, x: int, y: int, final: bool) -> bool:
    """Whether two tokens are the encoding of their string."""
    return merges.pairs[x << 21 | y << 1 | final]


def tree(merges: Merges, leaves: list[list[int]], final: bool = True) -> list[int]:
    """Concatenate neighbours pairwise, level by level, until one encoding is left; ``final``: it ends the word."""
    while len(leaves) > 1:
        last = len(leaves) - 1
        leaves = [concatenate(merges, leaves[i], leaves[i + 1], final and i + 1 == last) if i < last else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else []


def grown(merges: Merges, raw: bytes, final: bool) -> list[int]:
    """The encoding of a word, or of a part of one, from its leaves; ``final`` says whether it ends the word."""
    size = len(raw)
    if size <= LEAF_BYTES:
        return merges.encode_short(raw, final)
    return tree(merges, [list(_leaf(merges, raw[a : a + LEAF_BYTES], final and a + LEAF_BYTES >= size)) for a in range(0, size, LEAF_BYTES)], final)


_PIECES = [("doc_id", pa.int64()), ("row", pa.int64()), ("seq", pa.int64()), ("word", pa.int64()), ("special", pa.int32()), ("words", pa.list_(pa.string())), ("part", pa.binary()), ("final", pa.bool_())]


def long_texts(docs: DataFrame, path: str) -> DataFrame:
    """The parallel way: pieces are dealt over all tasks, then joined text by text."""
    marked = docs.withColumn("row", F.monotonically_increasing_id())

    def pieces(cutter: Codec, text: str) -> Iterator[tuple]:
        """(number of a long word, special token, words, part of a long word, whether the last)."""
        held: list[str] = []
        size = long_words = 0
        for special, between in cutter.parts(text):
            for w in cutter.words(between):
                if 4 * len(w) > PIECE_BYTES and len(raw := w.encode()) > PIECE_BYTES:
                    if held:
                        yield None, None, held, None, None
                        held, size = [], 0
                    long_words += 1
                    for a in range(0, len(raw), PIECE_BYTES):
                        yield long_words, None, None, raw[a : a + PIECE_BYTES], a + PIECE_BYTES >= len(raw)
                    continue
                held.append(w)
                size += len(w)
                if size > PIECE_BYTES:
                    yield None, None, held, None, None
                    held, size = [], 0
            if special is not None:
                if held:
                    yield None, None, held, None, None
                    held, size = [], 0
                yield None, special, None, None, None
        if held:
            yield None, None, held, None, None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = codec(path)
        for batch in batches:
            for doc_id, row, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "text")), strict=True):
                for seq, piece in enumerate(pieces(cutter, text)):
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, (_, t) in zip((doc_id, row, seq, *piece), _PIECES, strict=True)], names=[n for n, _ in _PIECES])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            ids = []
            for special, words, part, final in zip(*(batch.column(c).to_pylist() for c in ("special", "words", "part", "final")), strict=True):
                if special is not None:
                    ids.append(array("i", [special]).tobytes())
                elif words is not None:
                    ids.append(b"".join(map(own.ids_of_word.__getitem__, words)))
                else:
                    ids.append(array("i", grown(own.merges, part, final)).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "row", "seq", "word")), lists(ids)], names=["doc_id", "row", "seq", "word", "ids"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joiner = codec(path)
        at: tuple | None = None
        ids: list[int] = []
        sides: list[list[int]] = []
        word = None

        def done() -> pa.RecordBatch:
            ids.extend(tree(joiner.merges, sides))
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([ids], pa.list_(pa.int32())), pa.array([joiner.decode(ids)], pa.string())], schema=_SCHEMA)

        for batch in batches:
            for doc_id, row, w, own in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "word", "ids")), strict=True):
                if (doc_id, row) != at:
                    if at is not None:
                        yield done()
                    at, ids, sides, word = (doc_id, row), [], [], None
                if w != word:
                    ids.extend(tree(joiner.merges, sides))
                    sides, word = [], w
                if w is None:
                    ids.extend(own)
                else:
                    sides.append(own)
        if at is not None:
            yield done()

    cuts = stream(marked, cut, "doc_id long, row long, seq long, word long, special int, words array<string>, part binary, final boolean")
    encoded = stream(cuts.repartition("row", "seq"), encode, "doc_id long, row long, seq long, word long, ids array<int>")
    return stream(encoded.repartition("row").sortWithinPartitions("row", "seq"), join, _DDL)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, decoded`` for every row of ``docs``."""
    rows = narrow(docs, id_col, text_col)
    is_long = F.length("text") > LONG_CHARS

    def start():
        own = codec(path)

        def work(rest, texts):
            both = [own.round_trip(t) for t in texts]
            return [rest[0], lists([b[0] for b in both]), [b[1] for b in both]]

        return work

    usual = map_texts(rows.where(~is_long), _DDL, _SCHEMA, start)
    return usual.unionByName(long_texts(rows.where(is_long), path))
