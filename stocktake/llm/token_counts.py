"""Token counts by heap-and-linked-list byte-pair merging (operator 10).

A text is cut at special strings (one token each) and by the byte-level
pattern into words.  For each word the lowest-rank adjacent pair is popped
from a heap again and again; the count is the initial symbols less the
merges, so no identifiers are made.  Counts of short words are remembered
within a task.

The pattern's letters and digits are those of the Unicode version of the
library; texts with younger ones are cut into words by the library itself.

Null and empty texts have 0 bytes and 0 tokens.  Repeated rows give repeated
results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenizers import Tokenizer

from stocktake.llm._bpe import SPACE, Merges, Remembered, byte_alphabet
from stocktake.llm._rows import map_texts, narrow

#: Longer segments are walked match by match instead of listing their words.
LISTED_CHARS = 2_000_000

_WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

#: A space followed by another white-space character: such texts aren't cut at spaces.
_UNEVEN = tuple(" " + c for c in "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
_UNEVEN_ASCII = _UNEVEN[:6]


@lru_cache(maxsize=1)
def younger() -> regex.Pattern:
    """Letters and digits of ``_WORDS`` that Python's older Unicode tables, and the library's, don't have yet."""
    unassigned = "".join(c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) == "Cn")
    found = "".join(regex.findall(r"[\p{L}\p{N}]", unassigned))
    starts = [c for i, c in enumerate(found) if not i or ord(found[i - 1]) + 1 != ord(c)]
    ends = [c for i, c in enumerate(found) if i + 1 == len(found) or ord(found[i + 1]) - 1 != ord(c)]
    return regex.compile("[" + "".join(f"{a}-{b}" for a, b in zip(starts, ends, strict=True)) + "]" if found else "(?!)")


@lru_cache(maxsize=1)
def counter(path: str):
    """A function from a text to its number of tokens; kept, with what it remembers, by the worker process."""
    merges = Merges(path)
    library, recent = Tokenizer.from_file(path), younger()
    byte_of = {c: b for b, c in enumerate(byte_alphabet())}
    words = Remembered(lambda word: merges.count(word.encode()))
    cuts = Remembered(lambda cut: walked(" " + cut))

    def walked(segment: str) -> int:
        found = _WORDS.findall(segment) if len(segment) <= LISTED_CHARS else (m[0] for m in _WORDS.finditer(segment))
        return sum(map(words.__getitem__, found))

    def of_segment(segment: str) -> int:
        # A space after and before other characters always begins a word of the
        # pattern, so that the text may be cut there.
        if not segment.isascii() and recent.search(segment):
            return sum(merges.count(bytes(map(byte_of.__getitem__, w))) for w, _ in library.pre_tokenizer.pre_tokenize_str(segment))
        if len(segment) > LISTED_CHARS or any(p in segment for p in (_UNEVEN_ASCII if segment.isascii() else _UNEVEN)):
            return walked(segment)
        first, *rest = segment.split(" ")
        if rest and not rest[-1]:
            return walked(segment)
        return walked(first) + sum(map(cuts.__getitem__, rest))

    def of_text(text: str) -> int:
        if not any(s in text for s in merges.special):
            return of_segment(text)
        return sum(1 if part in merges.special else of_segment(part) for part in merges.split_special.split(text))

    return of_text


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``."""

    def start():
        of_text = counter(path)
        return lambda rest, texts: [rest[0], [len(t.encode()) for t in texts], [of_text(t) for t in texts]]

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
    counted = map_texts(narrow(docs, id_col, text_col), "doc_id long, n_bytes long, n_tokens long", schema, start)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
