"""Secret scanning with a token-efficiency test (operator 8).

Three patterns give the base spans.  Besides, every long run of key-like
characters is encoded with a public byte-pair vocabulary: prose and ordinary
identifiers need few tokens for their length, random strings need many.  A run
with few characters per token is a span of kind ``random``, unless it is a
digest of a known length, a UUID, a number, or an identifier made of plain
words.  Of a run that is in part made of words, as a path or a query string, the parts
between separators are looked at instead, so that a key isn't hidden by what surrounds it.
Runs inside a base span aren't reported again.

Null and empty texts have no spans.  Repeated rows give repeated results; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocktake.llm._rows import map_texts, narrow

# The base kinds in their order, and the least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
MIN_VALUE, MIN_ACCESS = 6, 20
_KEYWORDS = ("passw", "secret", "token", "api")

_RUN, _PART = re.compile(r"[A-Za-z0-9+/_=-]{20,}"), re.compile(r"[A-Za-z0-9]{20,}")
_SEPARATOR, _WORD = re.compile(r"[+/_=-]+"), re.compile(r"[A-Z]?[a-z]{3,}|[A-Z]{3,}")
#: Hexadecimal characters of the common digests: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
DIGEST_LENGTHS = frozenset({32, 40, 56, 64, 96, 128})
_HEX_ONLY = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_PLAIN_WORDS = re.compile(r"(?:[A-Z]?[a-z]{3,}|[A-Z]{3,}|[0-9]{1,4}|[a-z]{1,2})(?:[-_/=+](?:[A-Z]?[a-z]{3,}|[A-Z]{3,}|[0-9]{1,4}|[a-z]{1,2}))*")


@lru_cache(maxsize=1)
def vocabulary(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def is_random(run: str, encoding: tiktoken.Encoding, most: float) -> bool:
    """Whether a run holds at most ``most`` characters a token and isn't a known form."""
    if not any(c.isalpha() for c in run):
        return False
    if _HEX_ONLY.fullmatch(run) and len(run) in DIGEST_LENGTHS or _UUID.fullmatch(run) or _PLAIN_WORDS.fullmatch(run):
        return False
    return len(run) <= most * len(encoding.encode_ordinary(run))


def spans_of(text: str, encoding: tiktoken.Encoding, most: float) -> list[tuple[str, int, int]]:
    """All spans of a text by start, then by kind as listed."""
    found = []
    lower = text.lower()
    if any(k in lower for k in _KEYWORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    # A run is inside a base span if one that begins no later ends no earlier.
    found.sort(key=lambda x: x[1])
    starts, reach = [x[1] for x in found], list(accumulate((x[2] for x in found), max))
    for m in _RUN.finditer(text):
        plain = sum(len(x) for x in _SEPARATOR.split(m[0]) if _WORD.fullmatch(x))
        parts = [m] if 3 * plain < len(m[0]) else _PART.finditer(m[0])
        for p in parts:
            if not is_random(p[0], encoding, most):
                continue
            a = p.start() + (0 if p is m else m.start())
            b = a + len(p[0])
            at = bisect_right(starts, a)
            if not at or reach[at - 1] < b:
                found.append(("random", a, b))
    order = {k: i for i, k in enumerate((*KINDS, "random"))}
    return sorted(found, key=lambda s: (s[1], order[s[0]]))


def find_secrets(docs: DataFrame, path: str, pattern: str, most_chars_per_token: float = 2.2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans`` for every row; spans are ``(kind, start, end)`` in code points, end exclusive."""
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def start():
        encoding = vocabulary(path, pattern)
        keys = ("kind", "start", "end")
        return lambda rest, texts: [rest[0], [[dict(zip(keys, s, strict=True)) for s in spans_of(t, encoding, most_chars_per_token)] for t in texts]]

    return map_texts(narrow(docs, id_col, text_col), "doc_id long, spans array<struct<kind: string, start: bigint, end: bigint>>", pa.schema([("doc_id", pa.int64()), ("spans", spans)]), start)


def joined(spans: Column | str) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
