"""Language-model scoring by context-tree weighting over bytes (operator 5).

A text is its UTF-8 bytes and an end symbol.  Each byte is coded as eight
binary decisions, and each decision is predicted in the context of the bytes
before it.  Contexts form a tree of nested levels; a node
estimates its bit by Krichevsky-Trofimov counts, and the weighting mixes all
levels: a node's probability of the training text is half its own estimate and
half the product of its children's.  The mixture weights that follow from this
give the prediction of new bits along a path.

The upper levels take the last 0 to 3 bytes as classes (63 for the last byte,
32 for the two before), the lower ones the last 3, 4 and 5 bytes (``DEEP``, at
most 7) as they are.  They and the coded byte are a key, without hashing.

The counts of the keys are a table that grows with the corpus.  Documents are
dealt to chunks; a chunk's distinct keys go as packed arrays to the bucket of
their three classes, so that a bucket has whole subtrees.  Buckets add up the
keys of all chunks and weight their subtrees; only sums for the levels of 0 to
2 bytes (at most 2**19 of each kind) reach the driver.  Then each bucket answers
the keys of each chunk, and a chunk scores its documents by these answers.  A
task holds the distinct training keys of one bucket, or those of one chunk.

Beside the model there is a base score from word counts.  Words are resolved
in two ways that together are exact: words that make up at least one
``1/FREQUENT`` of all tokens number at most ``FREQUENT`` and are broadcast; the
occurrences of all others are joined with the counts by a shuffle.

Null and empty texts hold one token (the end) and have the probability of the
end symbol.  With no training text counts are 0: V is 0 and N is 0.  Rows that
repeat an identifier keep a result each.  An empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocktake.llm._graph import settled, with_checkpoints
from stocktake.llm._rows import groups, narrow, stream
from stocktake.llm._shingles import mix

#: At most so many words are broadcast.
FREQUENT = 500_000
#: Never a byte of UTF-8: the end symbol, and the context before a text.
END = 0xFF
#: Bytes that are indexed at once.
BLOCK = 1_000_000
#: Bytes of the longest context: with the coded byte they are a key.
DEEP = 5
#: Bytes of text in a chunk, and of all text for a bucket; buckets at least.
CHUNK, SHARE, BUCKETS = 1 << 26, 1 << 26, 256


def _classes(fine: bool) -> np.ndarray:
    """Byte -> class: fine has 63 for the last byte, else 32 for the ones before."""
    out = np.zeros(256, np.int32)
    for b in range(256):
        c = chr(b).lower() if b < 128 else ""
        if "a" <= c <= "z":
            k = ord(c) - 97
        elif c and c in "0123456789":
            k = 26
        elif b < 128:
            spaces, marks = " \t\r\n\v\f", ".,"
            k = ({" ": 27, "\n": 28}.get(c, 31) if c in spaces else 29 + marks.index(c) if c in marks else 32 if b > 32 else 31) if fine else 27 if c in spaces else 28
        elif b >= 0xC0:
            k = (33 if b == 0xC3 else 38 if b == END else 34 if b < 0xE0 else 35 if b < 0xF0 else 36) if fine else 29
        else:
            k = (39 + (b - 0xA0) // 2 if b >= 0xA0 else 55 + (b - 0x80) // 4) if fine else 30 + (b >= 0xA0)
        out[b] = k
    return out


_FIRST, _BEFORE = _classes(True), _classes(False)


def symbols(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 24-bit numbers of all bytes and ends of some texts, and where each text's begin."""
    gap = bytes([END]) * 3
    data = np.frombuffer(gap + b"".join(r + gap for r in raw), np.uint8)
    index = (_FIRST[data[2:-1]] << 18) | (_BEFORE[data[1:-2]] << 13) | (_BEFORE[data[:-3]] << 8) | data[3:]
    sizes = np.array([len(r) for r in raw], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes + 3)[:-1]))
    keep = np.ones(len(index), bool)
    ends = starts + sizes
    keep[ends + 1] = keep[ends + 2] = False
    return index[keep], starts - 2 * np.arange(len(raw))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for positive x: shifted by eight, then Stirling's series."""
    y = x + 8
    low = np.ones_like(x)
    for k in range(8):
        low *= x + k
        if k % 4 == 3:
            y = y - np.log(low)
            low = np.ones_like(x)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) + (y - z)


def kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log-probability of counted bits in the Krichevsky-Trofimov estimate."""
    total = n0 + n1
    seen = total > 0
    out = np.zeros(n0.shape)
    a, b = n0[seen].astype(np.float64), n1[seen].astype(np.float64)
    out[seen] = log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - math.log(math.pi)
    return out


def bits(counts: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones of the ``level``-th bit, by the bits before it; the last axis is the byte."""
    split = counts.reshape(*counts.shape[:-1], 1 << level, 2, 1 << (7 - level)).sum(axis=-1)
    return split[..., 0], split[..., 1]


def weighted(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted log-probability of a node, and the weight of its own estimate."""
    both = np.logaddexp(own, below) - math.log(2)
    return both, np.exp(own - math.log(2) - both)


def probability_table(index: np.ndarray, count: np.ndarray) -> np.ndarray:
    """log10 probability of each coded byte in each context, from the counts of the seen ones."""
    order = np.argsort(index, kind="stable")
    index, count = index[order], count[order].astype(np.float64)
    cut = np.searchsorted(index, np.arange(65) << 18)

    def of_class(c: int) -> np.ndarray:
        part = np.zeros(1 << 18)
        part[index[cut[c] : cut[c + 1]] & 0x3FFFF] = count[cut[c] : cut[c + 1]]
        return part.reshape(32, 32, 256)

    by_first = np.stack([of_class(c).sum(axis=(0, 1)) for c in range(64)])
    top = []  # per level: own estimate and weight at the root; filled after the subtrees
    below_first = [np.zeros((64, 1 << k)) for k in range(8)]
    kept = []
    for c in range(64):
        leaf = of_class(c)
        two = leaf.sum(axis=1)
        weights = []
        for k in range(8):
            deep = kt(*bits(leaf, k)).sum(axis=1)
            w2, own2 = weighted(kt(*bits(two, k)), deep)
            w1, own1 = weighted(kt(*bits(by_first[c], k)), w2.sum(axis=0))
            below_first[k][c] = w1
            weights.append((own1, own2))
        kept.append(weights)
    root = by_first.sum(axis=0)
    for k in range(8):
        top.append(weighted(kt(*bits(root, k)), below_first[k].sum(axis=0))[1])

    def one(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
        return (n1 + 0.5) / (n0 + n1 + 1)

    table = np.empty(1 << 24, np.float32)
    for c in range(64):
        leaf = of_class(c)
        two = leaf.sum(axis=1)
        total = np.zeros((32, 32, 256))
        for k in range(8):
            own1, own2 = kept[c][k]
            p = one(*bits(leaf, k))
            p = own2[:, None, :] * one(*bits(two, k))[:, None, :] + (1 - own2[:, None, :]) * p
            p = own1 * one(*bits(by_first[c], k)) + (1 - own1) * p
            p = top[k] * one(*bits(root, k)) + (1 - top[k]) * p
            each = np.stack([np.log10(1 - p), np.log10(p)], axis=-1)
            total += np.repeat(each.reshape(32, 32, 2 << k), 1 << (7 - k), axis=-1)
        table[c << 18 : (c + 1) << 18] = total.reshape(-1)
    return table


def keys_of(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The key of each byte and end of some texts (the last byte comes first, the coded one last), and where each text's begin."""
    gap = bytes([END]) * DEEP
    data = bytes([END]) * (8 - DEEP) + gap + b"".join(r + gap for r in raw)
    n = len(data) - 8
    before = np.ndarray(n, "<u8", data, strides=(1,))
    key = (before >> np.uint64(8 * (8 - DEEP)) << np.uint64(8)) | np.frombuffer(data, np.uint8)[8:]
    sizes = np.array([len(r) for r in raw], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes + DEEP)[:-1]))
    keep = np.ones(n, bool)
    for k in range(1, DEEP):
        keep[starts + sizes + k] = False
    return key[keep], starts - (DEEP - 1) * np.arange(len(raw))


def class_of(context: np.ndarray) -> np.ndarray:
    """Three bytes -> their classes, in 16 bits."""
    c = context.astype(np.int64)
    return ((_FIRST[c >> 16] << 10) | (_BEFORE[c >> 8 & 255] << 5) | _BEFORE[c & 255]).astype(np.uint64)


def shorter(context: np.ndarray, level: int) -> np.ndarray:
    """Contexts one level up; level 0 has ``DEEP`` bytes, the last but one 3, the last 3 classes."""
    return context >> np.uint64(8) if level < DEEP - 3 else class_of(context)


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and their sums."""
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


_HALF = log_gamma(np.arange(4096) + 0.5)
_WHOLE = log_gamma(np.arange(8192) + 1.0) + math.log(math.pi)


def kt_small(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """As ``kt``, from tables where counts are small."""
    small = (n0 < 4096) & (n1 < 4096)
    if small.all():
        return _HALF[n0] + _HALF[n1] - _WHOLE[n0 + n1]
    out = np.empty(n0.shape)
    out[small] = _HALF[n0[small]] + _HALF[n1[small]] - _WHOLE[n0[small] + n1[small]]
    out[~small] = kt(n0[~small], n1[~small])
    return out


def mixed(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``weighted``."""
    part = np.exp(-np.abs(own - below))
    both = np.maximum(own, below) + np.log1p(part) - math.log(2)
    return both, np.where(own > below, 1, part) / (1 + part)


class Subtrees:
    """All nodes at and below the levels of three classes, from the sorted distinct keys of a bucket."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.levels = [(keys, n)]
        for level in range(DEEP - 2):
            keys, n = self.levels[-1]
            self.levels.append(summed((shorter(keys >> np.uint64(8), level) << np.uint64(8)) | (keys & np.uint64(255)), n))

    def bit(self, k: int) -> list[tuple[np.ndarray, ...]]:
        """For the ``k``-th bit, deepest level first: nodes, probability of a one, weight of it, place of the node above, weighted log-probability."""
        out: list[tuple[np.ndarray, ...]] = []
        up, log = np.zeros(0, np.int64), np.zeros(0)
        nodes = self.nodes(0, k)
        for level in range(len(self.levels)):
            keys, n = self.levels[level]
            first = np.searchsorted(keys, nodes << np.uint64(8 - k)) if len(nodes) else np.zeros(0, np.int64)
            one = n * (keys >> np.uint64(7 - k) & np.uint64(1)).astype(np.int64)
            total, ones = (np.add.reduceat(x, first) if len(first) else n for x in (n, one))
            own = kt_small(total - ones, ones)
            both, weight = mixed(own, np.bincount(up, log, len(nodes))) if level else (own, np.ones(len(own)))
            above = self.nodes(level + 1, k) if level + 1 < len(self.levels) else nodes
            to = np.searchsorted(above, self.parent(nodes, level, k)) if level + 1 < len(self.levels) else np.zeros(0, np.int64)
            out.append((nodes, (ones + 0.5) / (total + 1), weight, to, both))
            nodes, up, log = above, to, both
        return out

    def nodes(self, level: int, k: int) -> np.ndarray:
        node = self.levels[level][0] >> np.uint64(8 - k)
        return node[np.concatenate(([True], node[1:] != node[:-1]))] if len(node) else node

    def parent(self, nodes: np.ndarray, level: int, k: int) -> np.ndarray:
        return (shorter(nodes >> np.uint64(k), level) << np.uint64(k)) | (nodes & np.uint64((1 << k) - 1))

    def top(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For the levels above: context of two classes and byte, their counts; context and node (as in a heap), their log-probabilities."""
        keys, n = self.levels[-1]
        cells, count = summed((keys >> np.uint64(13) << np.uint64(8)) | (keys & np.uint64(255)), n)
        at, log = [], []
        for k in range(8):
            nodes, *_, both = self.bit(k)[-1]
            at.append((nodes >> np.uint64(k + 5) << np.uint64(8)) | (nodes & np.uint64((1 << k) - 1)) + np.uint64(1 << k))
            log.append(both)
        places, which = np.unique(np.concatenate(at), return_inverse=True)
        return cells.astype(np.int64), count, places.astype(np.int64), np.bincount(which, np.concatenate(log), len(places))

    def answer(self, asked: list[np.ndarray], above: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
        """log10 probability of the coded byte for each of some arrays of sorted keys."""
        keys = self.levels[0][0]
        known = np.zeros(len(keys))
        new = [a[~_in(a, keys)] for a in asked]
        missing = np.unique(np.concatenate(new)) if new else keys[:0]
        unknown = np.zeros(len(missing))
        for k in range(8):
            levels = self.bit(k)
            last = len(levels) - 1
            a = b = None
            context = missing >> np.uint64(8)
            prefix = missing >> np.uint64(8 - k) & np.uint64((1 << k) - 1)
            contexts = [context]
            for level in range(last):
                contexts.append(shorter(contexts[-1], level))
            heap = (contexts[-1].astype(np.int64) >> 5 << 8) + (1 << k) + prefix.astype(np.int64)
            guess = above[0][heap] + above[1][heap] / 2
            for level in range(last, -1, -1):
                nodes, p, weight, to, _ = levels[level]
                if level == last:
                    heap = (nodes >> np.uint64(k + 5)).astype(np.int64) * 256 + (1 << k) + (nodes & np.uint64((1 << k) - 1)).astype(np.int64)
                    a, b = above[0][heap], above[1][heap]
                else:
                    a, b = a[to], b[to]
                a, b = a + b * weight * p, b * (1 - weight)
                if len(nodes) and len(missing):
                    node = (contexts[level] << np.uint64(k)) | prefix
                    place = np.minimum(np.searchsorted(nodes, node), len(nodes) - 1)
                    seen = nodes[place] == node
                    guess[seen] = (a + b / 2)[place[seen]]
            one = (missing >> np.uint64(7 - k) & np.uint64(1)) > 0
            unknown += np.log10(np.where(one, guess, 1 - guess))
            place = np.searchsorted(levels[0][0], keys >> np.uint64(8 - k))
            one = (keys >> np.uint64(7 - k) & np.uint64(1)) > 0
            p = a[place] if len(keys) else known
            known += np.log10(np.where(one, p, 1 - p))
        out = []
        for want in asked:
            value = np.empty(len(want), np.float32)
            seen = _in(want, keys)
            value[seen] = known[np.searchsorted(keys, want[seen])]
            value[~seen] = unknown[np.searchsorted(missing, want[~seen])]
            out.append(value)
        return out


def _in(some: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(some), bool)
    return table[np.minimum(np.searchsorted(table, some), len(table) - 1)] == some


def upper_levels(count: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the levels of 0 to 2 bytes give: the probability of a one is the first plus the second times that of the level below.

    ``count`` is by two classes and byte, ``below`` by two classes and node.
    """
    two = count.reshape(64, 32, 256)
    first, sums = two.sum(axis=1), below.reshape(64, 32, 256)
    base, share = np.zeros((64, 32, 256)), np.ones((64, 32, 256))
    for k in range(8):
        at = slice(1 << k, 2 << k)
        n = [bits(x, k) for x in (two, first, first.sum(axis=0))]
        w2, own2 = weighted(kt(*n[0]), sums[:, :, at])
        w1, own1 = weighted(kt(*n[1]), w2.sum(axis=1))
        own0 = weighted(kt(*n[2]), w1.sum(axis=0))[1]
        p2, p1, p0 = ((n1 + 0.5) / (n0 + n1 + 1) for n0, n1 in n)
        base[:, :, at] = own0 * p0 + (1 - own0) * (own1 * p1)[:, None, :] + ((1 - own0) * (1 - own1))[:, None, :] * own2 * p2
        share[:, :, at] = ((1 - own0) * (1 - own1))[:, None, :] * (1 - own2)
    return base.reshape(-1), share.reshape(-1)


def pack(keys: np.ndarray) -> bytes:
    """Sorted keys as compressed differences."""
    step = np.diff(keys, prepend=np.uint64(0))
    return pa.compress(np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True) if len(keys) else b""


def unpack(raw: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(pa.decompress(raw, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, n).T).view(np.uint64).ravel(), dtype=np.uint64)


def words(raw: bytes) -> list[bytes]:
    """Words of a text: A-Z lower-cased, split at ASCII white space."""
    return raw.lower().split()


def gather(docs: DataFrame) -> DataFrame:
    """Counts over all texts of ``docs``: ``word, n`` (the end is the word null)."""

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        ends = 0

        def flush(pairs: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                held.update(words(text.encode()))
                ends += 1
                if len(held) > 300_000:
                    yield flush([(w.decode(), n) for w, n in held.items()])
                    held.clear()
        yield flush([*((w.decode(), n) for w, n in held.items()), (None, ends)])

    return stream(docs.select("text"), count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")


_PACKED = "bucket int, chunk int, size long, keys binary, numbers binary"


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["bucket", "chunk", "size", "keys", "numbers"])


def chunk_keys(texts: DataFrame, buckets: int) -> DataFrame:
    """The distinct keys of each chunk (``chunk, learned, text``) by bucket, and how often training texts have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, size = None, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys, n = summed(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            to = (mix(class_of(keys >> np.uint64(8 * (DEEP - 2)))) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            cut = np.searchsorted(to[order], np.arange(buckets + 1))
            for a in range(0, buckets, 64):
                parts = [(i, order[cut[i] : cut[i + 1]]) for i in range(a, min(a + 64, buckets)) if cut[i] < cut[i + 1]]
                yield _packed([(i, chunk, len(p), pack(keys[p]), pa.compress(n[p].astype(np.uint32).tobytes(), codec="zstd", asbytes=True)) for i, p in parts])

        for batch in batches:
            numbers, learned, every = (batch.column(c).to_pylist() for c in ("chunk", "learned", "text"))
            cuts = [0, *(i for i in range(1, len(numbers)) if numbers[i] != numbers[i - 1]), len(numbers)]
            for u, v in zip(cuts, cuts[1:], strict=False):
                if u < v and numbers[u] != chunk:
                    if held:
                        yield from flush()
                    chunk, held, size = numbers[u], [], 0
                for a, b in groups(every[u:v], BLOCK):
                    for use in (0, 1):
                        raw = [t.encode() for t, x in zip(every[u + a : u + b], learned[u + a : u + b], strict=True) if x == use]
                        if raw:
                            keys, n = np.unique(keys_of(raw)[0], return_counts=True)
                            held.append((keys, n * use))
                            size += len(keys)
                    if len(held) > 1 and size > 6_000_000:
                        held = [summed(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))]
                        size = 0
        if held:
            yield from flush()

    return stream(texts.repartition("chunk").sortWithinPartitions("chunk"), run, _PACKED)


def bucket_sums(packed: DataFrame) -> DataFrame:
    """The training counts of each bucket (``chunk`` is null), and what the levels above need."""
    ddl = _PACKED + ", cells binary, counts binary, places binary, logs binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, size = None, [], 0

        def one() -> tuple[np.ndarray, np.ndarray]:
            return summed(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))

        def flush() -> pa.RecordBatch:
            keys, n = one()
            head = _packed([(bucket, None, len(keys), pack(keys), n.tobytes())])
            more = [pa.array([x.tobytes()], pa.binary()) for x in Subtrees(keys, n).top()]
            return pa.RecordBatch.from_arrays([*head.columns, *more], names=[*head.schema.names, "cells", "counts", "places", "logs"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["bucket"] != bucket:
                    if held:
                        yield flush()
                    bucket, held, size = r["bucket"], [], 0
                n = np.frombuffer(pa.decompress(r["numbers"], decompressed_size=4 * r["size"], codec="zstd", asbytes=True), np.uint32).astype(np.int64)
                held.append((unpack(r["keys"], r["size"])[n > 0], n[n > 0]))
                size += len(held[-1][0])
                if size > 1_000_000:
                    held, size = [one()], 0
        if held:
            yield flush()

    return stream(packed.repartition("bucket").sortWithinPartitions("bucket"), run, ddl)


def answers(packed: DataFrame, sums: DataFrame, above: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``chunk, size, keys, numbers``: the log10 probabilities of the keys of each chunk."""
    upper = packed.sparkSession.sparkContext.broadcast(above)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held, size = None, [], 0

        def flush() -> pa.RecordBatch:
            found = model.answer([unpack(r["keys"], r["size"]) for r in held], upper.value)
            return _packed([(r["bucket"], r["chunk"], r["size"], r["keys"], x.tobytes()) for r, x in zip(held, found, strict=True)])

        for batch in batches:
            for r in batch.to_pylist():
                if r["chunk"] is None:
                    if held:
                        yield flush()
                    held, size = [], 0
                    model = Subtrees(unpack(r["keys"], r["size"]), np.frombuffer(r["numbers"], np.int64))
                    continue
                held.append(r)
                size += r["size"]
                if size > 4_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    every = packed.unionByName(sums.select(*packed.columns))
    return stream(every.repartition("bucket").sortWithinPartitions("bucket", F.col("chunk").asc_nulls_first()), run, _PACKED)


def document_scores(texts: DataFrame, answered: DataFrame) -> DataFrame:
    """``doc_id, key, score`` from the answers to each text's chunk."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, packs, known = None, [], None
        for batch in batches:
            every, numbers = batch.column("text").to_pylist(), batch.column("chunk").to_pylist()
            kinds = [(c, t is None) for c, t in zip(numbers, every, strict=True)]
            cuts = [0, *(i for i in range(1, len(kinds)) if kinds[i] != kinds[i - 1]), len(kinds)]
            for u, v in zip(cuts, cuts[1:], strict=False):
                if u < v and numbers[u] != chunk:
                    chunk, packs, known = numbers[u], [], None
                if u < v and every[u] is None:
                    packs += [(unpack(r["keys"], r["size"]), np.frombuffer(r["numbers"], np.float32)) for r in batch.slice(u, v - u).select(["size", "keys", "numbers"]).to_pylist()]
                    continue
                if known is None:
                    table, values = (np.concatenate(x) for x in zip(*packs, strict=True))
                    packs = []
                    order = np.argsort(table)
                    known = table[order], values[order]
                for a, b in groups(every[u:v], BLOCK):
                    index, starts = keys_of([t.encode() for t in every[u + a : u + b]])
                    order = np.argsort(index)
                    each = np.empty(len(index))
                    each[order] = known[1][np.searchsorted(known[0], index[order])]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(u + a, b - a) for c in ("doc_id", "key")), pa.array(np.add.reduceat(each, starts))], schema=schema)

    # The answers to a chunk come before its texts.
    both = texts.unionByName(answered.select("chunk", "size", "keys", "numbers"), allowMissingColumns=True)
    return stream(both.repartition("chunk").sortWithinPartitions("chunk", F.col("text").isNotNull()), run, "doc_id long, key long, score double")


def tree_scores(keyed: DataFrame, is_learned: Column) -> DataFrame:
    """``doc_id, key, score`` for every row (``doc_id, key, text``) by the tree of those that are learned."""
    n_bytes = keyed.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    texts = keyed.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_bytes // CHUNK + 1)).cast("int"))
    packed = settled(chunk_keys(texts.select("chunk", is_learned.cast("int").alias("learned"), "text"), max(BUCKETS, n_bytes // SHARE)))
    sums = settled(bucket_sums(packed))
    count, below = np.zeros(1 << 19), np.zeros(1 << 19)
    for cells, n, places, logs in sums.select("cells", "counts", "places", "logs").toLocalIterator():
        count[np.frombuffer(cells, np.int64)] += np.frombuffer(n, np.int64)
        below[np.frombuffer(places, np.int64)] += np.frombuffer(logs, np.float64)
    return settled(document_scores(texts, answers(packed, sums, upper_levels(count, below))))


def score(docs: DataFrame, training: Column | None = None, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """Score every row by a model of the rows for which ``training`` (on ``doc_id``, ``text``) holds.

    ``doc_id, n_tokens, n_known, train_tokens, base_score, score, n_bytes,
    bits_per_byte``.
    """
    spark = docs.sparkSession
    rows = narrow(docs, id_col, text_col)
    is_learned = F.lit(True) if training is None else F.coalesce(training, F.lit(False))
    # The distinct words are wanted three times; they are written once where all executors see them.
    by_word = with_checkpoints(gather(rows.where(is_learned)))
    total, distinct = by_word.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    has_end = total > 0
    counts = by_word.where(F.col("word").isNotNull())
    often = F.col("n") * frequent >= total
    top = counts.where(often).toArrow()
    common = dict(zip((w.encode() for w in top["word"].to_pylist()), top["n"].to_pylist(), strict=True))
    keyed = rows.withColumn("key", F.xxhash64("text"))
    scores = tree_scores(keyed, is_learned)
    ends = by_word.where(F.col("word").isNull()).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    held_common = spark.sparkContext.broadcast(common)
    scale = total + distinct + 1
    end_score, end_known = math.log10((ends + 1) / scale), int(has_end and ends > 0)

    fields = [("word", pa.string()), ("n", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64()), ("known", pa.int64()), ("base", pa.float64())]
    schema = pa.schema(fields)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often_seen = held_common.value.get
        for batch in batches:
            ids, keys, every = (batch.column(c).to_pylist() for c in ("doc_id", "key", "text"))
            for a, b in groups(every, BLOCK):
                raw = [t.encode() for t in every[a:b]]
                out: list[list] = [[] for _ in fields]
                for doc_id, key, r in zip(ids[a:b], keys[a:b], raw, strict=True):
                    found = Counter(words(r))
                    known, base = end_known, end_score
                    for w, n in found.items():
                        c = often_seen(w)
                        if c is None:
                            for column, x in zip(out, (w.decode(), n, doc_id, key), strict=False):
                                column.append(x)
                        else:
                            known += n
                            base += n * math.log10((c + 1) / scale)
                    rare = len(out[0]) - len(out[4])
                    for column in out[4:]:
                        column += [None] * rare
                    # The row of the document itself; its word holds a space, so it meets no count.
                    for column, x in zip(out, (f" {doc_id} {key}", 0, doc_id, key, found.total() + 1, len(r), known, base), strict=True):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    parts = stream(keyed.drop("chunk"), work, "word string, n long, doc_id long, key long, n_tokens long, n_bytes long, known long, base double")
    rest = counts.where(~often).select("word", F.col("n").alias("c"))
    joined = parts.join(rest, "word", "left").unionByName(scores, allowMissingColumns=True).withColumn("own", F.col("n_tokens").isNotNull())
    base = F.when(~F.col("own"), F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(scale))))
    per_doc = joined.groupBy("doc_id", "key").agg(
        F.sum(F.col("own").cast("long")).alias("copies"),
        *(F.max(c).alias(c) for c in ("n_tokens", "n_bytes", "known", "base", "score")),
        F.coalesce(F.sum(F.when(~F.col("own") & F.col("c").isNotNull(), F.col("n"))), F.lit(0)).alias("more_known"),
        F.coalesce(F.sum(base), F.lit(0.0)).alias("more_base"),
    )
    # Rows that repeat identifier and text were summed together; each gets its own share back.
    single = per_doc.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return single.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + (F.col("more_known") / F.col("copies")).cast("long")).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("more_base") / F.col("copies")).alias("base_score"),
        "score",
        "n_bytes",
        F.when(F.col("n_bytes") > 0, -F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )
