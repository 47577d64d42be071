"""Digests that Spark has no built-in for.

CRC-64/NVME is linear: the checksum of a whole is the exclusive or of what its
pieces give, each moved over the bytes that follow it.  So pieces of any cut are
computed apart and put together by ``bit_xor``.  A move over a number of bytes is
a 64 x 64 matrix over GF(2), a product of those for powers of two, each looked up byte by byte.
The pieces of a whole batch are cut into lanes that advance side by side in numpy and are
joined in pairs by the same matrices.

BLAKE2b is sequential: a content is read in order, in pieces of bounded size.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache, reduce
from operator import xor

import numpy as np
import pyarrow as pa
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

#: The reflected polynomial of CRC-64/NVME.
_POLYNOMIAL = 0x9A6C9329AC4BC9B5
ONES = 0xFFFFFFFFFFFFFFFF
#: Bytes of a lane, and lanes that advance together at most.
LANE, LANES = 512, 8192


def _tables() -> np.ndarray:
    """What each byte gives after 1 to 8 bytes more."""
    first = np.arange(256, dtype=np.uint64)
    for _ in range(8):
        first = np.where(first & np.uint64(1), (first >> np.uint64(1)) ^ np.uint64(_POLYNOMIAL), first >> np.uint64(1))
    tables = [first]
    for _ in range(7):
        tables.append(first[tables[-1] & np.uint64(255)] ^ (tables[-1] >> np.uint64(8)))
    return np.array(tables)


_TABLES = _tables()
_BYTE = np.uint64(255)


def _times(columns: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A matrix (the image of each bit) times some vectors."""
    out = np.zeros_like(x)
    for bit in range(64):
        out ^= np.where(x >> np.uint64(bit) & np.uint64(1), columns[bit], np.uint64(0))
    return out


@lru_cache(maxsize=128)
def _power(k: int) -> np.ndarray:
    """The move over 2^k bytes: the images of the 64 bits."""
    if k == 0:
        bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
        return _TABLES[0][bits & _BYTE] ^ (bits >> np.uint64(8))
    half = _power(k - 1)
    return _times(half, half)


@lru_cache(maxsize=128)
def _images(k: int) -> np.ndarray:
    """The move over 2^k bytes: what each value of each of the eight bytes gives."""
    values, columns = np.arange(256, dtype=np.uint64), _power(k)
    out = np.zeros((8, 256), np.uint64)
    for bit in range(64):
        out[bit // 8] ^= np.where(values >> np.uint64(bit % 8) & np.uint64(1), columns[bit], np.uint64(0))
    return out


@lru_cache(maxsize=128)
def _plain(k: int) -> list[list[int]]:
    return _images(k).tolist()


def _looked_up(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The exclusive or of what the bytes of each number give, least significant byte first."""
    parts = np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)
    out = tables[0].take(parts[:, 0])
    for b in range(1, 8):
        out ^= tables[b].take(parts[:, b])
    return out


def moved(raw: np.ndarray | int, n: np.ndarray | int) -> np.ndarray | int:
    """Raw checksums moved over ``n`` more zero bytes, each over its own number if that is an array."""
    if isinstance(raw, int):
        for k in range(n.bit_length()):
            if n >> k & 1:
                raw = reduce(xor, (t[raw >> 8 * b & 255] for b, t in enumerate(_plain(k))))
        return raw
    n = np.broadcast_to(np.asarray(n, np.int64), raw.shape)
    for k in range(int(n.max(initial=0)).bit_length()):
        mine = n >> k & 1 == 1
        raw = _looked_up(_images(k), raw) if mine.all() else raw if not mine.any() else np.where(mine, _looked_up(_images(k), raw), raw)
    return raw


def _steps(words: np.ndarray) -> np.ndarray:
    """The raw checksum of each row of 64-bit words."""
    c = np.zeros(len(words), np.uint64)
    for column in np.ascontiguousarray(words.T):
        c = _looked_up(_TABLES[::-1], c ^ column)
    return c


def raws(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The checksums of many contents (stretches of bytes, in order) without first and last inversion.

    That of no bytes is 0, and leading zeros change nothing: so each content is
    cut into lanes from its end, and the first is filled up with zeros.  All lanes advance
    together, whatever content they belong to, and those of a content are joined in pairs.
    """
    counts = -(-(ends - starts) // LANE)
    after = np.cumsum(counts)
    own = np.repeat(np.arange(len(counts)), counts)
    left = ends[own] - (after[own] - np.arange(len(own))) * LANE  # where each lane begins; the first of a content possibly before it
    lanes = np.zeros(len(own), np.uint64)
    for at in range(0, len(own), LANES):
        begin, first = left[at : at + LANES], starts[own[at : at + LANES]]
        low, high = int(begin.min()), int(begin.max()) + LANE
        part = data[max(low, 0) : high]
        part = np.concatenate([np.zeros(-low, np.uint8), part]) if low < 0 else part
        block = np.lib.stride_tricks.sliding_window_view(part, LANE)[begin - low]
        short = np.flatnonzero(begin < first)
        block[short] *= np.arange(LANE) >= (first - begin)[short, None]
        lanes[at : at + LANES] = _steps(block.view("<u8"))
    each = LANE
    while counts.max(initial=0) > 1:
        halves = -(-counts // 2)
        own, to = np.repeat(np.arange(len(counts)), halves), np.cumsum(halves)
        right = after[own] - 1 - 2 * (to[own] - 1 - np.arange(len(own)))
        pairs = np.flatnonzero(right > (after - counts)[own])
        joined = lanes[right]
        joined[pairs] ^= moved(lanes[right[pairs] - 1], each)
        lanes, counts, after, each = joined, halves, to, each * 2
    out = np.zeros(len(counts), np.uint64)
    out[counts > 0] = lanes
    return out


def raw(data: bytes | memoryview) -> int:
    """The checksum of one content without its first and last inversion."""
    return int(raws(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]))[0])


def piece(data: bytes | memoryview, end: int, size: int) -> int:
    """What a piece that ends at ``end`` gives to the checksum of a content of ``size`` bytes: all pieces and :func:`frame`, by exclusive or."""
    return moved(raw(data), size - end)


def frame(size: int) -> int:
    """What the inversions give to the checksum of ``size`` bytes."""
    return moved(ONES, size) ^ ONES


def crc64nvme_value(data: bytes) -> int:
    return raw(data) ^ frame(len(data))


def encoded(value: int) -> str:
    """A checksum in base64, most significant byte first."""
    return base64.b64encode(value.to_bytes(8, "big")).decode()


def _stretches(content: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and where each value begins and the last ends."""
    content = content.cast(pa.large_binary())
    _, at, data = content.buffers()
    at = np.frombuffer(at, np.int64)[content.offset : content.offset + len(content) + 1] if len(content) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), at


@arrow_udf(StringType())
def blake2b_256(content: pa.Array) -> pa.Array:
    """64 lowercase hexadecimal characters; null stays null."""
    data, at = _stretches(content)
    data, at = memoryview(data), at.tolist()
    return pa.array([hashlib.blake2b(data[a:b], digest_size=32).hexdigest() if ok else None for a, b, ok in zip(at, at[1:], content.is_valid().to_pylist(), strict=False)], pa.string())


@arrow_udf(StringType())
def crc64nvme(content: pa.Array) -> pa.Array:
    """The checksum in base64; null stays null.  The values of a batch are computed together."""
    data, at = _stretches(content)
    sizes = np.diff(at)
    values = raws(data, at[:-1], at[1:]) ^ moved(np.full(len(sizes), ONES, np.uint64), sizes) ^ np.uint64(ONES)
    return pa.array([encoded(v) if ok else None for v, ok in zip(values.tolist(), content.is_valid().to_pylist(), strict=True)], pa.string())
