"""Column functions on paths, keys, sizes, headers and dimensions."""

from __future__ import annotations

import random
import secrets
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sizes in bytes and limits.
MIB = 1024 * 1024
CHUNK = 4 * MIB
TAG = 16
MIN_PART, MAX_PARTS = 5 * MIB, 10_000
COPY_PART = 512 * MIB
# Storage classes from warm to cold.
COLDNESS = {"STANDARD": 0, "GLACIER": 1, "DEEP_ARCHIVE": 2}
# The file extension of each output type.
EXTENSIONS = {"image/jpeg": "jpg", "image/png": "png", "image/webp": "webp", "image/gif": "gif"}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def collision_key(path: Column | str) -> Column:
    return F.lower(_c(path))


def object_key(digest: Column | str) -> Column:
    h = _c(digest)
    return F.concat(F.lit("objects/"), F.substring(h, 1, 2), F.lit("/"), F.substring(h, 3, 2), F.lit("/"), h)


def normalize_prefix(prefix: Column | str) -> Column:
    return F.regexp_replace(_c(prefix), "^/+|/+$", "")


def remote_key(prefix: Column | str, key: Column | str) -> Column:
    """Key under a prefix; an empty prefix adds nothing."""
    p = normalize_prefix(prefix)
    return F.when(p == "", _c(key)).otherwise(F.concat_ws("/", p, _c(key)))


def snapshot_key(stamp: Column | str) -> Column:
    return F.concat(F.lit("states/"), _c(stamp), F.lit(".db"))


def version_stamp(now: datetime | None = None) -> str:
    """``YYYYMMDDTHHMMSSmmmZ-xxxxxxxx``, made on the driver."""
    now = (now or datetime.now(timezone.utc)).astimezone(timezone.utc)
    return f"{now:%Y%m%dT%H%M%S}{now.microsecond // 1000:03d}Z-{secrets.token_hex(4)}"


def chunk_count(size: Column | str, chunk: int = CHUNK) -> Column:
    return F.ceil(_c(size) / chunk)


def chunk_ranges(size: Column | str, context: int = 32, chunk: int = CHUNK, start: Column | int = 0, length: Column | int | None = None) -> Column:
    """The chunks that hold some bytes of a content, by default all: ``(chunk, start, end, plain_start, plain_length)``.

    ``start`` and ``end`` (exclusive) bound a chunk with its tag in the encrypted object, whose last
    one is short; ``plain_*`` are the wanted bytes within the chunk.  Bytes beyond the end count for nothing.
    """
    n = _c(size)
    first = F.lit(start).cast("long") if isinstance(start, int) else start.cast("long")
    end = F.least(n, first + (F.lit(length).cast("long") if isinstance(length, int) else length.cast("long"))) if length is not None else n
    kind = "array<struct<chunk: bigint, start: bigint, end: bigint, plain_start: bigint, plain_length: bigint>>"

    def one(k: Column) -> Column:
        at = F.lit(18 + context) + k * (chunk + TAG)
        own = F.least(F.lit(chunk).cast("long"), n - k * chunk)
        low, high = F.greatest(first - k * chunk, F.lit(0).cast("long")), F.least(end - k * chunk, own)
        return F.struct(k.alias("chunk"), at.alias("start"), (at + own + TAG).alias("end"), low.alias("plain_start"), (high - low).alias("plain_length"))

    chunks = F.sequence(F.floor(first / chunk), F.floor((end - 1) / chunk))
    return F.when((end > first) & (first >= 0), F.transform(chunks, one).cast(kind)).otherwise(F.array().cast(kind))


def encrypted_size(size: Column | str, context: int = 32, chunk: int = CHUNK) -> Column:
    """Header of 18 bytes and the context, the bytes themselves, and a tag for each chunk."""
    return (F.lit(18 + context) + _c(size) + chunk_count(size, chunk) * TAG).cast("long")


def multipart_part_size(size: Column | str) -> Column:
    return F.greatest(F.lit(MIN_PART).cast("long"), F.ceil(_c(size) / MAX_PARTS))


def copy_part_size(size: Column | str) -> Column:
    return F.greatest(F.lit(COPY_PART).cast("long"), F.ceil(_c(size) / MAX_PARTS))


def byte_ranges(size: Column | str, part: Column | int) -> Column:
    """Array of ``(part_number, start, end)``, the end inclusive; empty for no bytes."""
    n, part = _c(size), F.lit(part) if isinstance(part, int) else part
    starts = F.sequence(F.lit(0).cast("long"), n - 1, part.cast("long"))
    ranges = F.transform(starts, lambda s, i: F.struct((i + 1).cast("long").alias("part_number"), s.alias("start"), (F.least(s + part, n) - 1).alias("end")))
    return F.when(n > 0, ranges).otherwise(F.array().cast("array<struct<part_number: bigint, start: bigint, end: bigint>>"))


def is_valid_hash(digest: Column | str) -> Column:
    return _c(digest).rlike(r"\A[0-9a-f]{64}\z")


def tagged_hash(digest: Column | str, algorithm: str = "blake2b") -> Column:
    return F.concat(F.lit(algorithm + ":"), _c(digest))


def parse_tagged_hash(text: Column | str) -> Column:
    """``(algorithm, digest)``, split at the first colon; null without one."""
    t = _c(text)
    at = F.instr(t, ":")
    return F.when(at > 0, F.struct(F.substring(t, F.lit(1), at - 1).alias("algorithm"), F.substring(t, at + 1, F.length(t)).alias("digest")))


def stub_path(path: Column | str) -> Column:
    return F.concat(_c(path), F.lit(".stub"))


def basename(path: Column | str) -> Column:
    return F.substring_index(_c(path), "/", -1)


def dirname(path: Column | str) -> Column:
    """Empty at the root."""
    return F.regexp_replace(_c(path), "(?:^|/)[^/]*$", "")


def fits_with_stub_suffix(path: Column | str) -> Column:
    return F.octet_length(basename(path)) + 5 <= 255


def coldness(storage_class: Column | str) -> Column:
    """0 to 2; null for classes that aren't supported."""
    c, out = _c(storage_class), F.lit(None).cast("int")
    for name, k in COLDNESS.items():
        out = F.when(c == name, F.lit(k)).otherwise(out)
    return out


def class_of(cold: Column | str) -> Column:
    out = F.lit(None).cast("string")
    for name, k in COLDNESS.items():
        out = F.when(_c(cold) == k, F.lit(name)).otherwise(out)
    return out


def restore_ongoing(header: Column | str) -> Column:
    return F.regexp_extract(_c(header), 'ongoing-request="([a-z]+)"', 1) == "true"


def restore_expiry(header: Column | str) -> Column:
    """The expiry as a timestamp (the session's time zone is UTC), null without one; the weekday isn't read."""
    date = F.regexp_extract(_c(header), 'expiry-date="([^"]+)"', 1)
    return F.try_to_timestamp(F.substring(date, 6, 20), F.lit("dd MMM yyyy HH:mm:ss"))


def half_up(x: Column) -> Column:
    """Rounding with halves upwards, also for negative numbers."""
    return F.floor(x + 0.5)


def contain_fit(width: Column, height: Column, box_width: Column, box_height: Column) -> Column:
    """``(width, height)`` within a box that turns with the source; a source over twice as long as the box overflows it."""
    turn = (width >= height) != (box_width >= box_height)
    w, h = F.when(turn, box_height).otherwise(box_width), F.when(turn, box_width).otherwise(box_height)
    short, long = F.least(width, height), F.greatest(width, height)
    extreme = long / short > 2 * (F.greatest(w, h) / F.least(w, h))
    scale = F.when(extreme, F.least(w, h) / short).otherwise(F.least(w / width, h / height))
    return F.struct(F.greatest(F.lit(1), half_up(width * scale)).cast("long").alias("width"), F.greatest(F.lit(1), half_up(height * scale)).cast("long").alias("height"))


def shorter_side_fit(width: Column, height: Column, side: Column | int) -> Column:
    scale = (F.lit(side) if isinstance(side, int) else side) / F.least(width, height)
    return F.struct(F.greatest(F.lit(1), half_up(width * scale)).cast("long").alias("width"), F.greatest(F.lit(1), half_up(height * scale)).cast("long").alias("height"))


def jpeg_scale(quality: Column | str) -> Column:
    """1 to 100 as a scale from 31 (worst) to 2 (best)."""
    return F.least(F.lit(31), F.greatest(F.lit(2), half_up(2 + (100 - _c(quality)) * 29 / 100))).cast("long")


def sample_times(duration: Column | str, n: int) -> Column:
    """Array of the middles of ``n`` equal parts."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: _c(duration) * (i + 0.5) / n)


def tile_offsets(count: int, columns: int, width: Column | int, height: Column | int) -> Column:
    """Array of ``(x, y)`` of tiles laid out row by row."""
    w, h = (F.lit(x) if isinstance(x, int) else x for x in (width, height))
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.struct((i % columns * w).alias("x"), (F.floor(i / columns) * h).alias("y")))


def rotation_swaps(degrees: Column | str) -> Column:
    return F.pmod(_c(degrees), F.lit(360)).isin(90, 270)


def mime_matches(pattern: Column, mime: Column) -> Column:
    """Equal, or ``type/*`` of the same type."""
    kind = F.substring_index(pattern, "/", 1)
    return (pattern == mime) | ((pattern == F.concat(kind, F.lit("/*"))) & (kind == F.substring_index(mime, "/", 1)))


def under_thumbnails(path: Column | str) -> Column:
    return F.array_contains(F.split(_c(path), "/"), "_thumbnail")


def params_value(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), "[^0-9A-Za-z_]", "_")


def backoff_ms(attempt: int, jitter: float | None = None) -> float:
    """Doubling from 500 ms up to 30 s, half of it random."""
    full = min(30_000, 500 * 2 ** (attempt - 1))
    return full * (0.5 + 0.5 * (random.random() if jitter is None else jitter))
