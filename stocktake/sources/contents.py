"""Digests of files of any size, in bounded memory.

Checksums are computed from ranges of bytes, which are dealt to tasks whatever file
they belong to, and put together by an aggregate.  BLAKE2b is read in order by one
task a file, piece by piece.  No content is ever a value of a column.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktake.functions import digests
from stocktake.sources.tree import _local

#: Bytes of a range, and bytes that are read at once.
RANGE, PIECE = 64 << 20, 4 << 20
#: Bytes of a file that is read as one text.
SMALL = 4096


def _opener(root: str, filesystem: Callable | None) -> Callable[[str], object]:
    """Opens a file under the root for reading, in a task."""
    local = None if filesystem else _local(root)
    if local is not None:
        return lambda path: open(f"{local}/{path}", "rb")
    from pyarrow import fs

    system, base = (filesystem(), root) if filesystem else fs.FileSystem.from_uri(root)
    base = base.split("://", 1)[-1].rstrip("/")
    return lambda path: system.open_input_file(f"{base}/{path}")


def _pieces(file, start: int, end: int) -> Iterator[tuple[bytes, int]]:
    """The bytes from start to end, and where each piece ends; a file that is shorter by now is an error."""
    file.seek(start)
    while start < end:
        data = file.read(min(PIECE, end - start))
        if not data:
            raise OSError("a file became shorter while it was read")
        start += len(data)
        yield data, start


def checksums(files: DataFrame, root: str, filesystem: Callable | None = None, size_of_range: int = RANGE) -> DataFrame:
    """``path, size, checksum`` (CRC-64/NVME in base64) of files (``path, size``; repeated rows count once) under a root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_file = _opener(root, filesystem)
        for batch in batches:
            out = []
            for path, size, start in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "start")), strict=True):
                # The first range brings what the inversions give, also of a file without bytes.
                value = digests.frame(size) if start == 0 else 0
                with open_file(path) as file:
                    for data, end in _pieces(file, start, min(size, start + size_of_range)):
                        value ^= digests.piece(data, end, size)
                out.append(value - (1 << 64) if value >> 63 else value)
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("size"), pa.array(out, pa.int64())], names=["path", "size", "value"])

    files = files.select("path", F.col("size").cast("long").alias("size")).distinct()
    ranges = files.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0).cast("long")), F.lit(size_of_range).cast("long"))))
    values = ranges.repartition("path", "start").mapInArrow(run, "path string, size long, value long")
    whole = values.groupBy("path", "size").agg(F.bit_xor("value").alias("value"))
    return whole.select("path", "size", F.base64(F.unhex(F.lpad(F.hex("value"), 16, "0"))).alias("checksum"))


def content_hashes(files: DataFrame, root: str, filesystem: Callable | None = None) -> DataFrame:
    """``path, size, hash`` (BLAKE2b-256 in hexadecimal) of files (``path, size``; repeated rows count once) under a root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_file = _opener(root, filesystem)
        for batch in batches:
            out = []
            for path, size in zip(batch.column("path").to_pylist(), batch.column("size").to_pylist(), strict=True):
                state = hashlib.blake2b(digest_size=32)
                with open_file(path) as file:
                    for data, _ in _pieces(file, 0, size):
                        state.update(data)
                out.append(state.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("size"), pa.array(out, pa.string())], names=["path", "size", "hash"])

    files = files.select("path", F.col("size").cast("long").alias("size")).distinct()
    return files.repartition("path").mapInArrow(run, "path string, size long, hash string")


def small_texts(files: DataFrame, root: str, filesystem: Callable | None = None) -> DataFrame:
    """``path, text`` of files of at most ``SMALL`` bytes of UTF-8; the text of others is null, and they aren't read further."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_file = _opener(root, filesystem)
        for batch in batches:
            out = []
            for path in batch.column("path").to_pylist():
                with open_file(path) as file:
                    data = file.read(SMALL + 1)
                try:
                    out.append(data.decode() if len(data) <= SMALL else None)
                except UnicodeDecodeError:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(out, pa.string())], names=["path", "text"])

    return files.select("path").distinct().repartition("path").mapInArrow(run, "path string, text string")
