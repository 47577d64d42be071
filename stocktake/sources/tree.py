"""Directory trees as tables, listed in rounds.

The directories of one level are a table whose rows are dealt to tasks; each task
lists its directories, and what it finds there that is a directory is the next
level.  The driver only learns whether there is a next level.  A directory is listed by one
task, row by row; its names never form a list anywhere.

Unlike Spark's file source this sees hidden names and gives rows for
directories.  Local paths (or shared mounts, which all executors must have) are
listed by the system; other addresses by Arrow's file systems (``s3://``,
``gs://``, ``hdfs://``), for which ``filesystem`` may give a function that
makes one, with its credentials, in each task.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocktake.sources.lineage import cut

# The ending of a stub's name, and the names of unfinished files.
STUB = ".stub"
TEMPORARY = r"(?:\A|/)\.[a-z0-9]+-tmp-[0-9a-f]{32}(?:\.[^./]+)?\z"

#: Directories that a task lists, about, and rows of a batch that it gives out.
PER_TASK, BATCH = 64, 5_000
_ROW = pa.schema([("path", pa.string()), ("type", pa.string()), ("mtime_ms", pa.float64()), ("size", pa.int64())])
_DDL = "path string, type string, mtime_ms double, size long"


def _local(root: str) -> str | None:
    """The path of a local root, or None."""
    if root.startswith("file:"):
        return "/" + root.removeprefix("file:").lstrip("/")
    return root if "://" not in root else None


def _scan(root: str, folder: str) -> Iterator[tuple[str, str, float, int]]:
    """One local directory; links count as what they lead to, but are not followed into directories.  What vanishes meanwhile is left out."""
    try:
        found = os.scandir(os.path.join(root, folder) if folder else root)
    except FileNotFoundError:
        if not folder:
            raise
        return
    with found:
        for entry in found:
            try:
                stat = entry.stat()
            except FileNotFoundError:
                continue
            path = f"{folder}/{entry.name}" if folder else entry.name
            yield path, "dir" if entry.is_dir(follow_symlinks=False) else "file", stat.st_mtime_ns / 1e6, stat.st_size


def _select(root: str, make: Callable | None) -> Callable[[str], Iterator[tuple[str, str, float, int]]]:
    """The same through Arrow's file systems."""
    from pyarrow import fs

    system, base = (make(), root) if make else fs.FileSystem.from_uri(root)
    base = base.split("://", 1)[-1].rstrip("/")

    def of(folder: str) -> Iterator[tuple[str, str, float, int]]:
        for info in system.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"), allow_not_found=bool(folder))):
            time = info.mtime_ns / 1e6 if info.mtime_ns is not None else None
            yield info.path[len(base) :].lstrip("/"), "dir" if info.type == fs.FileType.Directory else "file", time, info.size or 0

    return of


def walk(spark: SparkSession, root: str, exclude: Iterable[str] = (), filesystem: Callable | None = None) -> DataFrame:
    """``path, type, mtime_ms, size`` of everything under ``root``, as it is there; names in ``exclude`` are left out at the root."""
    left_out, local = list(exclude), None if filesystem else _local(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = (lambda folder: _scan(local, folder)) if local is not None else _select(root, filesystem)
        held: list[tuple] = []
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                for row in of(folder):
                    if folder or row[0] not in left_out:
                        held.append(row)
                    if len(held) == BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ROW, strict=True)], schema=_ROW)
                        held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ROW, strict=True)], schema=_ROW)

    level = spark.createDataFrame([("",)], "path string")
    out, tasks = None, 1
    while True:
        # Dealt by a hash, so that a task that runs again lists the same directories.
        found = cut(level.repartition(tasks, "path").mapInArrow(run, _DDL))
        out = found if out is None else out.unionByName(found)
        level = found.where("type = 'dir'").select("path")
        n = level.count()
        if not n:
            return out
        tasks = n // PER_TASK + 1


def temporary(rows: DataFrame) -> DataFrame:
    """Unfinished files, at any depth."""
    return rows.where((F.col("type") != "dir") & F.col("path").rlike(TEMPORARY))


def fold(rows: DataFrame) -> DataFrame:
    """``path, type, representation, mtime_ms, size``: a file and its stub are one row, unfinished files none.

    Time and size are the real file's if there is one.  Directories are always
    real, whatever their names.  Repeated rows count once.
    """
    is_dir = F.col("type") == "dir"
    rows = rows.where(is_dir | ~F.col("path").rlike(TEMPORARY))
    is_stub = ~is_dir & F.col("path").endswith(STUB)
    logical = F.when(is_stub, F.expr(f"left(path, length(path) - {len(STUB)})")).otherwise(F.col("path"))
    best = F.struct(is_dir.alias("dir"), (~is_stub).alias("real"), F.col("mtime_ms").alias("mtime_ms"), F.col("size").alias("size"))
    one = rows.select(logical.alias("path"), is_stub.alias("stub"), best.alias("best")).groupBy("path").agg(F.max("best").alias("best"), F.bool_or("stub").alias("stub"))
    kind = F.when(F.col("best.dir") | ~F.col("stub"), "real").when(F.col("best.real"), "both").otherwise("stub")
    return one.select("path", F.when(F.col("best.dir"), "dir").otherwise("file").alias("type"), kind.alias("representation"), "best.mtime_ms", "best.size")


def listing(spark: SparkSession, root: str, exclude: Iterable[str] = (), filesystem: Callable | None = None) -> DataFrame:
    """The folded tree in the order of full paths, bytewise."""
    return fold(walk(spark, root, exclude, filesystem)).orderBy("path")
