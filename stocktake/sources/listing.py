"""Inventories of files in place, hidden names and all (see :mod:`stocktake.sources.tree`)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocktake.functions import scalars
from stocktake.sources import contents, tree
from stocktake.sources.tree import TEMPORARY


def files(spark: SparkSession, root: str, content: bool = False, filesystem: Callable | None = None) -> DataFrame:
    """``path, type, mtime_ms, size`` of all files under a folder; with ``hash, checksum`` if their content is to be read."""
    rows = tree.walk(spark, root, filesystem=filesystem).where("type = 'file'")
    if not content:
        return rows
    hashes, sums = (f(rows, root, filesystem) for f in (contents.content_hashes, contents.checksums))
    return rows.join(hashes.select("path", "hash"), "path").join(sums.select("path", "checksum"), "path")


def temporary(listing: DataFrame) -> DataFrame:
    return listing.where(F.col("path").rlike(TEMPORARY))


def settled(listing: DataFrame, exclude: str | None = None) -> DataFrame:
    """Without unfinished files and without a folder at the root."""
    rows = listing.where(~F.col("path").rlike(TEMPORARY))
    return rows.where(~F.col("path").startswith(exclude + "/") & (F.col("path") != exclude)) if exclude else rows


def stubs(spark: SparkSession, root: str, filesystem: Callable | None = None) -> DataFrame:
    """``path, algorithm, hash`` of the one-line stub files under a folder; both null if malformed, the digest alone if it is none."""
    found = tree.walk(spark, root, filesystem=filesystem).where((F.col("type") == "file") & F.col("path").endswith(tree.STUB))
    lines = contents.small_texts(found, root, filesystem).select("path", F.trim(F.regexp_replace("text", r"\s+\z", "")).alias("line"))
    tag = scalars.parse_tagged_hash("line")
    return lines.select("path", tag["algorithm"].alias("algorithm"), F.when(scalars.is_valid_hash(tag["digest"]), tag["digest"]).alias("hash"))


def mirror_objects(listing: DataFrame) -> DataFrame:
    """``hash, size`` of mirror files that are named by a digest."""
    return listing.select(scalars.basename("path").alias("hash"), "size").where(scalars.is_valid_hash("hash"))


def is_empty(df: DataFrame) -> bool:
    return df.limit(1).isEmpty()


def write_lines(df: DataFrame, path: str) -> None:
    """Results as newline-delimited JSON."""
    df.write.json(path)
