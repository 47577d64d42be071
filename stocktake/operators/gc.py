"""Contents that no entry names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphans(objects: DataFrame, entries: DataFrame) -> DataFrame:
    """Objects without an entry; past deletions don't hold them."""
    return objects.join(entries.where(F.col("hash").isNotNull()).select("hash"), "hash", "left_anti")


def orphan_summary(objects: DataFrame, entries: DataFrame) -> DataFrame:
    return orphans(objects, entries).agg(F.count(F.lit(1)).alias("objects"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def collect_garbage(objects: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The objects that stay, and those to delete from the store once the snapshot without them is committed."""
    gone = orphans(objects, entries)
    return objects.join(gone.select("hash"), "hash", "left_anti"), gone
