"""Looking up, scanning, comparing and changing inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stocktake.functions import globs, scalars
from stocktake.sources.lineage import cut

#: Sampled paths for each range of numbered deletions.
PER_RANGE = 16


def lookup(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is among ``keys`` (a column of the same name)."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def paths_by_hash(entries: DataFrame) -> DataFrame:
    """``hash, n_paths, first_path, last_path`` for each content; the paths themselves stay one a row in ``entries``."""
    return entries.where(F.col("hash").isNotNull()).groupBy("hash").agg(F.count(F.lit(1)).alias("n_paths"), F.min("path").alias("first_path"), F.max("path").alias("last_path"))


def glob_scan(df: DataFrame, pattern: str | None) -> DataFrame:
    """Rows whose path matches; None is everything."""
    return df if pattern is None else df.where(globs.matches("path", pattern))


def page(df: DataFrame, key: str, n: int, after: str | None = None, inclusive: bool = False) -> DataFrame:
    """The next ``n`` rows by key."""
    if after is not None:
        df = df.where(F.col(key) >= after if inclusive else F.col(key) > after)
    return df.orderBy(key).limit(n)


def distinct_hashes(entries: DataFrame, pattern: str | None = None) -> DataFrame:
    return glob_scan(entries, pattern).where(F.col("hash").isNotNull()).select("hash").distinct()


def dirty(cache: DataFrame) -> DataFrame:
    """Rows with local changes and their order: deletions first, each by path."""
    return cache.where(F.col("state") != "unchanged").withColumn("phase", F.when(F.col("state") == "deleted", 0).otherwise(1)).orderBy("phase", "path")


def diff(cache: DataFrame, pattern: str | None = None) -> DataFrame:
    return dirty(glob_scan(cache, pattern))


def tally(cache: DataFrame) -> DataFrame:
    """One row: rows in each changed state."""
    return cache.agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("created", "modified", "deleted")))


def latest_version(versions: DataFrame) -> DataFrame:
    return versions.orderBy(F.desc("sequence")).limit(1)


def insert_version(versions: DataFrame, stamp: str, created_at: str) -> DataFrame:
    """``versions`` and one more, numbered one above the greatest; the first is 1."""
    new = versions.agg((F.coalesce(F.max("sequence"), F.lit(0)) + 1).cast("long").alias("sequence"))
    return versions.unionByName(new.select("sequence", F.lit(stamp).alias("version_stamp"), F.lit(created_at).alias("created_at")))


def versions_with_stamp(versions: DataFrame, stamps: DataFrame) -> DataFrame:
    return lookup(versions, stamps, "version_stamp")


def deletion_history(deletions: DataFrame, paths: DataFrame) -> DataFrame:
    """The deletions of some paths with their order, oldest first."""
    order = Window.partitionBy("path").orderBy("id")
    return lookup(deletions, paths, "path").withColumn("nth", F.row_number().over(order).cast("long"))


def collision_partner(live: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted path the smallest other live path of the same lowered form: ``path, other``."""
    a = wanted.select("path", scalars.collision_key("path").alias("key"))
    b = live.select(F.col("path").alias("other"), scalars.collision_key("path").alias("key"))
    return a.join(b, "key").where("path <> other").groupBy("path").agg(F.min("other").alias("other"))


def upsert(base: DataFrame, delta: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """``base`` with the rows of ``delta`` added or in place of theirs; of rows of one key the last in ``order`` counts, a column of ``delta`` alone."""
    if order is not None:
        last = F.max_by(F.struct(*base.columns), order).alias("_last")
        delta = delta.groupBy(key).agg(last).select("_last.*")
    return base.join(delta.select(key), key, "left_anti").unionByName(delta)


def delete(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return base.join(keys.select(key), key, "left_anti")


def numbered(rows: DataFrame, by: list[str], order: str, name: str) -> DataFrame:
    """``rows`` with their place (from 1) in each group ``by`` in the order of a text column; without groups, in all.

    Rows are dealt to ranges of ``order``, between edges from a fixed sample
    (those of the smallest hashes), so that every attempt has the same ranges
    and a group of any size is numbered by many tasks.  A number is the place
    within the range after all rows of the group in earlier ranges.  ``rows``
    is read three times; ties are numbered in any order.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sample = rows.select(order).orderBy(F.xxhash64(order), order).limit(ranges * PER_RANGE)
    edges = sample.agg(F.filter(F.sort_array(F.collect_list(order)), lambda p, i: i % PER_RANGE == PER_RANGE - 1).alias("_edges"))
    ranged = rows.crossJoin(F.broadcast(edges)).withColumn("_range", F.size(F.filter("_edges", lambda e: e < F.col(order)))).drop("_edges")  # one row
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range at most
    before = ranged.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_rows")).select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_range").alias("_at"), F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    same = F.col("_range") == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    place = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(order)) + F.col("_before")
    return ranged.join(before, same).select(*rows.columns, place.cast("long").alias(name))


def delete_with_history(entries: DataFrame, paths: DataFrame, version: str, created_at: str, next_id: int = 1) -> tuple[DataFrame, DataFrame]:
    """The entries that are left, and a history row for each that is gone, numbered by path."""
    gone = numbered(cut(lookup(entries, paths, "path")), [], "path", "_nth")
    history = gone.select((F.col("_nth") + (next_id - 1)).alias("id"), "path", "type", "hash", F.col("state_version").alias("introduced_in_version"), F.lit(version).alias("deleted_in_version"), F.lit(created_at).alias("created_at"))
    return delete(entries, paths, "path"), history


def inspect(cache: DataFrame, entries: DataFrame, versions: DataFrame, objects: DataFrame, target: str) -> DataFrame:
    """Both sides of each path that a pattern matches, with its version and object; a plain path always gives a row."""
    if globs.is_glob(target):
        paths = glob_scan(cache, target).select("path").union(glob_scan(entries, target).select("path")).distinct()
    else:
        paths = cache.sparkSession.createDataFrame([(target,)], "path string")
    mine = cache.select("path", F.struct("state", "hash", "parent_state_version").alias("local"))
    theirs = entries.select("path", "hash", "state_version").join(versions.select(F.col("version_stamp").alias("state_version"), "sequence"), "state_version", "left")
    theirs = theirs.join(objects.select("hash", "size"), "hash", "left").select("path", F.struct("hash", "state_version", "sequence", "size").alias("remote"))
    return paths.join(mine, "path", "left").join(theirs, "path", "left")


def differs(a: Column, b: Column) -> Column:
    """Inequality in which null equals null."""
    return ~a.eqNullSafe(b)
