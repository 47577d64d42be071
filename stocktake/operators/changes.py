"""Scanning: a file listing against the local inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocktake.functions import globs, scalars
from stocktake.operators.inventory import differs
from stocktake.sources.lineage import cut


def fold_listing(files: DataFrame) -> DataFrame:
    """One row a logical path from physical files (``path, type, mtime_ms, size``): a file and its ``.stub`` are one, ``real``, ``stub`` or ``both``."""
    is_stub = (F.col("type") == "file") & F.col("path").endswith(".stub")
    rows = files.withColumn("is_stub", is_stub).withColumn("path", F.when(is_stub, F.regexp_replace("path", r"\.stub$", "")).otherwise(F.col("path")))
    best = F.struct(~F.col("is_stub"), F.col("mtime_ms"), F.col("size"))
    folded = rows.groupBy("path").agg(F.max("type").alias("type"), F.bool_or("is_stub").alias("stub"), F.bool_or(~F.col("is_stub")).alias("real"), F.max_by("mtime_ms", best).alias("mtime_ms"), F.max_by("size", best).alias("size"))
    kind = F.when(F.col("stub") & F.col("real"), "both").when(F.col("stub"), "stub").otherwise("real")
    return folded.select("path", "type", kind.alias("representation"), "mtime_ms", "size")


def needs_hash(fs: str = "fs", cache: str = "c") -> Column:
    """Whether a listed file has to be read: real content, unless the inventory has the same time for it."""
    real = (F.col(f"{fs}.type") == "file") & (F.col(f"{fs}.representation") != "stub")
    same = F.col(f"{cache}.mtime") == scalars.half_up(F.col(f"{fs}.mtime_ms"))
    return real & ~(F.coalesce(same, F.lit(False)) & (F.col(f"{fs}.representation") != "both"))


def scan_changes(listing: DataFrame, cache: DataFrame, last_version: str, ignore: list[str] = ()) -> DataFrame:
    """Classify each path of a listing (with the ``hash`` of its content) against the inventory.

    ``path, outcome, state, type, hash, size, mtime, parent_state_version``.
    ``outcome`` counts the path; ``state`` is what the inventory holds
    afterwards, null if the path isn't in it.  An unchanged time settles a path
    before its content is looked at, so that a pending change counts as
    unchanged and keeps its state.
    """
    f, c = listing.alias("f"), cache.alias("c")
    both = f.join(c, F.col("f.path") == F.col("c.path"), "full_outer")
    path = F.coalesce("f.path", "c.path")
    on_disk, known = F.col("f.path").isNotNull(), F.col("c.path").isNotNull()
    ignored = globs.matches_any(path, list(ignore))
    mtime = scalars.half_up(F.col("f.mtime_ms")).cast("long")
    is_dir = F.col("f.type") == "dir"
    state = F.col("c.state")
    same_time = F.coalesce(mtime == F.col("c.mtime"), F.lit(False)) & (F.col("f.representation") != "both")
    same_content = ~differs(F.col("f.hash"), F.col("c.hash"))
    outcome = (
        F.when(on_disk & ~known & ignored, "ignored")
        .when(on_disk & ~known, "created")
        .when(~on_disk & (state == "deleted"), "gone")
        .when(~on_disk, "deleted")
        .when((state == "created") & ignored, "dropped")
        .when(is_dir & (state == "deleted"), "created")
        .when(is_dir | same_time | same_content, "unchanged")
        .when(state == "unchanged", "modified")
        .when(state == "deleted", "created")
        .otherwise(state)
    )
    rows = both.withColumn("_path", path).withColumn("outcome", outcome)
    o = F.col("outcome")
    fresh = o.isin("created", "modified")
    keep = o.isin("unchanged", "gone")
    after = F.when(o.isin("ignored", "dropped"), None).when(keep, state).otherwise(o)
    updated = (o == "unchanged") & ~F.coalesce(is_dir | same_time, F.lit(False))
    parent = F.when(known, F.col("c.parent_state_version")).otherwise(F.lit(last_version))
    in_cache = after.isNotNull()

    def pick(new: Column, old: Column) -> Column:
        return F.when(in_cache & (fresh | updated), new).when(in_cache & keep, old)

    return rows.select(
        F.col("_path").alias("path"), "outcome", after.alias("state"), F.when(in_cache, F.coalesce("f.type", "c.type")).alias("type"),
        pick(F.col("f.hash"), F.col("c.hash")).alias("hash"), pick(F.col("f.size"), F.col("c.size")).alias("size"), pick(mtime, F.col("c.mtime")).alias("mtime"), F.when(in_cache, parent).alias("parent_state_version"),
    )


def scan_summary(changes: DataFrame) -> DataFrame:
    """One row of counts."""
    return changes.agg(*(F.count_if(F.col("outcome") == s).alias(s) for s in ("created", "modified", "deleted", "unchanged", "ignored", "dropped")))


def collision_groups(rows: DataFrame) -> DataFrame:
    """``normalized_path, paths`` of lowered paths that more than one live row has."""
    live = rows.where("state <> 'deleted'") if "state" in rows.columns else rows
    return live.groupBy(scalars.collision_key("path").alias("normalized_path")).agg(F.count(F.lit(1)).alias("paths")).where("paths > 1")


def staged_collisions(staged: DataFrame, durable: DataFrame) -> DataFrame:
    """``path, other, source``: staged rows that may not be applied.

    Of a group within the batch every row is excluded; against the durable
    inventory only the staged one is, and not where that path is deleted in
    the same batch.
    """
    live = staged.where("state <> 'deleted'").withColumn("key", scalars.collision_key("path")).select("path", "key")
    groups = live.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first"), F.max("path").alias("last")).where("n > 1")
    # The smallest other path: the first one, but for the first itself the next.
    others = live.join(groups.select("key"), "key", "left_semi")
    second = others.join(groups.select("key", "first"), "key").where("path <> first").groupBy("key").agg(F.min("path").alias("second"))
    within = others.join(groups.select("key", "first"), "key").join(second, "key").select("path", F.when(F.col("path") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("other"), F.lit("batch").alias("source"))
    kept = durable.where("state <> 'deleted'").join(staged.where("state = 'deleted'").select("path"), "path", "left_anti").select(F.col("path").alias("other"), scalars.collision_key("path").alias("key"))
    against = live.join(groups.select("key"), "key", "left_anti").join(kept, "key").where("path <> other").groupBy("path").agg(F.min("other").alias("other")).withColumn("source", F.lit("durable"))
    return within.unionByName(against)


def applicable(staged: DataFrame, collisions: DataFrame) -> DataFrame:
    return staged.join(collisions.select("path"), "path", "left_anti")


def scan_estimate(listing: DataFrame, cache: DataFrame) -> DataFrame:
    """One row: paths on either side, and the files and bytes that have to be read."""
    f = listing.alias("fs").join(cache.alias("c"), F.col("fs.path") == F.col("c.path"), "full_outer")
    read = F.coalesce(needs_hash(), F.lit(False))
    return f.agg(F.count(F.lit(1)).alias("paths"), F.count_if(read).alias("files"), F.coalesce(F.sum(F.when(read, F.col("fs.size"))), F.lit(0)).alias("bytes"))


def apply_scan(listing: DataFrame, cache: DataFrame, last_version: str, ignore: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The inventory after a scan, and the collisions (``path, other, source``) whose rows stay as they were: one call for scan, collision test and update."""
    scanned = cut(scan_changes(listing, cache, last_version, ignore))
    staged = scanned.where(F.col("outcome").isin("created", "modified", "deleted"))
    collisions = cut(staged_collisions(staged.select("path", "state"), cache))
    held = cache.join(collisions.select("path"), "path", "left_semi")
    fresh = applicable(scanned.where(F.col("state").isNotNull()), collisions).withColumn("normalized_path", scalars.collision_key("path"))
    columns = [c for c in cache.columns if c in fresh.columns]
    return held.select(columns).unionByName(fresh.select(columns)), collisions


def scan_status(changes: DataFrame, collisions: DataFrame) -> DataFrame:
    """One row: the counters of a scan, its collisions, and the exit status, 1 if there are any."""
    return scan_summary(changes).crossJoin(collisions.agg(F.count(F.lit(1)).alias("collisions"))).withColumn("status_code", F.when(F.col("collisions") > 0, 1).otherwise(0).cast("long"))  # one row each
