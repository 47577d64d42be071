"""Deciding local changes against a shared snapshot, and applying remote ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stocktake.functions import globs, scalars
from stocktake.operators.inventory import differs, numbered


def decision(state: Column, local_hash: Column, parent: Column, known: Column, entry_hash: Column, entry_version: Column) -> Column:
    """``apply``, ``noop`` or ``conflict``; ``error`` for a row without a change."""
    same = ~differs(local_hash, entry_hash)
    current = F.coalesce(entry_version == parent, F.lit(False))
    return (
        F.when(state == "created", F.when(~known, "apply").when(same, "noop").otherwise("conflict"))
        .when(state == "modified", F.when(~known, "conflict").when(current, "apply").when(same, "noop").otherwise("conflict"))
        .when(state == "deleted", F.when(~known, "noop").when(current, "apply").otherwise("conflict"))
        .otherwise("error")
    )


def decide(dirty: DataFrame, entries: DataFrame) -> DataFrame:
    """``path, state, type, hash, size, decision, entry_version`` of each dirty row on its own."""
    c, e = dirty.alias("c"), entries.alias("e")
    what = decision(F.col("c.state"), F.col("c.hash"), F.col("c.parent_state_version"), F.col("e.path").isNotNull(), F.col("e.hash"), F.col("e.state_version"))
    return c.join(e, F.col("c.path") == F.col("e.path"), "left").select("c.path", "c.state", "c.type", "c.hash", "c.size", what.alias("decision"), F.col("e.state_version").alias("entry_version"))


def plan_sync(dirty: DataFrame, entries: DataFrame, objects: DataFrame, commit: str) -> DataFrame:
    """The whole batch: ``path, state, type, hash, size, decision, reason, upload, stamp``.

    Deletions come first.  A created row whose lowered path another live entry
    or an earlier created file of the batch has is a conflict, before the
    matrix is asked.  Of the applied files with new content the first by path
    uploads it, the others attach; known content is a duplicate.
    """
    c, e = dirty.alias("c"), entries.alias("e")
    known = F.col("e.path").isNotNull()
    what = decision(F.col("c.state"), F.col("c.hash"), F.col("c.parent_state_version"), known, F.col("e.hash"), F.col("e.state_version"))
    both = c.join(e, F.col("c.path") == F.col("e.path"), "full_outer").select(F.coalesce("c.path", "e.path").alias("path"), "c.state", "c.type", "c.hash", "c.size", F.when(F.col("c.path").isNotNull(), what).alias("decision"), F.col("e.state_version").alias("entry_version"), known.alias("entry"))
    gone = F.coalesce((F.col("state") == "deleted") & (F.col("decision") == "apply"), F.lit(False))
    live = F.when(F.col("entry") & ~gone, F.col("path"))
    # Directories become visible at once, and so do files of known content; both may stand in the way of later rows.
    able = F.when((F.col("state") == "created") & (F.col("decision") == "apply"), F.col("path"))
    # The variants of one path, few rows each.
    variants = Window.partitionBy(scalars.collision_key("path"))
    rows = both.withColumns({"least": F.min(live).over(variants), "most": F.max(live).over(variants), "claimed": F.min(able).over(variants)}).where(F.col("state").isNotNull())
    taken = (F.col("least") != F.col("path")) | (F.col("most") != F.col("path"))
    # Whatever is able has no live variant, unless that stands in the way of all of them.
    beaten = F.col("least").isNull() & (F.col("path") > F.col("claimed"))
    collides = F.coalesce((F.col("state") == "created") & (taken | beaten), F.lit(False))
    decided = rows.withColumn("reason", F.when(collides, "case_collision").when(F.col("decision") == "conflict", "content")).withColumn("decision", F.when(collides, "conflict").otherwise(F.col("decision")))
    sends = (F.col("decision") == "apply") & (F.col("state") != "deleted") & (F.col("type") == "file")
    # One row for each content, so that the rows of a frequent one are joined once.
    contents = decided.where(sends).groupBy("hash").agg(F.min("path").alias("owner")).join(objects.select("hash", F.lit(True).alias("known")), "hash", "left")
    plan = decided.join(contents, "hash", "left")
    upload = F.when(sends, F.when(F.col("known"), "dedup").when(F.col("path") == F.col("owner"), "upload").otherwise("attach"))
    stamp = F.when(F.col("state") == "deleted", None).when(F.col("decision") == "apply", F.lit(commit)).when(F.col("decision") == "noop", F.col("entry_version"))
    return plan.select("path", "state", "type", "hash", "size", "decision", "reason", upload.alias("upload"), stamp.alias("stamp"))


def sync_summary(plan: DataFrame) -> DataFrame:
    """One row of counters, and the exit status: 2 with conflicts, else 0."""
    n = {"applied": F.col("decision") == "apply", "noops": F.col("decision") == "noop", "conflicts": F.col("decision") == "conflict", "uploaded": F.col("upload") == "upload", "deduped": F.col("upload").isin("dedup", "attach")}
    return plan.agg(*(F.count_if(c).alias(k) for k, c in n.items())).withColumn("status_code", F.when(F.col("conflicts") > 0, 2).otherwise(0).cast("long"))


def upload_estimate(dirty: DataFrame, objects: DataFrame) -> DataFrame:
    """``files`` (all dirty rows) and ``bytes`` (the first claim of each unknown content)."""
    claims = dirty.where(F.col("hash").isNotNull() & (F.col("state") != "deleted")).groupBy("hash").agg(F.min_by("size", "path").alias("size"))
    fresh = claims.join(objects.select("hash"), "hash", "left_anti").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    return dirty.agg(F.count(F.lit(1)).alias("files")).crossJoin(fresh)  # one row each


def apply_sync(entries: DataFrame, plan: DataFrame) -> DataFrame:
    """The entries after the applied changes."""
    done = plan.where("decision = 'apply'").select("path", "state", "type", "hash", F.col("stamp").alias("state_version"), scalars.collision_key("path").alias("normalized_path"))
    e, d = entries.alias("e"), done.alias("d")
    both = e.join(d, F.col("e.path") == F.col("d.path"), "full_outer").where(~F.coalesce(F.col("d.state") == "deleted", F.lit(False)))
    put = F.col("d.path").isNotNull()
    return both.select(*(F.when(put, F.col(f"d.{k}") if k in done.columns else F.lit(None)).otherwise(F.col(f"e.{k}")).alias(k) for k in entries.columns))


def reconcile(cache: DataFrame, plan: DataFrame) -> DataFrame:
    """The inventory after a commit: handled deletions are gone, other handled rows unchanged at their stamp."""
    handled = plan.where("decision in ('apply', 'noop')").select("path", "stamp", F.lit(True).alias("handled"))
    rows = cache.join(handled, "path", "left").where(~(F.coalesce("handled", F.lit(False)) & (F.col("state") == "deleted")))
    rows = rows.withColumn("parent_state_version", F.when(F.col("handled"), F.col("stamp")).otherwise(F.col("parent_state_version")))
    return rows.withColumn("state", F.when(F.col("handled"), "unchanged").otherwise(F.col("state"))).drop("stamp", "handled")


def unstamped(plan: DataFrame) -> DataFrame:
    """Handled live rows without a version: there must be none."""
    return plan.where("decision in ('apply', 'noop') and state <> 'deleted' and stamp is null")


def remote_delta(cache: DataFrame, candidate: DataFrame, excluded: DataFrame) -> DataFrame:
    """``path, change, hash, state_version``: what a snapshot changes locally, but for excluded paths."""
    c, e = cache.alias("c"), candidate.alias("e")
    both = c.join(e, F.col("c.path") == F.col("e.path"), "full_outer").withColumn("_path", F.coalesce("c.path", "e.path"))
    change = F.when(F.col("c.path").isNull(), "created").when(F.col("e.path").isNull(), "deleted").when(differs(F.col("c.hash"), F.col("e.hash")), "modified")
    rows = both.select(F.col("_path").alias("path"), change.alias("change"), F.col("e.hash").alias("hash"), F.col("e.state_version").alias("state_version"))
    return rows.where(F.col("change").isNotNull()).join(excluded.select("path"), "path", "left_anti")


def ancestors(path: Column | str) -> Column:
    """All folders above a path, the nearest last."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))


def remote_apply_plan(delta: DataFrame, cache: DataFrame, candidate: DataFrame, stubs: DataFrame) -> DataFrame:
    """``step, path, change, type, action, hash, state_version``: how each remote change is written, in order of ``step`` and then of any order.

    A new file is written as a stub; a changed one too if it is nothing but a
    stub now (its path is in ``stubs``), else it is downloaded.  Folders are made before
    what is in them, parents first, those included that neither side has a row
    for.  Deletions come deepest first, and a folder is removed only if
    nothing that stays, of what is excluded from the delta too, is below it;
    else it is kept.
    """
    kinds = cache.select("path", F.col("type").alias("own_type"))
    rows = delta.join(kinds, "path", "left").join(candidate.select("path", F.col("type").alias("new_type")), "path", "left").join(stubs.select("path").distinct().withColumn("is_stub", F.lit(True)), "path", "left")
    kind = F.when(F.col("change") == "deleted", F.col("own_type")).otherwise(F.col("new_type"))
    rows = rows.select("path", "change", kind.alias("type"), "hash", "state_version", F.coalesce("is_stub", F.lit(False)).alias("is_stub"))
    deleted = rows.where("change = 'deleted'").select("path")
    stays = cache.select("path").join(deleted, "path", "left_anti").unionByName(rows.where("change <> 'deleted'").select("path"))
    full = stays.select(F.explode(ancestors("path")).alias("path")).distinct().withColumn("full", F.lit(True))
    written = rows.where("change <> 'deleted'")
    folders = written.select(F.explode(ancestors("path")).alias("path")).distinct()
    implied = folders.join(cache.where("type = 'dir'").select("path"), "path", "left_anti").join(candidate.where("type = 'dir'").select("path"), "path", "left_anti")
    none = F.lit(None).cast("string")
    made = implied.select("path", F.lit("implied").alias("change"), F.lit("dir").alias("type"), none.alias("hash"), none.alias("state_version"), F.lit(False).alias("is_stub"))
    every = rows.unionByName(made).join(full, "path", "left")
    gone, is_dir = F.col("change") == "deleted", F.col("type") == "dir"
    action = (
        F.when(gone & is_dir, F.when(F.col("full"), "keep_dir").otherwise("remove_dir"))
        .when(gone, "remove")
        .when(is_dir, "make_dir")
        .when((F.col("change") == "created") | F.col("is_stub"), "write_stub")
        .otherwise("download")
    )
    depth = F.size(F.split("path", "/"))
    # Removals by falling depth (below zero), then folders by rising depth, then files.
    step = F.when(gone, -depth).when(is_dir, depth).otherwise(F.lit(2**31 - 1))
    return every.select(step.cast("long").alias("step"), "path", "change", "type", action.alias("action"), "hash", "state_version")


def ignored_but_synced(delta: DataFrame, ignore: list[str]) -> DataFrame:
    """Created paths that an ignore policy names, with the first such glob."""
    return delta.where("change = 'created'").select("path", globs.first_match("path", ignore).alias("glob")).where(F.col("glob").isNotNull())


def claims(rows: DataFrame) -> DataFrame:
    """The place of each row among those of its content, by path: 1 is the one that uploads."""
    return numbered(rows, ["hash"], "path", "claim")


def remote_summary(delta: DataFrame) -> DataFrame:
    """One row: remote changes of each kind."""
    return delta.agg(*(F.count_if(F.col("change") == k).alias(k) for k in ("created", "modified", "deleted")))


def nothing_to_sync(dirty: DataFrame, delta: DataFrame) -> bool:
    return dirty.isEmpty() and delta.isEmpty()
