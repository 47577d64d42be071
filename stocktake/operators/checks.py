"""Comparing several sources with each other: sanity checks, mirrors, and moving content in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocktake.functions import globs, scalars
from stocktake.operators.storage import archive_status

# What a sanity check can find.
PROBLEMS = ("both_stub_and_real", "hash_mismatch", "stub_mismatch", "missing_in_s3", "checksum_mismatch", "untracked", "missing_locally", "ignored")


def sanity_check(listing: DataFrame, entries: DataFrame, objects: DataFrame, heads: DataFrame, ignore: list[str] = (), scope: str | None = None) -> DataFrame:
    """``problem, path, hash``: a listing against entries against the store.

    ``listing`` has ``path, type, representation, hash, checksum``: of a real
    file the digest and checksum of what it holds, of a stub the digest that it
    names (null if malformed).  A path has one problem at most; ``ignored``
    rows are information.
    """
    if scope is not None:
        listing, entries = listing.where(globs.matches("path", scope)), entries.where(globs.matches("path", scope))
    f, e = listing.alias("f"), entries.alias("e")
    store = objects.join(heads.select("hash", F.lit(True).alias("there"), F.col("checksum").alias("remote")), "hash", "left").select("hash", "there", "remote", F.col("ciphertext_checksum").alias("recorded")).alias("o")
    rows = f.join(e, F.col("f.path") == F.col("e.path"), "full_outer").join(store, F.col("e.hash") == F.col("o.hash"), "left")
    path = F.coalesce("f.path", "e.path")
    wrong_content = ~F.coalesce(F.col("f.hash") == F.col("e.hash"), F.lit(False))
    stub = F.col("f.representation") == "stub"
    wrong_sum = ~F.coalesce(F.col("o.remote") == F.col("o.recorded"), F.lit(False)) | F.coalesce((F.col("f.checksum") != F.col("o.recorded")) & ~stub, F.lit(False))
    problem = (
        F.when(F.col("f.path").isNull(), "missing_locally")
        .when(F.col("e.path").isNull(), F.when(globs.matches_any(path, list(ignore)), "ignored").otherwise("untracked"))
        .when(F.col("e.type") == "dir", None)
        .when(F.col("f.representation") == "both", "both_stub_and_real")
        .when(stub & wrong_content, "stub_mismatch")
        .when(wrong_content, "hash_mismatch")
        .when(F.col("o.there").isNull(), "missing_in_s3")
        .when(wrong_sum, "checksum_mismatch")
    )
    return rows.select(problem.alias("problem"), path.alias("path"), F.col("e.hash").alias("hash")).where(F.col("problem").isNotNull())


def sanity_summary(problems: DataFrame) -> DataFrame:
    """One row: problems (without ignored paths) and each kind's count."""
    return problems.agg(F.count_if(F.col("problem") != "ignored").alias("problems"), *(F.count_if(F.col("problem") == p).alias(p) for p in PROBLEMS))


def mirror_verify(objects: DataFrame, mirror: DataFrame) -> DataFrame:
    """``hash, verdict``: ``ok``, ``missing``, ``wrong_size`` or ``checksum_mismatch`` of each object; ``mirror`` has ``hash, size, checksum``."""
    m = mirror.select("hash", F.col("size").alias("found"), F.col("checksum").alias("sum"))
    verdict = (
        F.when(F.col("found").isNull(), "missing")
        .when(F.col("found") != scalars.encrypted_size("size"), "wrong_size")
        .when(~F.col("sum").eqNullSafe(F.col("ciphertext_checksum")), "checksum_mismatch")
        .otherwise("ok")
    )
    return objects.join(m, "hash", "left").select("hash", verdict.alias("verdict"))


def mirror_extra(mirror: DataFrame, objects: DataFrame) -> DataFrame:
    """Mirror files that no object names."""
    return mirror.join(objects.select("hash"), "hash", "left_anti")


def local_sources(objects: DataFrame, entries: DataFrame, cache: DataFrame, listing: DataFrame) -> DataFrame:
    """``hash, source``: the first path that holds an object's content, unchanged, real and of its size."""
    usable = cache.where("state = 'unchanged'").select("path", "hash", "size").join(listing.where("representation <> 'stub'").select("path"), "path", "left_semi")
    paths = entries.where(F.col("hash").isNotNull()).select("path", "hash").join(usable, ["path", "hash"])
    return objects.select("hash", "size").join(paths, ["hash", "size"]).groupBy("hash").agg(F.min("path").alias("source"))


def mirror_catchup(objects: DataFrame, mirror: DataFrame, sources: DataFrame, heads: DataFrame, now: Column, allow_download: bool, request_retrieval: bool) -> DataFrame:
    """``hash, step, source``: how each object gets to the mirror.

    ``heads`` has a boolean ``intact``: whether the content matches its checksum.
    """
    m = mirror.select("hash", F.col("size").alias("found"))
    h = heads.select("hash", F.lit(True).alias("there"), archive_status(F.col("storage_class"), F.col("restore"), now).alias("status"), "intact")
    rows = objects.join(m, "hash", "left").join(sources, "hash", "left").join(h, "hash", "left")
    step = (
        F.when(F.col("found") == scalars.encrypted_size("size"), "already_present")
        .when(F.col("source").isNotNull(), "recovered")
        .when(~F.lit(allow_download) | F.col("there").isNull(), "unrecoverable")
        .when(F.col("status").isin("immediate", "restore-ready"), F.when(F.col("intact"), "downloaded").otherwise("unrecoverable"))
        .when(F.col("status") == "restore-ongoing", "restore_pending")
        .otherwise("restore_requested" if request_retrieval else "archived_not_requested")
    )
    return rows.select("hash", step.alias("step"), F.when(step == "recovered", F.col("source")).alias("source"))


def catchup_summary(steps: DataFrame) -> DataFrame:
    """One row of counts; the pointer moves unless something is unrecoverable."""
    kinds = ("already_present", "recovered", "downloaded", "restore_pending", "restore_requested", "archived_not_requested", "unrecoverable")
    return steps.agg(*(F.count_if(F.col("step") == k).alias(k) for k in kinds)).withColumn("pointer_moves", F.col("unrecoverable") == 0)


def materialize_plan(entries: DataFrame, listing: DataFrame, heads: DataFrame, now: Column, request_retrieval: bool = False, scope: str | None = None) -> DataFrame:
    """``path, step`` for each file of the cache (or of a snapshot's entries) in scope: what it takes to have its content in place."""
    entries = entries if scope is None else entries.where(globs.matches("path", scope))
    h = heads.select("hash", archive_status(F.col("storage_class"), F.col("restore"), now).alias("status"))
    files = entries.where("type = 'file'").select("path", "hash").join(listing.select("path", "representation"), "path", "left").join(h, "hash", "left")
    step = (
        F.when(F.coalesce(F.col("representation"), F.lit("real")) == "real", "already_real")
        .when(F.col("representation") == "both", "already_real")
        .when(F.col("status").isNull(), "missing")
        .when(F.col("status").isin("immediate", "restore-ready"), "materialize")
        .when(F.col("status") == "restore-ongoing", "restore_pending")
        .otherwise("restore_requested" if request_retrieval else "needs_restore")
    )
    return files.select("path", step.alias("step"))


def stubify_plan(cache: DataFrame, listing: DataFrame, mirrored: DataFrame | None = None) -> DataFrame:
    """``path, step`` for each file: whether its content may be replaced by a stub.

    ``listing`` has the ``hash`` of the content; without ``mirrored`` (``hash,
    size`` of the files on a mirror) files need no copy there.  A copy counts
    only in the size that the encrypted content must have; an entry without a
    size is not mirrored.
    """
    rows = cache.where("type = 'file'").alias("c").join(listing.where("representation <> 'stub'").alias("f"), F.col("c.path") == F.col("f.path"), "left")
    safe = F.lit(True)
    if mirrored is not None:
        copies = mirrored.select(F.col("hash").alias("_copy"), F.col("size").alias("_copy_size")).distinct()
        rows = rows.join(copies, (F.col("c.hash") == F.col("_copy")) & (scalars.encrypted_size("c.size") == F.col("_copy_size")), "left")
        safe = F.col("_copy").isNotNull()
    same_time = F.coalesce(scalars.half_up(F.col("f.mtime_ms")) == F.col("c.mtime"), F.lit(False))
    same_content = F.coalesce(F.col("f.hash") == F.col("c.hash"), F.lit(False))
    step = (
        F.when(scalars.under_thumbnails("c.path"), "thumbnail_excluded")
        .when(F.col("f.path").isNull(), "already_stub")
        .when(F.col("c.state") != "unchanged", "skip_pending_changes")
        .when(~safe, "skip_not_mirrored")
        .when(same_time | same_content, "stubify")
        .otherwise("skip_changed")
    )
    return rows.select(F.col("c.path").alias("path"), step.alias("step"))


def work_estimate(plan: DataFrame, sizes: DataFrame, step: str) -> DataFrame:
    """``files, bytes`` of one step of a plan; ``sizes`` has ``path, size``."""
    return plan.where(F.col("step") == step).join(sizes.select("path", "size"), "path", "left").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def step_summary(plan: DataFrame) -> DataFrame:
    return plan.groupBy("step").agg(F.count(F.lit(1)).alias("files"))


def verify_summary(verdicts: DataFrame, extra: DataFrame) -> DataFrame:
    """One row of counts; files that no object names don't count against ``ok``."""
    kinds = ("missing", "wrong_size", "checksum_mismatch")
    damaged = verdicts.agg(*(F.count_if(F.col("verdict") == k).alias(k) for k in kinds))
    found = damaged.crossJoin(extra.agg(F.count(F.lit(1)).alias("extra")))  # one row each
    return found.withColumn("ok", F.col("missing") + F.col("wrong_size") + F.col("checksum_mismatch") == 0)


def temporary_summary(listing: DataFrame) -> DataFrame:
    """Stale unfinished files and their bytes; the quick check is ``ok`` without any."""
    from stocktake.sources.listing import temporary

    return temporary(listing).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).withColumn("ok", F.col("files") == 0)


def sanity_estimate(listing: DataFrame, entries: DataFrame, scope: str | None = None) -> DataFrame:
    """One row: ``paths`` on either side, and the ``bytes`` that a sanity check has to read: those of real files that are tracked and in scope."""
    f, e = listing.alias("f"), entries.alias("e")
    both = f.join(e, F.col("f.path") == F.col("e.path"), "full_outer")
    read = (F.col("e.type") != "dir") & (F.col("f.representation") == "real")
    if scope is not None:
        read = read & globs.matches(F.col("e.path"), scope)
    return both.agg(F.count(F.lit(1)).alias("paths"), F.coalesce(F.sum(F.when(read, F.col("f.size"))), F.lit(0)).alias("bytes"))
