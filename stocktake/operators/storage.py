"""Storage classes: which one a path and a content should have, and what that takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocktake.functions import globindex, globs, scalars
from stocktake.operators.inventory import distinct_hashes

# The outcomes.
STATUSES = ("immediate", "needs-restore-request", "restore-ongoing", "restore-ready", "restore-expired-needs-reissue")
ACTIONS = ("already-correct", "immediate-copy", "needs-restore-request", "restore-ongoing", "finalize-copy")

#: Of more policies than these, path classes are joined instead of folded.
FOLDED = 64


def by_priority(policies: DataFrame) -> DataFrame:
    """Policies that aren't the default, in their order."""
    return policies.where(~F.col("is_default")).orderBy(F.col("priority").asc_nulls_first(), "id")


def path_class(policies: list[tuple[str, str]], default: str, path: Column | str = "path") -> Column:
    """The class of the first matching policy (glob, class), folded into one expression."""
    out = F.lit(default)
    for glob, target in reversed(policies):
        out = F.when(globs.matches(path, glob), F.lit(target)).otherwise(out)
    return out


def path_class_joined(paths: DataFrame, policies: DataFrame) -> DataFrame:
    """The same for policies in a table (``id, glob, target_class, priority, is_default``): ``path, target_class``.

    Globs meet paths by what is literal in them, an equi-join.
    """
    rules = policies.where(~F.col("is_default")).select("id", "glob", "target_class", F.struct(F.coalesce("priority", F.lit(-(2**62))), F.col("id")).alias("order"))
    hits = globindex.match(paths, rules).join(rules.drop("glob"), "id").groupBy("path").agg(F.min_by("target_class", "order").alias("hit"))
    default = policies.where("is_default").select(F.col("target_class").alias("fallback"))
    return paths.join(hits, "path", "left").crossJoin(F.broadcast(default)).select("path", F.coalesce("hit", "fallback").alias("target_class"))  # one row


def load(policies: DataFrame) -> tuple[list[tuple[str, str]], str]:
    """A policy table on the driver, whole: (glob, class) in order, and the default class."""
    default = policies.where("is_default").select("target_class").collect()
    if len(default) != 1:
        raise ValueError(f"{len(default)} default storage policies")
    return [(r["glob"], r["target_class"]) for r in by_priority(policies).collect()], default[0][0]


def hash_class(entries: DataFrame, policies: list[tuple[str, str]], default: str, scope: str | None = None) -> DataFrame:
    """``hash, target_class, conflicted, n_paths``: the warmest class of all paths of each content in scope.

    The scope selects contents; their paths outside of it count too.
    """
    files = entries.where(F.col("hash").isNotNull())
    if scope is not None:
        files = files.join(distinct_hashes(files, scope), "hash", "left_semi")
    if len(policies) > FOLDED:
        rules = [(i, glob, target, False) for i, (glob, target) in enumerate(policies)] + [(len(policies), None, default, True)]
        table = entries.sparkSession.createDataFrame(rules, "id long, glob string, target_class string, is_default boolean").withColumn("priority", F.col("id"))
        files = files.join(path_class_joined(files.select("path").distinct(), table), "path")
    target = F.col("target_class") if len(policies) > FOLDED else path_class(policies, default)
    cold = files.select("hash", scalars.coldness(target).alias("cold"))
    warmest = cold.groupBy("hash").agg(F.min("cold").alias("cold"), (F.min("cold") != F.max("cold")).alias("conflicted"), F.count(F.lit(1)).alias("n_paths"))
    return warmest.select("hash", scalars.class_of("cold").alias("target_class"), "conflicted", "n_paths")


def archive_status(storage_class: Column, restore: Column, now: Column) -> Column:
    """Whether archived content can be read; no class is STANDARD."""
    cold = F.coalesce(storage_class, F.lit("STANDARD")).isin("GLACIER", "DEEP_ARCHIVE")
    return (
        F.when(~cold, "immediate")
        .when(restore.isNull(), "needs-restore-request")
        .when(scalars.restore_ongoing(restore), "restore-ongoing")
        .when(scalars.restore_expiry(restore) > now, "restore-ready")
        .otherwise("restore-expired-needs-reissue")
    )


def storage_action(current: Column, target: Column, status: Column) -> Column:
    now, want = scalars.coldness(F.coalesce(current, F.lit("STANDARD"))), scalars.coldness(target)
    return (
        F.when(now == want, "already-correct")
        .when(want > now, "immediate-copy")
        .when(status == "immediate", "already-correct")
        .when(status.isin("needs-restore-request", "restore-expired-needs-reissue"), "needs-restore-request")
        .when(status == "restore-ongoing", "restore-ongoing")
        .otherwise("finalize-copy")
    )


def storage_plan(entries: DataFrame, objects: DataFrame, heads: DataFrame, policies: list[tuple[str, str]], default: str, now: Column, scope: str | None = None) -> DataFrame:
    """``hash, size, target_class, conflicted, current_class, status, action`` of each content in scope that the store has; ``missing`` where it hasn't."""
    want = hash_class(entries, policies, default, scope).join(objects.select("hash", "size"), "hash", "left")
    rows = want.join(heads.select("hash", F.lit(True).alias("there"), "storage_class", "restore"), "hash", "left")
    current = F.when(F.col("there"), F.coalesce("storage_class", F.lit("STANDARD")))
    status = F.when(F.col("there"), archive_status(F.col("storage_class"), F.col("restore"), now)).otherwise("missing")
    action = F.when(F.col("there"), storage_action(F.col("storage_class"), F.col("target_class"), status)).otherwise("missing")
    return rows.select("hash", "size", "target_class", "conflicted", current.alias("current_class"), status.alias("status"), action.alias("action"))


def storage_summary(plan: DataFrame) -> DataFrame:
    return plan.groupBy("action").agg(F.count(F.lit(1)).alias("objects"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count_if("conflicted").alias("conflicted"))


def unknown_objects(entries: DataFrame, objects: DataFrame) -> DataFrame:
    """Contents that entries name and the object table lacks: there must be none."""
    return distinct_hashes(entries).join(objects.select("hash"), "hash", "left_anti")
