"""Policy tables: changes and validation.  They are small and edited by hand."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stocktake import schemas
from stocktake.functions import scalars
from stocktake.sources.store import SnapshotStore

# The fields of each kind of generating policy, and the output types that it may have.
SIZING = {
    "image:fit_to_box": ("image_width", "image_height"),
    "image:resize_shorter_side": ("shorter_side",),
    "video:mosaic": ("shorter_side", "tile_row_count", "tile_column_count"),
    "video:preview": ("shorter_side", "frame_count", "frame_delay_ms"),
}
ENCODING = {
    "image/jpeg": ("jpeg_quality",),
    "image/png": ("png_compression_level",),
    "image/webp": ("webp_quality", "webp_lossless"),
    "image/gif": ("gif_max_colors", "gif_dither"),
}
LEGAL = {
    "image:fit_to_box": ("image/jpeg", "image/png", "image/webp", "image/gif"),
    "image:resize_shorter_side": ("image/jpeg", "image/png", "image/webp", "image/gif"),
    "video:mosaic": ("image/jpeg", "image/png", "image/webp"),
    "video:preview": ("image/gif", "image/webp"),
}
#: Numbers between two bounds, and words of a list.
RANGES = {"image_width": (1, None), "image_height": (1, None), "shorter_side": (1, None), "tile_row_count": (1, None), "tile_column_count": (1, None), "frame_count": (1, None), "frame_delay_ms": (1, None), "jpeg_quality": (1, 100), "png_compression_level": (0, 9), "webp_quality": (1, 100), "gif_max_colors": (2, 256)}
DITHERS = ("none", "bayer", "heckbert", "floyd_steinberg", "sierra2", "sierra2_4a", "sierra3", "burkes", "atkinson")
FIELDS = tuple(dict.fromkeys(f for group in (*SIZING.values(), *ENCODING.values()) for f in group))


def next_priority(policies: DataFrame) -> DataFrame:
    """One row: the greatest priority plus one (none counts as 0), or 0 without policies."""
    return policies.agg(F.coalesce(F.max(F.coalesce("priority", F.lit(0))) + 1, F.lit(0)).cast("long").alias("priority"))


def listed(policies: DataFrame) -> DataFrame:
    """Storage policies with the default last, then by priority and id."""
    return policies.orderBy("is_default", F.col("priority").asc_nulls_first(), "id")


def listed_by_id(policies: DataFrame) -> DataFrame:
    """Ignore and thumbnail policies in the order in which they were made."""
    return policies.orderBy("id")


def create(policies: DataFrame, row: dict) -> DataFrame:
    new = policies.sparkSession.createDataFrame([row], policies.schema).drop("id")
    top = policies.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id"))
    return policies.unionByName(new.crossJoin(top).select(policies.columns))  # one row each


class Refused(ValueError):
    """A change that isn't made; ``problems`` are (id, problem)."""

    def __init__(self, problems: list[tuple]) -> None:
        super().__init__(f"policies are left as they are: {problems}")
        self.problems = problems


def _is_default(policies: DataFrame, policy_id: int) -> bool:
    return "is_default" in policies.columns and not policies.where((F.col("id") == policy_id) & F.col("is_default")).isEmpty()


def update(policies: DataFrame, policy_id: int, changes: dict) -> DataFrame:
    """One row changed; the glob and the priority of the default storage policy are fixed, and changing them is refused."""
    if {"glob", "priority"} & set(changes) and _is_default(policies, policy_id):
        raise Refused([(policy_id, "default_fixed")])
    hit = F.col("id") == policy_id
    return policies.select(*(F.when(hit, F.lit(changes[c]).cast(policies.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in policies.columns))


def remove(policies: DataFrame, policy_id: int) -> DataFrame:
    """All but one row; removing the default storage policy is refused."""
    if _is_default(policies, policy_id):
        raise Refused([(policy_id, "default_kept")])
    return policies.where(F.col("id") != policy_id)


def branch() -> Column:
    """``media:sizing`` of a generating policy."""
    return F.concat_ws(":", "media_type", F.when(F.col("media_type") == "image", F.col("resizing_strategy")).otherwise(F.col("output_type")))


def carry_over(old: DataFrame) -> DataFrame:
    """A policy after a change of its branch: only fields that are legal in it keep their value."""
    def legal(field: str) -> Column:
        sizing = [k for k, v in SIZING.items() if field in v]
        encoding = [k for k, v in ENCODING.items() if field in v]
        return (branch().isin(*sizing) if sizing else F.col("output_mime").isin(*encoding)) & (F.col("action") == "generate")

    return old.select(*(F.when(legal(c), F.col(c)).alias(c) if c in FIELDS else F.col(c) for c in old.columns))


def thumbnail_violations(policies: DataFrame) -> DataFrame:
    """``id, problem`` of policies for derived files that break a rule; no rows if all is well."""
    generates, skips = F.col("action") == "generate", F.col("action") == "skip"
    own = branch()
    has = {f: F.col(f).isNotNull() for f in FIELDS}
    known = own.isin(*SIZING)
    legal = reduce(lambda a, b: a | b, ((own == k) & F.col("output_mime").isin(*v) for k, v in LEGAL.items()))

    def needed(field: str) -> Column:
        return own.isin(*(k for k, v in SIZING.items() if field in v)) | F.coalesce(F.col("output_mime").isin(*(k for k, v in ENCODING.items() if field in v)), F.lit(False))

    missing = reduce(lambda a, b: a | b, (needed(f) & ~has[f] for f in FIELDS))
    extra = reduce(lambda a, b: a | b, (has[f] & ~needed(f) for f in FIELDS))
    any_field = reduce(lambda a, b: a | b, has.values())
    rules = {
        "action": ~(generates | skips) | F.col("action").isNull(),
        "name": F.col("name").isNull() | ~F.col("name").rlike(r"\A[A-Za-z0-9_]+\z"),
        "skip_fields": skips & (F.col("mime_types").isNotNull() | F.col("media_type").isNotNull() | F.col("output_mime").isNotNull() | any_field),
        "mime_types": generates & (F.col("mime_types").isNull() | (F.size("mime_types") == 0) | F.exists("mime_types", lambda m: ~m.rlike(r"\A[A-Za-z0-9.+-]+/(\*|[A-Za-z0-9.+-]+)\z"))),
        "media_type": generates & ~F.coalesce(F.forall("mime_types", lambda m: F.substring_index(m, "/", 1) == F.col("media_type")), F.lit(False)),
        "sizing": generates & ~F.coalesce(known, F.lit(False)),
        "output_mime": generates & F.coalesce(known, F.lit(False)) & ~F.coalesce(legal, F.lit(False)),
        "missing_fields": generates & F.coalesce(missing, F.lit(False)),
        "extra_fields": generates & F.coalesce(extra, F.lit(False)),
        "range": reduce(lambda a, b: a | b, (F.coalesce((F.col(f) < low) | (F.col(f) > high if high is not None else F.lit(False)), F.lit(False)) for f, (low, high) in RANGES.items())) | F.coalesce(~F.col("gif_dither").isin(*DITHERS), F.lit(False)),
        "glob": F.col("glob").isNull(),
    }
    checked = policies.select("id", F.explode(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items()))).alias("problem")).where(F.col("problem").isNotNull())
    twice = policies.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n > 1").select("id", F.lit("duplicate_name").alias("problem"))
    return checked.unionByName(twice)


def merged(policies: DataFrame, changes: DataFrame) -> DataFrame:
    """``policies`` after the updates of a change set.

    Of a policy for derived files the branch is settled first, from what is
    set and what the old row has for it; then a field is what is set, or the
    old value if the new branch has that field, or null.
    """
    told = changes.where("op = 'update'").select(F.col("id").alias("_id"), F.coalesce("set", F.array().cast("array<string>")).alias("_set"), F.struct(*(F.col(c) for c in policies.columns)).alias("_new"))
    rows = policies.join(told, F.col("id") == F.col("_id"), "left")
    given = {c: F.coalesce(F.array_contains("_set", c), F.lit(False)) for c in policies.columns}
    new = {c: F.when(given[c], F.col("_new")[c]) for c in policies.columns}
    kept = {c: F.coalesce(new[c], F.col(c)) for c in policies.columns}
    if "action" not in policies.columns:
        return rows.select(*((F.col(c) if c == "id" else kept[c]).alias(c) for c in policies.columns))
    action, was = kept["action"], F.col("action") == "generate"
    generates = action == "generate"
    out = {"id": F.col("id"), "created_at": F.col("created_at"), "action": action, "name": kept["name"], "glob": kept["glob"]}
    out["mime_types"] = F.when(action != "skip", F.coalesce(new["mime_types"], F.when(was, F.col("mime_types"))))
    out["media_type"] = F.when(generates, F.coalesce(new["media_type"], F.when(was, F.col("media_type"))))
    for field, media in (("resizing_strategy", "image"), ("output_type", "video")):
        out[field] = F.when(generates & (out["media_type"] == media), F.coalesce(new[field], F.when(F.col("media_type") == media, F.col(field))))
    out["output_mime"] = F.when(generates, F.coalesce(new["output_mime"], F.when(was, F.col("output_mime"))))
    own = F.when(out["media_type"] == "image", F.concat(F.lit("image:"), out["resizing_strategy"])).when(out["media_type"] == "video", F.concat(F.lit("video:"), out["output_type"]))
    for field in FIELDS:
        sizing, encoding = [k for k, v in SIZING.items() if field in v], [k for k, v in ENCODING.items() if field in v]
        legal = F.coalesce(own.isin(*sizing) if sizing else out["output_mime"].isin(*encoding), F.lit(False))
        out[field] = F.when(given[field], F.col("_new")[field]).when(legal, F.col(field))
    changed = F.col("_id").isNotNull()
    return rows.select(*(F.when(changed, out[c]).otherwise(F.col(c)).alias(c) for c in policies.columns))


def changed(policies: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table after a change set, and ``id, problem`` for all that speaks against it.

    A change is ``op`` (create, update, delete), ``id`` (null to create),
    ``set`` (the names of the fields that an update sets) and the columns of
    the policies.  The set is checked as a whole, after all of it is made.
    """
    alters = changes.where("op <> 'create'")
    none = F.lit(None).cast("long")
    problems = [
        changes.where(~F.col("op").isin("create", "update", "delete") | F.col("op").isNull()).select("id", F.lit("op").alias("problem")),
        alters.join(policies.select("id"), "id", "left_anti").select("id", F.lit("no_such_policy").alias("problem")),
        alters.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit("changed_twice").alias("problem")),
        alters.where("op = 'update'").select("id", F.explode("set").alias("f")).where(~F.col("f").isin(*(c for c in policies.columns if c not in ("id", "created_at", "is_default")))).select("id", F.lit("no_such_field").alias("problem")),
    ]
    made = changes.where("op = 'create'").select(*policies.columns)
    if "is_default" in policies.columns:
        default = policies.where("is_default").select("id")
        problems += [
            alters.where((F.col("op") == "update") & F.arrays_overlap("set", F.array(F.lit("glob"), F.lit("priority")))).join(default, "id", "left_semi").select("id", F.lit("default_fixed").alias("problem")),
            alters.where("op = 'delete'").join(default, "id", "left_semi").select("id", F.lit("default_kept").alias("problem")),
        ]
        made = made.withColumn("is_default", F.coalesce("is_default", F.lit(False)))
    # A change set is edited by hand: its new rows are numbered in one task.
    top = policies.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    numbered = made.withColumn("_nth", F.row_number().over(Window.orderBy(*(c for c in ("name", "glob") if c in policies.columns)))).crossJoin(top)  # one row
    made = numbered.withColumn("id", (F.col("_top") + F.col("_nth")).cast(policies.schema["id"].dataType)).select(policies.columns)
    after = merged(policies, changes).join(changes.where("op = 'delete'").select("id"), "id", "left_anti").select(policies.columns).unionByName(made)
    if "action" in policies.columns:
        problems.append(thumbnail_violations(after))
    elif "is_default" in policies.columns:
        problems.append(schemas.validate_storage_policies(after))
        problems.append(after.where(~F.col("target_class").isin(*scalars.COLDNESS)).select("id", F.lit("target_class").alias("problem")))
    else:
        problems.append(after.where(F.col("glob").isNull()).select("id", F.lit("glob").alias("problem")))
    return after, reduce(DataFrame.unionByName, (p.select(F.coalesce("id", none).alias("id"), "problem") for p in problems)).distinct()


def commit_changes(store: SnapshotStore, relation: str, changes: DataFrame) -> str:
    """A change set as one commit; if anything speaks against it all problems are raised, and nothing is written."""

    def change(now: dict[str, DataFrame]) -> dict[str, DataFrame]:
        after, problems = changed(now[relation], changes)
        if found := sorted((tuple(r) for r in problems.collect()), key=repr):
            raise Refused(found)
        return {relation: after}

    return store.mutate(change)


class PolicyTable:
    """One policy relation of a store; each change is a commit that is checked as a whole, or raises ``Refused``."""

    def __init__(self, store: SnapshotStore, relation: str) -> None:
        self.store, self.relation = store, relation

    def list(self) -> DataFrame:
        rows = self.store.read(self.relation)
        return listed(rows) if "is_default" in rows.columns else listed_by_id(rows)

    def _commit(self, op: str, policy_id: int | None, fields: dict) -> str:
        rows = self.store.read(self.relation)
        if unknown := set(fields) - set(rows.columns):
            raise Refused([(policy_id, f"no_such_field {name}") for name in sorted(unknown)])
        row = {"op": op, "set": sorted(fields), "id": policy_id} | fields
        ddl = "op string, set array<string>, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        return commit_changes(self.store, self.relation, rows.sparkSession.createDataFrame([row], ddl))

    def create(self, **fields: object) -> str:
        """A storage policy without a priority goes behind all others."""
        if self.relation == "storage_policies" and "priority" not in fields:
            fields["priority"] = next_priority(self.store.read(self.relation).where(~F.col("is_default"))).first()["priority"]
        return self._commit("create", None, fields)

    def edit(self, policy_id: int, **fields: object) -> str:
        return self._commit("update", policy_id, fields)

    def delete(self, policy_id: int) -> str:
        return self._commit("delete", policy_id, {})


def ignore_policies(store: SnapshotStore) -> PolicyTable:
    return PolicyTable(store, "ignore_policies")


def storage_policies(store: SnapshotStore) -> PolicyTable:
    return PolicyTable(store, "storage_policies")


def thumbnail_policies(store: SnapshotStore) -> PolicyTable:
    return PolicyTable(store, "thumbnail_policies")
