"""Derived files (previews): their names, the policies that ask for them, and what is to be made or removed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stocktake.functions import globindex, globs, scalars
from stocktake.sources.lineage import cut

# The shape of the parameters in a derived file's name.
PARAMS = r"\Ap[12]-[A-Za-z0-9_]+(?:-[a-z]+[0-9A-Za-z_]+)+\z"


def parse_names(files: DataFrame) -> DataFrame:
    """``path, original_path, params, policy, hash, ext`` of files named as derived ones: ``<dir>/_thumbnail/<name>.<params>.<hash>.<ext>``."""
    folder = scalars.dirname("path")
    parts = F.split(scalars.basename("path"), r"\.")
    n = F.size("parts")
    rows = files.select("path", folder.alias("folder"), parts.alias("parts")).where((scalars.basename("folder") == "_thumbnail") & (n >= 4))
    name = F.array_join(F.slice("parts", F.lit(1), n - 3), ".")
    above = scalars.dirname("folder")
    original = F.when(above == "", name).otherwise(F.concat_ws("/", above, name))
    rows = rows.select("path", original.alias("original_path"), name.alias("name"), F.element_at("parts", -3).alias("params"), F.element_at("parts", -2).alias("hash"), F.element_at("parts", -1).alias("ext"))
    return rows.where(F.col("params").rlike(PARAMS) & (F.col("name") != "")).select("path", "original_path", "params", F.split("params", "-")[1].alias("policy"), "hash", "ext")


def params_segment() -> Column:
    """The parameters of a generating policy (its columns), version two."""
    def token(prefix: str, field: str) -> Column:
        return F.concat(F.lit(prefix), F.col(field).cast("string"))

    sizing = (
        F.when(F.col("media_type") == "image", F.when(F.col("resizing_strategy") == "fit_to_box", F.array(token("iw", "image_width"), token("ih", "image_height"))).otherwise(F.array(token("ss", "shorter_side"))))
        .when(F.col("output_type") == "mosaic", F.array(token("ss", "shorter_side"), token("tr", "tile_row_count"), token("tc", "tile_column_count")))
        .otherwise(F.array(token("ss", "shorter_side"), token("fc", "frame_count"), token("fd", "frame_delay_ms")))
    )
    encoding = (
        F.when(F.col("output_mime") == "image/jpeg", F.array(token("q", "jpeg_quality")))
        .when(F.col("output_mime") == "image/png", F.array(token("pl", "png_compression_level")))
        .when(F.col("output_mime") == "image/webp", F.array(token("wq", "webp_quality"), F.concat(F.lit("wl"), F.when(F.col("webp_lossless"), "1").otherwise("0"))))
        .otherwise(F.array(token("mc", "gif_max_colors"), F.concat(F.lit("dt"), scalars.params_value("gif_dither"))))
    )
    kind = F.concat(F.lit("fmt"), scalars.params_value("output_mime"))
    return F.array_join(F.concat(F.array(F.lit("p2"), F.col("name")), sizing, F.array(kind), encoding), "-")


def extension(mime: Column | str) -> Column:
    m, out = F.col(mime) if isinstance(mime, str) else mime, F.lit(None).cast("string")
    for name, ext in scalars.EXTENSIONS.items():
        out = F.when(m == name, ext).otherwise(out)
    return out


def derived_path(original: Column | str, params: Column, digest: Column, ext: Column) -> Column:
    folder = scalars.dirname(original)
    at = F.when(folder == "", "_thumbnail").otherwise(F.concat(folder, F.lit("/_thumbnail")))
    return F.concat(at, F.lit("/"), scalars.basename(original), F.lit("."), params, F.lit("."), digest, F.lit("."), ext)


def skipped(sources: DataFrame, policies: DataFrame) -> DataFrame:
    """Sources that a skip policy matches, from their paths alone: they are never probed."""
    return sources.join(globindex.match(sources, policies.where("action = 'skip'"), "name").select("path").distinct(), "path", "left_semi")


def generating(policies: DataFrame) -> DataFrame:
    """``policy, mime_types, params, ext`` of the generating policies."""
    return policies.where("action = 'generate'").select(F.col("name").alias("policy"), "mime_types", params_segment().alias("params"), extension("output_mime").alias("ext"))


def resolve(sources: DataFrame, policies: DataFrame) -> DataFrame:
    """Every generating policy that a probed source (``path, mime_type``) matches: ``path, policy, params, ext``.

    A source that any skip policy matches has none, so that ``reconcile``
    makes nothing for it and deletes what there is.  Globs are joined by what
    is literal in them, all policies at once.
    """
    hits = globindex.match(sources, policies, "name").join(policies.select(F.col("name").alias("id"), (F.col("action") == "skip").alias("skip")), "id")
    wanted = hits.groupBy("path").agg(F.bool_or("skip").alias("skip"), F.collect_set("id").alias("ids")).where("not skip")  # a path has as many as there are policies at most
    rules = wanted.select("path", F.explode("ids").alias("policy")).join(generating(policies), "policy")
    return sources.join(rules, "path").where(F.exists("mime_types", lambda m: scalars.mime_matches(m, F.col("mime_type")))).select("path", "policy", "params", "ext")


def reconcile(sources: DataFrame, resolved: DataFrame, derived: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """``original_path, policy, path, step`` for readable real sources (``path, hash, readable``) and those that are ``skipped``.

    Per policy the first exact file by path is up to date; without one the
    first other is regenerated; without any a new one is generated.  All other
    derived files of these sources are deleted.  Unreadable sources keep what
    they have; sources without a hash are reported.  Skipped sources (``path``)
    needn't be readable and lose all derived files.  Three narrow tables are
    kept in the folder that ``spark.checkpoint.dir`` names.
    """
    have = cut(derived.select("original_path", "policy", "path", F.col("params").alias("has_params"), F.col("hash").alias("has_hash"), F.col("ext").alias("has_ext")))
    known = sources.where("readable").select(F.col("path").alias("original_path"), F.col("hash").alias("source_hash"))
    if skipped is not None:
        gone = cut(skipped.select(F.col("path").alias("original_path")).distinct())
        known = known.join(gone, "original_path", "left_anti")
    # A source has as many as there are policies at most.  What follows has its own tasks, so that none holds all the sorted tables at once.
    wanted = resolved.groupBy(F.col("path").alias("original_path")).agg(F.collect_list(F.struct("policy", "params", "ext")).alias("wants"))
    known = cut(known.join(wanted, "original_path", "left"))
    able = known.where("source_hash is not null or wants is null")
    none = F.lit(None).cast("string")
    lacking = known.where("source_hash is null and wants is not null").select("original_path", none.alias("policy"), none.alias("path"), F.lit("missing_cache_entry").alias("step"))
    want = F.explode_outer(F.filter("wants", lambda w: w["policy"] == F.col("policy")))
    rows = able.join(have, "original_path").select("original_path", "source_hash", "policy", "path", "has_params", "has_hash", "has_ext", want.alias("want"))
    exact = F.coalesce((F.col("has_hash") == F.col("source_hash")) & (F.col("has_params") == F.col("want.params")) & (F.col("has_ext") == F.col("want.ext")), F.lit(False))
    order = Window.partitionBy("original_path", "policy").orderBy(F.desc("exact"), "path")
    ranked = rows.select("original_path", "policy", "path", F.col("want").isNotNull().alias("asked"), exact.alias("exact")).withColumn("nth", F.row_number().over(order))
    step = F.when(~F.col("asked") | (F.col("nth") > 1), "delete").when(F.col("exact"), "up_to_date").otherwise("regenerate")
    held = ranked.select("original_path", "policy", "path", step.alias("step"))
    fresh = able.select("original_path", "source_hash", F.inline("wants")).join(have.select("original_path", "policy"), ["original_path", "policy"], "left_anti")
    new = fresh.select("original_path", "policy", derived_path("original_path", F.col("params"), F.col("source_hash"), F.col("ext")).alias("path"), F.lit("generate").alias("step"))
    out = held.unionByName(new).unionByName(lacking)
    if skipped is not None:
        out = out.unionByName(gone.join(have, "original_path").select("original_path", "policy", "path", F.lit("delete").alias("step")))
    return out


def stub_previews(stubs: DataFrame, derived: DataFrame) -> DataFrame:
    """``original_path, path, step`` for sources that are stubs (``path, hash``): one preview of the same content is kept, stale ones are only reported."""
    own = stubs.select(F.col("path").alias("original_path"), F.col("hash").alias("source_hash"))
    rows = own.join(derived.select("original_path", "path", "hash"), "original_path", "left")
    same = F.coalesce(F.col("hash") == F.col("source_hash"), F.lit(False))
    order = Window.partitionBy("original_path").orderBy(F.desc("same"), "path")
    rows = rows.withColumn("same", same).withColumn("nth", F.row_number().over(order)).withColumn("any_same", F.max("same").over(Window.partitionBy("original_path")))
    step = (
        F.when(F.col("source_hash").isNull(), "missing_cache_entry")
        .when(F.col("path").isNull(), "stub_without_preview")
        .when(F.col("any_same"), F.when(F.col("nth") == 1, "preserved").otherwise("delete"))
        .otherwise("stale_preview")
    )
    return rows.where(F.col("source_hash").isNotNull() | (F.col("nth") == 1)).select("original_path", F.when(F.col("source_hash").isNotNull(), F.col("path")).alias("path"), step.alias("step"))


def orphans(derived: DataFrame, sources: DataFrame, policy_globs: list[str], ignore: list[str] = (), scope: str | None = None) -> DataFrame:
    """Derived files whose source is gone, out of scope, ignored, or named by no policy."""
    live = sources.where(globs.matches_any("path", policy_globs) & ~globs.matches_any("path", list(ignore)))
    if scope is not None:
        live = live.where(globs.matches("path", scope))
    return derived.join(live.select(F.col("path").alias("original_path")), "original_path", "left_anti")


def summary(steps: DataFrame) -> DataFrame:
    """Derived files in each step of one or more plans."""
    return steps.groupBy("step").agg(F.count(F.lit(1)).alias("files"))


def plan(sources: DataFrame, policies: DataFrame, derived: DataFrame, probe: Callable[[DataFrame], DataFrame], ignore: list[str] = (), scope: str | None = None, mode: str = "state") -> DataFrame:
    """``original_path, policy, path, step`` of a whole tree, in one call.

    ``sources`` are files (``path, hash, representation``; the hash is the
    inventory's), ``derived`` parsed names.  In this order: derived files
    themselves, what is out of scope and what an ignore glob names is no source;
    skip globs take a source's derived files; a source that no policy names is
    swept; a stub keeps a preview; in mode ``ensure`` a source all of whose
    files are there is done.  Only what is left is probed: ``probe`` adds
    ``readable`` and ``mime_type`` to rows with ``path``.  Unreadable sources keep what they have.
    """
    if mode not in ("state", "ensure", "cleanup"):
        raise ValueError(f"no such mode: {mode}")
    inside = ~F.array_contains(F.split("path", "/"), "_thumbnail") & ~globs.matches_any("path", list(ignore))
    rows = sources.where(inside & (globs.matches("path", scope) if scope is not None else F.lit(True))).select("path", "hash", "representation")
    prefix = globs.literal_prefix(scope) if scope is not None else ""
    derived = derived.where((F.col("path") >= prefix + "/") & (F.col("path") < prefix + "0")) if prefix else derived
    known = policies.select(F.col("name").alias("id"), F.col("action"))
    hits = cut(globindex.match(rows, policies, "name").join(known, "id").select("path", F.col("id").alias("policy"), "action"))
    named = hits.groupBy("path").agg(F.bool_or(F.col("action") == "skip").alias("skip"))
    tagged = rows.join(named, "path")
    stub, skip = F.col("representation") == "stub", F.col("skip")
    wanted = hits.where("action = 'generate'").select("path", "policy").join(generating(policies), "policy")
    if mode == "ensure":
        at = derived_path("path", F.col("params"), F.col("hash"), F.col("ext"))
        expected = tagged.where(F.col("hash").isNotNull() & ~skip & ~stub).select("path", "hash").join(wanted, "path").select("path", "policy", at.alias("file"))
        there = expected.join(derived.select(F.col("path").alias("file"), F.lit(True).alias("there")).distinct(), "file", "left")
        done = there.groupBy("path").agg(F.bool_and(F.coalesce("there", F.lit(False))).alias("done"))
        tagged = tagged.join(done, "path", "left")
    else:
        there, tagged = None, tagged.withColumn("done", F.lit(False))
    lane = F.when(stub, "stub").when(skip, "skip").when(F.coalesce("done", F.lit(False)), "done").otherwise("probe")
    tagged = cut(tagged.select("path", "hash", lane.alias("lane")))
    # What the probe does is dear, so that its result is kept.
    probed = cut(probe(tagged.where("lane = 'probe'").select("path", "hash")).select("path", "hash", F.coalesce("readable", F.lit(False)).alias("readable"), "mime_type"))
    resolved = probed.where("readable").select("path", "mime_type").join(wanted, "path").where(F.exists("mime_types", lambda m: scalars.mime_matches(m, F.col("mime_type")))).select("path", "policy", "params", "ext")
    steps = reconcile(probed, resolved, derived, tagged.where("lane = 'skip'"))
    none = F.lit(None).cast("string")
    unreadable = probed.where("not readable").select(F.col("path").alias("original_path"), none.alias("policy"), none.alias("path"), F.lit("unreadable").alias("step"))
    stubs = stub_previews(tagged.where("lane = 'stub'"), derived).select("original_path", none.alias("policy"), "path", "step")
    swept = derived.join(tagged.select(F.col("path").alias("original_path")), "original_path", "left_anti").select("original_path", "policy", "path", F.lit("delete").alias("step"))
    out = steps.unionByName(unreadable).unionByName(stubs).unionByName(swept)
    if there is not None:
        held = there.join(tagged.where("lane = 'done'").select("path"), "path", "left_semi")
        out = out.unionByName(held.select(F.col("path").alias("original_path"), "policy", F.col("file").alias("path"), F.lit("up_to_date").alias("step")))
    return out


# The counters, by the steps that they count.
COUNTERS = {"up_to_date": "up_to_date", "to_generate": "generate", "to_regenerate": "regenerate", "to_delete": "delete", "missing_cache_entry": "missing_cache_entry", "stubbed_original": "stub_without_preview", "unreadable": "unreadable", "errors": "error"}


def counters(steps: DataFrame) -> DataFrame:
    """One row of counters of a whole plan (steps ``error`` are what a run adds), and ``ok`` and the exit status: without errors and stale previews of stubs."""
    each = [F.count_if(F.col("step") == step).alias(name) for name, step in COUNTERS.items()]
    stubs = [F.count_distinct(F.when(F.col("step") == "preserved", F.col("original_path"))).alias("stubbed_preserved"), F.count_distinct(F.when(F.col("step") == "stale_preview", F.col("original_path"))).alias("stale_stub_previews")]
    ok = (F.col("errors") == 0) & (F.col("stale_stub_previews") == 0)
    return steps.agg(*each, *stubs).withColumn("ok", ok).withColumn("status_code", F.when(ok, 0).otherwise(1).cast("long"))
