"""Upgrades of a snapshot's relations from one schema version to the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktake import schemas

Relations = dict[str, DataFrame]


def pending(known: dict[str, Callable[[Relations], Relations]], applied: list[str]) -> list[str]:
    """Names of the upgrades that a snapshot lacks, in order."""
    return sorted(set(known) - set(applied))


def broken_references(relations: Relations) -> DataFrame:
    """Entries whose content or version has no row: there must be none."""
    content = schemas.missing_parents(relations["entries"], relations["objects"], "hash", "hash").select("path")
    version = schemas.missing_parents(relations["entries"], relations["versions"], "state_version", "version_stamp").select("path")
    return content.unionByName(version)


def upgrade(relations: Relations, known: dict[str, Callable[[Relations], Relations]], applied: list[str]) -> tuple[Relations, list[str]]:
    """All relations after the pending upgrades, and the names of all applied; fails before anything is written if references break."""
    todo = pending(known, applied)
    for name in todo:
        relations = relations | known[name](relations)
    if todo and not broken_references(relations).isEmpty():
        raise ValueError(f"upgrades {todo} leave references without a parent")
    return relations, sorted({*applied, *todo})


# ---- upgrades of policies for derived files, in their order -------------------------------------


def named(relations: Relations) -> Relations:
    """Policies get a name made of their number, and lose their priority."""
    old = relations["thumbnail_policies"]
    rest = [c for c in old.columns if c not in ("id", "name", "priority")]
    return {"thumbnail_policies": old.select("id", F.concat(F.lit("policy_"), F.col("id").cast("string")).alias("name"), *rest)}


def sized(relations: Relations) -> Relations:
    """What was the only way to size images and to sum up videos becomes one of two."""
    old = relations["thumbnail_policies"]
    none = F.lit(None).cast("long")
    new = {
        "resizing_strategy": F.when(F.col("media_type") == "image", "fit_to_box"), "shorter_side": none,
        "output_type": F.when(F.col("media_type") == "video", "mosaic"), "frame_count": none, "frame_delay_ms": none,
    }
    return {"thumbnail_policies": old.withColumns(new)}


def encoded(relations: Relations) -> Relations:
    """Each policy gets the format that it made before, with that format's settings; both kinds of video share the shorter side."""
    old = relations["thumbnail_policies"]
    generates, none = F.col("action") == "generate", F.lit(None).cast("long")
    # Null for images, which are no animations.
    animated = F.col("output_type").eqNullSafe("gif")
    new = {
        "shorter_side": F.when(F.col("media_type") == "video", F.col("tile_size")).otherwise(F.col("shorter_side")),
        "output_type": F.when(animated, "preview").otherwise(F.col("output_type")),
        "output_mime": F.when(generates & animated, "image/gif").when(generates, "image/jpeg"),
        "jpeg_quality": F.when(generates & ~animated, F.coalesce("jpeg_quality", F.lit(80).cast("long"))),
        "png_compression_level": none, "webp_quality": none, "webp_lossless": F.lit(None).cast("boolean"),
        "gif_max_colors": F.when(generates & animated, F.lit(256).cast("long")), "gif_dither": F.when(generates & animated, "sierra2_4a"),
    }
    return {"thumbnail_policies": old.withColumns(new).drop("tile_size")}


UPGRADES: dict[str, Callable[[Relations], Relations]] = {"07_named": named, "08_sized": sized, "09_encoded": encoded}
