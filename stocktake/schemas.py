"""Schemas of the relations, and checks that return the rows that break a rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSIONS = "sequence long, version_stamp string, created_at string"
OBJECTS = "hash string, s3_key string, size long, ciphertext_checksum string"
ENTRIES = "path string, type string, hash string, state_version string, normalized_path string"
ENTRY_DELETIONS = "id long, path string, type string, hash string, introduced_in_version string, deleted_in_version string, created_at string"
CACHE_ENTRIES = "path string, type string, mtime long, hash string, size long, state string, parent_state_version string, normalized_path string"
IGNORE_POLICIES = "id long, glob string, created_at string"
STORAGE_POLICIES = "id long, glob string, target_class string, priority long, is_default boolean"
THUMBNAIL_POLICIES = (
    "id long, name string, glob string, action string, mime_types array<string>, media_type string, resizing_strategy string, image_width long, image_height long, "
    "shorter_side long, output_type string, tile_row_count long, tile_column_count long, frame_count long, frame_delay_ms long, output_mime string, jpeg_quality long, "
    "png_compression_level long, webp_quality long, webp_lossless boolean, gif_max_colors long, gif_dither string, created_at string"
)
FS_LISTING = "path string, type string, representation string, mtime_ms double, size long"
OBJECT_HEADS = "key string, storage_class string, restore string, checksum string, content_length long"
MIRROR_OBJECTS = "hash string, size long"
PROBED_MEDIA = "path string, kind string, mime_type string, width long, height long, duration_seconds double, reason string"

# The states of a local entry.
STATES = ("unchanged", "created", "modified", "deleted")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once: ``key, rows``."""
    return df.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def missing_parents(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows whose non-null reference has no parent."""
    return child.where(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias("_parent")), F.col(child_key) == F.col("_parent"), "left_anti")


def validate_entries(entries: DataFrame, objects: DataFrame) -> DataFrame:
    """``path, problem`` of rows that break the rules of snapshot entries: a file has a hash, nothing else has, and it is known."""
    shape = entries.where((F.col("type") == "file") != F.col("hash").isNotNull()).select("path", F.lit("file_hash").alias("problem"))
    orphan = missing_parents(entries, objects, "hash", "hash").select("path", F.lit("unknown_object").alias("problem"))
    twice = duplicate_keys(entries, "path").select(F.col("key").alias("path"), F.lit("duplicate_path").alias("problem"))
    return reduce(DataFrame.unionByName, [shape, orphan, twice])


def validate_cache(cache: DataFrame) -> DataFrame:
    """``path, problem``: unknown states, and live files without a size or hash."""
    state = cache.where(~F.col("state").isin(*STATES) | F.col("state").isNull()).select("path", F.lit("unknown_state").alias("problem"))
    size = cache.where((F.col("type") == "file") & (F.col("state") != "deleted") & (F.col("size").isNull() | F.col("hash").isNull())).select("path", F.lit("live_file_without_content").alias("problem"))
    return state.unionByName(size)


def validate_storage_policies(policies: DataFrame) -> DataFrame:
    """``id, problem``: each row is either the default or has a glob and a priority; one default in all."""
    shape = policies.where(F.col("is_default") == (F.col("glob").isNotNull() | F.col("priority").isNotNull())).select("id", F.lit("default_shape").alias("problem"))
    count = policies.agg(F.count_if("is_default").alias("n")).where("n <> 1").select(F.lit(None).cast("long").alias("id"), F.lit("default_count").alias("problem"))
    return shape.unionByName(count)
