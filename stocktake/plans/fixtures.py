"""An inventory derived from the ``documents`` table, in DataFrames and, for comparison, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocktake.functions import scalars

# Fixed values of the derivation.
IGNORE = ["*/src1?/*5.txt", "es/src3/**"]
POLICIES = [("en/**", "GLACIER"), ("*/src[0-4]/*", "DEEP_ARCHIVE")]
DEFAULT = "STANDARD"
NOW = "2026-06-15 00:00:00"
EXPIRY = {2: "Wed, 01 Jul 2026 00:00:00 GMT", 3: "Thu, 01 Jan 2026 00:00:00 GMT"}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, path, hash, size``: one file for each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat_ws("/", "lang", "source", F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select("doc_id", path.alias("path"), F.md5(F.col("text").cast("binary")).alias("hash"), F.col("n_chars").cast("long").alias("size"))


def _entry(v: DataFrame) -> DataFrame:
    version = F.concat(F.lit("v"), (F.col("doc_id") % 7).cast("string"))
    return v.select("doc_id", "path", F.lit("file").alias("type"), "hash", version.alias("state_version"), scalars.collision_key("path").alias("normalized_path"), "size")


def entries_gc(v: DataFrame) -> DataFrame:
    return _entry(v.where("doc_id % 3 <> 0"))


def entries(v: DataFrame) -> DataFrame:
    """Files, and the folders above them with no hash."""
    files = _entry(v.where("doc_id % 10 <> 1"))
    folders = v.select(scalars.dirname("path").alias("path")).distinct().select(F.lit(None).cast("long").alias("doc_id"), "path", F.lit("dir").alias("type"), F.lit(None).cast("string").alias("hash"), F.lit("v0").alias("state_version"), scalars.collision_key("path").alias("normalized_path"), F.lit(None).cast("long").alias("size"))
    return files.unionByName(folders)


def cache(v: DataFrame) -> DataFrame:
    rows = v.where("doc_id % 10 <> 0")
    state = F.element_at(F.array(*map(F.lit, ("created", "modified", "deleted", "unchanged"))), (F.floor(F.col("doc_id") / 10) % 4 + 1).cast("int"))
    shift = F.when((F.col("doc_id") % 10).isin(2, 3) & (F.col("doc_id") % 3 == 0), 1).otherwise(0)
    digest = F.when(F.col("doc_id") % 10 == 2, F.md5(F.col("hash").cast("binary"))).otherwise(F.col("hash"))
    parent = F.concat(F.lit("v"), ((F.col("doc_id") + shift) % 7).cast("string"))
    return rows.select("doc_id", "path", F.lit("file").alias("type"), (F.col("doc_id") * 1000).alias("mtime"), digest.alias("hash"), "size", state.alias("state"), parent.alias("parent_state_version"), scalars.collision_key("path").alias("normalized_path"))


def objects(v: DataFrame) -> DataFrame:
    """``hash, s3_key, size, ciphertext_checksum``."""
    return v.groupBy("hash").agg(F.min("size").alias("size")).select("hash", scalars.object_key("hash").alias("s3_key"), "size", F.md5(F.col("hash").cast("binary")).alias("ciphertext_checksum"))


def _digit(k: int):
    return F.instr(F.lit("0123456789abcdef"), F.substring("hash", k, 1)) - 1


def heads(objects: DataFrame) -> DataFrame:
    """The store's answers: no row for digests that end in ``0``, another checksum for those that end in ``1``."""
    k1, k2 = _digit(1), _digit(2)
    restore = F.when(k2 % 4 == 1, 'ongoing-request="true"')
    for k, date in EXPIRY.items():
        restore = restore.when(k2 % 4 == k, f'ongoing-request="false", expiry-date="{date}"')
    kind = F.when(k1 % 4 == 1, "STANDARD").when(k1 % 4 == 2, "GLACIER").when(k1 % 4 == 3, "DEEP_ARCHIVE")
    last = F.substring("hash", 32, 1)
    checksum = F.when(last == "1", "x").otherwise(F.md5(F.col("hash").cast("binary")))
    return objects.where(F.substring("hash", 32, 1) != "0").select("hash", kind.alias("storage_class"), restore.alias("restore"), checksum.alias("checksum"), (F.substring("hash", 31, 1) != "0").alias("intact"))


def listing(v: DataFrame) -> DataFrame:
    """``path, type, representation, mtime_ms, size, hash, checksum`` of the files in place, and their folders."""
    rows = v.where("doc_id % 9 <> 4")
    kind = F.when(F.col("doc_id") % 11 == 0, "stub").when(F.col("doc_id") % 11 == 1, "both").otherwise("real")
    digest = F.when(F.col("doc_id") % 13 == 5, F.md5(F.col("hash").cast("binary"))).otherwise(F.col("hash"))
    time = F.col("doc_id") * 1000.0 + F.when(F.col("doc_id") % 4 == 0, 0.5).otherwise(0.25)
    files = rows.select("path", F.lit("file").alias("type"), kind.alias("representation"), time.cast("double").alias("mtime_ms"), "size", digest.alias("hash"), F.md5(digest.cast("binary")).alias("checksum"))
    folders = v.select(scalars.dirname("path").alias("path")).distinct().select("path", F.lit("dir").alias("type"), F.lit("real").alias("representation"), F.lit(0.0).alias("mtime_ms"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("string").alias("hash"), F.lit(None).cast("string").alias("checksum"))
    return files.unionByName(folders)


def raw_tree(v: DataFrame) -> DataFrame:
    """``path, type, mtime_ms, size`` of a tree as it lies there: stubs and unfinished files of their own, folders without order."""
    time = F.col("doc_id") * 1000.0
    real = v.where("doc_id % 11 <> 0").select("path", F.lit("file").alias("type"), time.alias("mtime_ms"), "size")
    stub = v.where("doc_id % 11 < 2").select(scalars.stub_path("path").alias("path"), F.lit("file").alias("type"), (time + 0.5).alias("mtime_ms"), F.lit(72).cast("long").alias("size"))
    unfinished = F.concat(scalars.dirname("path"), F.lit("/.x-tmp-"), F.md5(F.col("hash").cast("binary")))
    left = v.where("doc_id % 29 = 0").select(unfinished.alias("path"), F.lit("file").alias("type"), time.alias("mtime_ms"), "size")
    folders = v.select(scalars.dirname("path").alias("path")).distinct().select("path", F.lit("dir").alias("type"), F.lit(0.0).alias("mtime_ms"), F.lit(0).cast("long").alias("size"))
    return real.unionByName(stub).unionByName(left).unionByName(folders)


def mirror(objects: DataFrame) -> DataFrame:
    """Files on a mirror: a third of the objects missing, some of a wrong size or content, and some that no object names."""
    last = F.substring("hash", 32, 1)
    have = objects.where(~F.substring("hash", 30, 1).isin("0", "1", "2", "3", "4")).select("hash", (scalars.encrypted_size("size") + F.when(last == "2", 1).otherwise(0)).alias("size"), F.when(last == "3", "x").otherwise(F.col("ciphertext_checksum")).alias("checksum"))
    extra = objects.where(last == "4").select(F.md5(F.col("hash").cast("binary")).alias("hash"), F.lit(1).cast("long").alias("size"), F.lit("y").alias("checksum"))
    return have.unionByName(extra)


def deletions(v: DataFrame) -> DataFrame:
    """A history in which a path is deleted one to three times."""
    rows = v.where("doc_id % 5 = 0").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("doc_id") % 3)))
    return rows.select((F.col("doc_id") * 10 + F.col("k")).alias("id"), "path", F.lit("file").alias("type"), "hash", F.concat(F.lit("v"), F.col("k").cast("string")).alias("introduced_in_version"), F.concat(F.lit("v"), (F.col("k") + 1).cast("string")).alias("deleted_in_version"))


def versions(v: DataFrame) -> DataFrame:
    """The versions that entries name, numbered from 1."""
    return v.select((F.col("doc_id") % 7 + 1).alias("sequence"), F.concat(F.lit("v"), (F.col("doc_id") % 7).cast("string")).alias("version_stamp")).distinct()


def colliding(v: DataFrame) -> DataFrame:
    """Paths that differ in case only."""
    path = F.concat(F.lit("u"), (F.col("doc_id") % 49).cast("string"), F.when(F.col("doc_id") % 2 == 0, "/A.TXT").otherwise("/a.txt"))
    return v.select(path.alias("path"), F.lit("created").alias("state")).distinct()


def derived(v: DataFrame) -> DataFrame:
    """Preview files of some documents: current, stale, of unknown policies, misnamed."""
    digest = F.when(F.col("doc_id") % 3 == 0, F.md5(F.col("hash").cast("binary"))).otherwise(F.col("hash"))
    params = F.when(F.col("doc_id") % 5 == 0, "p2-small-ss100-fmtimage_png-pl6").when(F.col("doc_id") % 5 == 1, "p2-big-iw800-ih600-fmtimage_jpeg-q80").when(F.col("doc_id") % 5 == 2, "p1-small-ss64").when(F.col("doc_id") % 5 == 3, "p2-other-ss1").otherwise("odd")
    ext = F.when(F.col("doc_id") % 5 == 1, "jpg").otherwise("png")
    folder = scalars.dirname("path")
    path = F.concat(folder, F.lit("/_thumbnail/"), scalars.basename("path"), F.lit("."), params, F.lit("."), digest, F.lit("."), ext)
    twice = v.where("doc_id % 6 <> 5").withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).where("copy = 0 or doc_id % 7 = 0")
    return twice.select(F.when(F.col("copy") == 0, path).otherwise(F.regexp_replace(path, "ss100|iw800", "ss1")).alias("path"))


# Two policies for derived files and one that skips.
GENERATE = [
    {"id": 1, "name": "small", "glob": "**", "action": "generate", "mime_types": ["text/*"], "media_type": "image", "resizing_strategy": "resize_shorter_side", "shorter_side": 100, "output_mime": "image/png", "png_compression_level": 6},
    {"id": 2, "name": "big", "glob": "{en,fr}/**", "action": "generate", "mime_types": ["text/plain", "image/png"], "media_type": "image", "resizing_strategy": "fit_to_box", "image_width": 800, "image_height": 600, "output_mime": "image/jpeg", "jpeg_quality": 80},
]

#: The base inventory in SQL, as a common table expression.
V = "v AS (SELECT doc_id, concat_ws('/', lang, source, concat('doc', CAST(doc_id AS VARCHAR), '.txt')) AS path, md5(text) AS hash, CAST(n_chars AS BIGINT) AS size FROM documents)"
FOLDERS = "folders AS (SELECT DISTINCT regexp_replace(path, '(?:^|/)[^/]*$', '') AS path FROM v)"
ENTRIES = "entries AS (SELECT doc_id, path, 'file' AS type, hash, 'v' || (doc_id % 7) AS state_version, lower(path) AS normalized_path, size FROM v WHERE doc_id % 10 <> 1 UNION ALL SELECT NULL, path, 'dir', NULL, 'v0', lower(path), NULL FROM folders)"
CACHE = "cache AS (SELECT doc_id, path, 'file' AS type, doc_id * 1000 AS mtime, CASE WHEN doc_id % 10 = 2 THEN md5(hash) ELSE hash END AS hash, size, CASE (doc_id // 10) % 4 WHEN 0 THEN 'created' WHEN 1 THEN 'modified' WHEN 2 THEN 'deleted' ELSE 'unchanged' END AS state, 'v' || ((doc_id + CASE WHEN doc_id % 10 IN (2, 3) AND doc_id % 3 = 0 THEN 1 ELSE 0 END) % 7) AS parent_state_version FROM v WHERE doc_id % 10 <> 0)"
OBJECTS = "objects AS (SELECT hash, min(size) AS size, 'objects/' || substr(hash, 1, 2) || '/' || substr(hash, 3, 2) || '/' || hash AS s3_key, md5(hash) AS ciphertext_checksum FROM v GROUP BY hash)"
HEADS = (
    "heads AS (SELECT hash, CASE (instr('0123456789abcdef', substr(hash, 1, 1)) - 1) % 4 WHEN 1 THEN 'STANDARD' WHEN 2 THEN 'GLACIER' WHEN 3 THEN 'DEEP_ARCHIVE' END AS storage_class, (instr('0123456789abcdef', substr(hash, 2, 1)) - 1) % 4 AS k2, "
    "CASE WHEN substr(hash, 32, 1) = '1' THEN 'x' ELSE md5(hash) END AS checksum, substr(hash, 31, 1) <> '0' AS intact, "
    "CASE WHEN (instr('0123456789abcdef', substr(hash, 1, 1)) - 1) % 4 IN (0, 1) THEN 'immediate' WHEN k2 = 0 THEN 'needs-restore-request' WHEN k2 = 1 THEN 'restore-ongoing' WHEN k2 = 2 THEN 'restore-ready' ELSE 'restore-expired-needs-reissue' END AS status "
    "FROM objects WHERE substr(hash, 32, 1) <> '0')"
)
LISTING = "listing AS (SELECT path, 'file' AS type, CASE doc_id % 11 WHEN 0 THEN 'stub' WHEN 1 THEN 'both' ELSE 'real' END AS representation, doc_id * 1000 + CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS mtime, size, CASE WHEN doc_id % 13 = 5 THEN md5(hash) ELSE hash END AS hash, md5(CASE WHEN doc_id % 13 = 5 THEN md5(hash) ELSE hash END) AS checksum FROM v WHERE doc_id % 9 <> 4 UNION ALL SELECT path, 'dir', 'real', 0, 0, NULL, NULL FROM folders)"
RAW = "raw AS (SELECT path, 'file' AS type, doc_id * 1000.0::DOUBLE AS mtime_ms, size FROM v WHERE doc_id % 11 <> 0 UNION ALL SELECT path || '.stub', 'file', doc_id * 1000.0::DOUBLE + 0.5, 72 FROM v WHERE doc_id % 11 < 2 UNION ALL SELECT regexp_replace(path, '(?:^|/)[^/]*$', '') || '/.x-tmp-' || md5(hash), 'file', doc_id * 1000.0::DOUBLE, size FROM v WHERE doc_id % 29 = 0 UNION ALL SELECT path, 'dir', 0::DOUBLE, 0 FROM folders)"
ENCRYPTED = "(50 + size + CAST(ceil(size / 4194304.0) AS BIGINT) * 16)"
MIRROR = f"mirror AS (SELECT hash, {ENCRYPTED} + CASE WHEN substr(hash, 32, 1) = '2' THEN 1 ELSE 0 END AS size, CASE WHEN substr(hash, 32, 1) = '3' THEN 'x' ELSE ciphertext_checksum END AS checksum FROM objects WHERE substr(hash, 30, 1) NOT IN ('0', '1', '2', '3', '4') UNION ALL SELECT md5(hash), 1, 'y' FROM objects WHERE substr(hash, 32, 1) = '4')"
DELETIONS = "deletions AS (SELECT doc_id * 10 + k AS id, path, hash, 'v' || k AS introduced_in_version, 'v' || (k + 1) AS deleted_in_version FROM (SELECT *, unnest(range(0, doc_id % 3 + 1)) AS k FROM v WHERE doc_id % 5 = 0))"
IGNORED = r"regexp_matches(path, '^(?s:[^/]+/src1[^/]/[^/]*5\.txt|es/src3/.+)$')"
CLASS = r"CASE WHEN starts_with(path, 'en/') THEN 1 WHEN regexp_matches(path, '^[^/]+/src[0-4]/[^/]+$') THEN 2 ELSE 0 END"
CLASS_NAME = "CASE {} WHEN 0 THEN 'STANDARD' WHEN 1 THEN 'GLACIER' ELSE 'DEEP_ARCHIVE' END"


def with_ctes(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "
