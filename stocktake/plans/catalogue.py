"""The registered queries on inventories, each with the SQL that it must agree with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocktake import schemas
from stocktake.functions import globs, scalars
from stocktake.functions.digests import blake2b_256, crc64nvme
from stocktake.operators import changes, checks, derived, gc, inventory, storage, sync
from stocktake.plans import fixtures as fx
from stocktake.sources import tree
from stocktake.sources.store import SnapshotStore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(make: Callable[[DataFrame], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: make(fx.documents(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return make

    return add


def _now():
    return F.lit(fx.NOW).cast("timestamp")


def _policies(v: DataFrame) -> DataFrame:
    rows = [(1, *fx.POLICIES[0], 0, False), (2, *fx.POLICIES[1], 1, False), (3, None, fx.DEFAULT, None, True)]
    return v.sparkSession.createDataFrame(rows, schemas.STORAGE_POLICIES)


def _generate(v: DataFrame) -> DataFrame:
    return v.sparkSession.createDataFrame([dict(p) for p in fx.GENERATE], schemas.THUMBNAIL_POLICIES)


_entries = fx.with_ctes(fx.V, fx.FOLDERS, fx.ENTRIES)
_cache = fx.with_ctes(fx.V, fx.CACHE)
_both = fx.with_ctes(fx.V, fx.FOLDERS, fx.ENTRIES, fx.CACHE)
_scan = fx.with_ctes(fx.V, fx.FOLDERS, fx.CACHE, fx.LISTING)
_store = fx.with_ctes(fx.V, fx.FOLDERS, fx.ENTRIES, fx.OBJECTS, fx.HEADS)

# ---- lookups, scans, paging -------------------------------------------------------------------


@query("point_lookup", _entries + "SELECT path, type, hash, state_version FROM entries WHERE path IN (SELECT path FROM v WHERE doc_id % 50 = 7)")
def point_lookup(v):
    return inventory.lookup(fx.entries(v), v.where("doc_id % 50 = 7"), "path").select("path", "type", "hash", "state_version")


@query("paths_by_hash", _entries + "SELECT hash, count(*) AS n_paths, min(path) AS first_path, max(path) AS last_path FROM entries WHERE hash IS NOT NULL GROUP BY hash")
def paths_by_hash(v):
    return inventory.paths_by_hash(fx.entries(v))


@query("glob_scan_prefix", _entries + "SELECT path, hash FROM entries WHERE path LIKE 'fr/src1/%' AND path NOT LIKE 'fr/src1/%/%'")
def glob_scan_prefix(v):
    return inventory.glob_scan(fx.entries(v), "fr/src1/*").select("path", "hash")


@query("glob_scan_braces", _entries + r"SELECT path, hash FROM entries WHERE regexp_matches(path, '^(de|es)/src1[0-3]/doc[^/]*7\.txt$')")
def glob_scan_braces(v):
    return inventory.glob_scan(fx.entries(v), "{de,es}/src1[0-3]/doc*7.txt").select("path", "hash")


@query("glob_scan_globstar", _entries + r"SELECT path, hash FROM entries WHERE regexp_matches(path, '^(.*/)?doc[0-9][0-9]\.txt$')")
def glob_scan_globstar(v):
    return inventory.glob_scan(fx.entries(v), "**/doc[0-9][0-9].txt").select("path", "hash")


@query("first_matching_glob", fx.with_ctes(fx.V) + r"SELECT path, CASE WHEN path LIKE 'en/%' THEN 'en/**' WHEN regexp_matches(path, '^[^/]+/src[0-4]/[^/]+$') THEN '*/src[0-4]/*' END AS glob FROM v")
def first_matching_glob(v):
    return v.select("path", globs.first_match("path", [g for g, _ in fx.POLICIES]).alias("glob"))


@query("distinct_hashes_by_glob", _entries + "SELECT DISTINCT hash FROM entries WHERE hash IS NOT NULL AND path LIKE 'es/%'")
def distinct_hashes_by_glob(v):
    return inventory.distinct_hashes(fx.entries(v), "es/**")


@query("distinct_hash_count", _entries + "SELECT count(DISTINCT hash) AS hashes FROM entries WHERE path LIKE 'es/%'")
def distinct_hash_count(v):
    return inventory.distinct_hashes(fx.entries(v), "es/**").agg(F.count(F.lit(1)).alias("hashes"))


@query("dirty_ordered", _cache + "SELECT path, state, CASE WHEN state = 'deleted' THEN 0 ELSE 1 END AS phase FROM cache WHERE state <> 'unchanged' ORDER BY phase, path")
def dirty_ordered(v):
    return inventory.dirty(fx.cache(v)).select("path", "state", "phase")


@query("diff_tally", _cache + "SELECT count(*) FILTER (state = 'created') AS created, count(*) FILTER (state = 'modified') AS modified, count(*) FILTER (state = 'deleted') AS deleted FROM cache WHERE path LIKE 'en/%'")
def diff_tally(v):
    return inventory.tally(inventory.glob_scan(fx.cache(v), "en/**"))


@query("row_counts", _both + "SELECT (SELECT count(*) FROM entries) AS entries, count(*) AS cache, count(*) FILTER (state <> 'unchanged') AS dirty FROM cache")
def row_counts(v):
    n = fx.entries(v).agg(F.count(F.lit(1)).alias("entries"))
    return n.crossJoin(fx.cache(v).agg(F.count(F.lit(1)).alias("cache"), F.count_if(F.col("state") != "unchanged").alias("dirty")))  # one row each


@query("keyset_page", _entries + "SELECT path, hash FROM entries WHERE path > 'en/src3/' ORDER BY path LIMIT 50")
def keyset_page(v):
    """A page of 50 rows: the limit is the feature."""
    return inventory.page(fx.entries(v), "path", 50, after="en/src3/").select("path", "hash")


@query("latest_version", fx.with_ctes(fx.V) + "SELECT doc_id % 7 + 1 AS sequence, 'v' || (doc_id % 7) AS version_stamp FROM v ORDER BY 1 DESC LIMIT 1")
def latest_version(v):
    return inventory.latest_version(fx.versions(v))


@query("inspect_paths", fx.with_ctes(fx.V, fx.FOLDERS, fx.ENTRIES, fx.CACHE, fx.OBJECTS) + "SELECT path, c.state AS local_state, c.hash AS local_hash, e.hash AS remote_hash, e.state_version AS remote_version, coalesce(CAST(substr(e.state_version, 2) AS BIGINT) + 1, -1) AS sequence, coalesce(o.size, -1) AS object_size FROM cache c FULL JOIN entries e USING (path) LEFT JOIN objects o ON o.hash = e.hash WHERE path LIKE 'fr/%' AND path NOT LIKE 'fr/%/%/%' AND path LIKE 'fr/%/%'")
def inspect_paths(v):
    rows = inventory.inspect(fx.cache(v), fx.entries(v), fx.versions(v), fx.objects(v), "fr/*/*")
    return rows.select("path", F.col("local.state").alias("local_state"), F.col("local.hash").alias("local_hash"), F.col("remote.hash").alias("remote_hash"), F.col("remote.state_version").alias("remote_version"), F.coalesce("remote.sequence", F.lit(-1)).cast("long").alias("sequence"), F.coalesce("remote.size", F.lit(-1)).cast("long").alias("object_size"))


@query("deletion_history", fx.with_ctes(fx.V, fx.DELETIONS) + "SELECT id, path, hash, introduced_in_version, deleted_in_version, row_number() OVER (PARTITION BY path ORDER BY id) AS nth FROM deletions WHERE path LIKE 'de/%'")
def deletion_history(v):
    return inventory.deletion_history(fx.deletions(v), v.where(globs.matches("path", "de/**"))).select("id", "path", "hash", "introduced_in_version", "deleted_in_version", "nth")


@query("upsert_entries", _entries + "SELECT path, CASE WHEN doc_id % 4 = 1 AND type = 'file' THEN md5(hash) ELSE hash END AS hash FROM entries UNION ALL SELECT path, md5(hash) FROM v WHERE doc_id % 10 = 1 AND doc_id % 4 = 1")
def upsert_entries(v):
    delta = v.where("doc_id % 4 = 1").select("path", F.md5(F.col("hash").cast("binary")).alias("hash"))
    return inventory.upsert(fx.entries(v).select("path", "hash"), delta, "path")


@query("insert_version", fx.with_ctes(fx.V) + "SELECT DISTINCT doc_id % 7 + 1 AS sequence, 'v' || (doc_id % 7) AS version_stamp FROM v UNION ALL SELECT max(doc_id % 7 + 1) + 1, 'v9' FROM v")
def insert_version(v):
    known = fx.versions(v).withColumn("created_at", F.lit("2026-06-14T00:00:00.000Z"))
    return inventory.insert_version(known, "v9", "2026-06-15T00:00:00.000Z").select("sequence", "version_stamp")


@query("delete_with_history", _entries + "SELECT path, hash, state_version AS introduced_in_version, 'v9' AS deleted_in_version, row_number() OVER (ORDER BY path) AS id FROM entries WHERE path IN (SELECT path FROM v WHERE doc_id % 100 = 3)")
def delete_with_history(v):
    _, history = inventory.delete_with_history(fx.entries(v), v.where("doc_id % 100 = 3"), "v9", "2026-06-15T00:00:00.000Z")
    return history.select("path", "hash", "introduced_in_version", "deleted_in_version", "id")


# ---- garbage ----------------------------------------------------------------------------------

_gc = fx.with_ctes(fx.V, fx.OBJECTS) + "SELECT {} FROM objects WHERE hash NOT IN (SELECT hash FROM v WHERE doc_id % 3 <> 0)"


@query("orphans", _gc.format("hash, s3_key, size"))
def orphans(v):
    return gc.orphans(fx.objects(v), fx.entries_gc(v)).select("hash", "s3_key", "size")


@query("orphan_summary", _gc.format("count(*) AS objects, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes"))
def orphan_summary(v):
    return gc.orphan_summary(fx.objects(v), fx.entries_gc(v))


@query("collect_garbage", fx.with_ctes(fx.V, fx.OBJECTS) + "SELECT hash, size FROM objects WHERE hash IN (SELECT hash FROM v WHERE doc_id % 3 <> 0)")
def collect_garbage(v):
    return gc.collect_garbage(fx.objects(v), fx.entries_gc(v))[0].select("hash", "size")


# ---- scanning ---------------------------------------------------------------------------------

_colliding = fx.with_ctes(fx.V, "rows AS (SELECT DISTINCT 'u' || (doc_id % 49) || CASE WHEN doc_id % 2 = 0 THEN '/A.TXT' ELSE '/a.txt' END AS path FROM v)")


@query("collision_groups", _colliding + "SELECT lower(path) AS normalized_path, count(*) AS paths FROM rows GROUP BY 1 HAVING count(*) > 1")
def collision_groups(v):
    return changes.collision_groups(fx.colliding(v))


@query("collisions", _colliding + ", staged AS (SELECT *, CASE WHEN path LIKE 'u1_/%' THEN 1 ELSE 0 END AS durable FROM rows) SELECT a.path, min(b.path) AS other, CASE WHEN min(b.durable) = 0 THEN 'batch' ELSE 'durable' END AS source FROM staged a JOIN staged b ON lower(a.path) = lower(b.path) AND a.path <> b.path WHERE NOT (a.durable = 1 AND a.path LIKE '%A.TXT') GROUP BY a.path")
def collisions(v):
    """Of the folders u10 to u19 the upper-case paths are in the inventory already, all others are staged."""
    rows = fx.colliding(v)
    old = F.col("path").rlike("^u1[0-9]/A")
    return changes.staged_collisions(rows.where(~old), rows.where(old))


_outcomes = _scan + f"""SELECT path, CASE
  WHEN c.path IS NULL AND {fx.IGNORED} THEN 'ignored' WHEN c.path IS NULL THEN 'created'
  WHEN f.path IS NULL AND c.state = 'deleted' THEN 'gone' WHEN f.path IS NULL THEN 'deleted'
  WHEN c.state = 'created' AND {fx.IGNORED} THEN 'dropped'
  WHEN f.type = 'dir' THEN CASE WHEN c.state = 'deleted' THEN 'created' ELSE 'unchanged' END
  WHEN f.mtime = c.mtime AND f.representation <> 'both' THEN 'unchanged' WHEN f.hash = c.hash THEN 'unchanged'
  WHEN c.state = 'unchanged' THEN 'modified' WHEN c.state = 'deleted' THEN 'created' ELSE c.state END AS outcome,
  c.state AS old_state, f.hash AS new_hash, f.mtime AS new_mtime, c.hash AS old_hash, c.mtime AS old_mtime, c.parent_state_version AS parent, f.representation
FROM listing f FULL JOIN cache c USING (path)"""


@query("scan_changes", f"SELECT path, outcome, CASE WHEN outcome IN ('ignored', 'dropped') THEN NULL WHEN outcome IN ('unchanged', 'gone') THEN old_state ELSE outcome END AS state, CASE WHEN outcome IN ('created', 'modified') THEN new_hash WHEN outcome = 'unchanged' OR outcome = 'gone' THEN old_hash END AS hash, coalesce(CASE WHEN outcome IN ('created', 'modified') OR outcome = 'unchanged' AND NOT (new_mtime = old_mtime AND representation <> 'both') THEN new_mtime WHEN outcome IN ('unchanged', 'gone') THEN old_mtime END, -1) AS mtime, CASE WHEN outcome NOT IN ('ignored', 'dropped') THEN coalesce(parent, 'v6') END AS parent_state_version FROM ({_outcomes})")
def scan_changes(v):
    return changes.scan_changes(fx.listing(v), fx.cache(v), "v6", fx.IGNORE).select("path", "outcome", "state", "hash", F.coalesce("mtime", F.lit(-1)).cast("long").alias("mtime"), "parent_state_version")


@query("scan_summary", "SELECT " + ", ".join(f"count(*) FILTER (outcome = '{s}') AS {s}" for s in ("created", "modified", "deleted", "unchanged", "ignored", "dropped")) + f" FROM ({_outcomes})")
def scan_summary(v):
    return changes.scan_summary(changes.scan_changes(fx.listing(v), fx.cache(v), "v6", fx.IGNORE))


@query("apply_scan", f"SELECT path, state, mtime, hash, parent_state_version FROM ({SQL['scan_changes']}) WHERE state IS NOT NULL")
def apply_scan(v):
    after, _ = changes.apply_scan(fx.listing(v), fx.cache(v), "v6", fx.IGNORE)
    return after.select("path", "state", F.coalesce("mtime", F.lit(-1)).cast("long").alias("mtime"), "hash", "parent_state_version")


@query("scan_status", f"SELECT *, CAST(0 AS BIGINT) AS collisions, CAST(0 AS BIGINT) AS status_code FROM ({SQL['scan_summary']})")
def scan_status(v):
    cache = fx.cache(v)
    found = changes.scan_changes(fx.listing(v), cache, "v6", fx.IGNORE)
    return changes.scan_status(found, changes.staged_collisions(found.where("outcome in ('created', 'modified', 'deleted')"), cache))


@query("sanity_estimate", fx.with_ctes(fx.V, fx.FOLDERS, fx.ENTRIES, fx.LISTING) + "SELECT count(*) AS paths, CAST(coalesce(sum(CASE WHEN e.type <> 'dir' AND f.representation = 'real' AND path LIKE 'en/%' THEN f.size END), 0) AS BIGINT) AS bytes FROM listing f FULL JOIN entries e USING (path)")
def sanity_estimate(v):
    return checks.sanity_estimate(fx.listing(v), fx.entries(v), "en/**")


@query("ignore_filter", fx.with_ctes(fx.V) + f"SELECT path FROM v WHERE NOT {fx.IGNORED}")
def ignore_filter(v):
    return v.where(~globs.matches_any("path", fx.IGNORE)).select("path")


# ---- synchronising ----------------------------------------------------------------------------

_decide = _both + """SELECT c.path, c.state, c.hash, c.size, e.state_version AS entry_version, CASE c.state
  WHEN 'created' THEN CASE WHEN e.path IS NULL THEN 'apply' WHEN c.hash IS NOT DISTINCT FROM e.hash THEN 'noop' ELSE 'conflict' END
  WHEN 'modified' THEN CASE WHEN e.path IS NULL THEN 'conflict' WHEN e.state_version = c.parent_state_version THEN 'apply' WHEN c.hash IS NOT DISTINCT FROM e.hash THEN 'noop' ELSE 'conflict' END
  ELSE CASE WHEN e.path IS NULL THEN 'noop' WHEN e.state_version = c.parent_state_version THEN 'apply' ELSE 'conflict' END END AS decision
FROM cache c LEFT JOIN entries e ON c.path = e.path WHERE c.state <> 'unchanged'"""


@query("decide_local", f"SELECT path, state, decision, entry_version FROM ({_decide})")
def decide_local(v):
    return sync.decide(inventory.dirty(fx.cache(v)), fx.entries(v)).select("path", "state", "decision", "entry_version")


@query("decide_summary", f"SELECT state, decision, count(*) AS n FROM ({_decide}) GROUP BY ALL")
def decide_summary(v):
    return sync.decide(inventory.dirty(fx.cache(v)), fx.entries(v)).groupBy("state", "decision").agg(F.count(F.lit(1)).alias("n"))


def _plan(v):
    return sync.plan_sync(inventory.dirty(fx.cache(v)), fx.entries(v), fx.objects(v.where("doc_id % 4 = 0")), "v9")


_upload = f"""SELECT path, state, decision, CASE WHEN decision = 'apply' AND state <> 'deleted' THEN CASE WHEN hash IN (SELECT md5(text) FROM documents WHERE doc_id % 4 = 0) THEN 'dedup' WHEN row_number() OVER (PARTITION BY hash, decision = 'apply' AND state <> 'deleted' ORDER BY path) = 1 THEN 'upload' ELSE 'attach' END END AS upload,
  CASE WHEN state = 'deleted' THEN NULL WHEN decision = 'apply' THEN 'v9' WHEN decision = 'noop' THEN entry_version END AS stamp FROM ({_decide})"""


@query("upload_plan", _upload)
def upload_plan(v):
    return _plan(v).select("path", "state", "decision", "upload", "stamp")


@query("sync_summary", f"SELECT count(*) FILTER (decision = 'apply') AS applied, count(*) FILTER (decision = 'noop') AS noops, count(*) FILTER (decision = 'conflict') AS conflicts, count(*) FILTER (upload = 'upload') AS uploaded, count(*) FILTER (upload IN ('dedup', 'attach')) AS deduped, CAST(CASE WHEN count(*) FILTER (decision = 'conflict') > 0 THEN 2 ELSE 0 END AS BIGINT) AS status_code FROM ({_upload})")
def sync_summary(v):
    return sync.sync_summary(_plan(v))


@query("upload_estimate", _cache + "SELECT (SELECT count(*) FROM cache WHERE state <> 'unchanged') AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM (SELECT hash, arg_min(size, path) AS size FROM cache WHERE state NOT IN ('unchanged', 'deleted') GROUP BY hash) WHERE hash NOT IN (SELECT hash FROM v WHERE doc_id % 4 = 0)")
def upload_estimate(v):
    return sync.upload_estimate(inventory.dirty(fx.cache(v)), fx.objects(v.where("doc_id % 4 = 0")))


@query("claims", _cache + "SELECT path, hash, row_number() OVER (PARTITION BY hash ORDER BY path) AS claim FROM cache")
def claims(v):
    return sync.claims(fx.cache(v).select("path", "hash"))


@query("apply_sync", f"WITH plan AS ({_upload}), e AS ({_entries} SELECT * FROM entries), c AS ({_cache} SELECT * FROM cache) SELECT path, hash, state_version FROM e WHERE path NOT IN (SELECT path FROM plan WHERE decision = 'apply') UNION ALL SELECT path, c.hash, stamp FROM plan JOIN c USING (path) WHERE decision = 'apply' AND plan.state <> 'deleted'")
def apply_sync(v):
    return sync.apply_sync(fx.entries(v).drop("doc_id", "size"), _plan(v)).select("path", "hash", "state_version")


@query("reconcile", f"WITH plan AS ({_upload}), c AS ({_cache} SELECT * FROM cache) SELECT path, CASE WHEN plan.path IS NOT NULL THEN 'unchanged' ELSE c.state END AS state, CASE WHEN plan.path IS NOT NULL THEN stamp ELSE parent_state_version END AS parent_state_version FROM c LEFT JOIN (SELECT * FROM plan WHERE decision <> 'conflict') plan USING (path) WHERE NOT (plan.path IS NOT NULL AND c.state = 'deleted')")
def reconcile(v):
    return sync.reconcile(fx.cache(v), _plan(v)).select("path", "state", "parent_state_version")


_delta = _both + "SELECT path, CASE WHEN c.path IS NULL THEN 'created' WHEN e.path IS NULL THEN 'deleted' ELSE 'modified' END AS change, e.hash, e.state_version FROM cache c FULL JOIN entries e USING (path) WHERE (c.path IS NULL OR e.path IS NULL OR c.hash IS DISTINCT FROM e.hash) AND path NOT IN (SELECT path FROM cache WHERE state IN ('created', 'modified', 'deleted'))"


@query("remote_delta", _delta)
def remote_delta(v):
    cache = fx.cache(v)
    return sync.remote_delta(cache, fx.entries(v), inventory.dirty(cache))


@query("ignored_but_synced", f"SELECT path, CASE WHEN path LIKE 'es/src3/%' AND NOT regexp_matches(path, '^[^/]+/src1[^/]/[^/]*5\\.txt$') THEN 'es/src3/**' ELSE '*/src1?/*5.txt' END AS glob FROM ({_delta}) WHERE change = 'created' AND {fx.IGNORED}")
def ignored_but_synced(v):
    cache = fx.cache(v)
    return sync.ignored_but_synced(sync.remote_delta(cache, fx.entries(v), inventory.dirty(cache)), fx.IGNORE)


# ---- storage classes --------------------------------------------------------------------------


@query("path_class", fx.with_ctes(fx.V) + f"SELECT path, {fx.CLASS_NAME.format(fx.CLASS)} AS target_class FROM v")
def path_class(v):
    return v.select("path", storage.path_class(fx.POLICIES, fx.DEFAULT).alias("target_class"))


@query("path_class_joined", SQL["path_class"])
def path_class_joined(v):
    return storage.path_class_joined(v.select("path"), _policies(v))


_hash_class = fx.with_ctes(fx.V, fx.FOLDERS, fx.ENTRIES) + f"SELECT hash, {fx.CLASS_NAME.format(f'min({fx.CLASS})')} AS target_class, min({fx.CLASS}) <> max({fx.CLASS}) AS conflicted, count(*) AS n_paths, min({fx.CLASS}) AS cold FROM entries WHERE hash IS NOT NULL GROUP BY hash"


@query("hash_class", f"SELECT hash, target_class, conflicted, n_paths FROM ({_hash_class})")
def hash_class(v):
    return storage.hash_class(fx.entries(v), fx.POLICIES, fx.DEFAULT)


@query("hash_class_scoped", f"SELECT hash, target_class, conflicted, n_paths FROM ({_hash_class}) WHERE hash IN (SELECT md5(text) FROM documents WHERE doc_id % 10 <> 1 AND lang = 'en')")
def hash_class_scoped(v):
    return storage.hash_class(fx.entries(v), fx.POLICIES, fx.DEFAULT, scope="en/**")


@query("archive_status", fx.with_ctes(fx.V, fx.OBJECTS, fx.HEADS) + "SELECT hash, status FROM heads")
def archive_status(v):
    return fx.heads(fx.objects(v)).select("hash", storage.archive_status(F.col("storage_class"), F.col("restore"), _now()).alias("status"))


_plan_sql = f"""WITH want AS ({_hash_class}), h AS ({fx.with_ctes(fx.V, fx.OBJECTS, fx.HEADS)} SELECT heads.*, objects.size FROM objects LEFT JOIN heads USING (hash)), o AS ({fx.with_ctes(fx.V, fx.OBJECTS)} SELECT hash, size FROM objects)
SELECT want.hash, o.size, want.target_class, want.conflicted, CASE WHEN h.hash IS NOT NULL THEN coalesce(h.storage_class, 'STANDARD') END AS current_class, coalesce(h.status, 'missing') AS status,
 CASE WHEN h.hash IS NULL THEN 'missing' WHEN cur = cold THEN 'already-correct' WHEN cold > cur THEN 'immediate-copy' WHEN h.status = 'immediate' THEN 'already-correct' WHEN h.status IN ('needs-restore-request', 'restore-expired-needs-reissue') THEN 'needs-restore-request' WHEN h.status = 'restore-ongoing' THEN 'restore-ongoing' ELSE 'finalize-copy' END AS action
FROM want LEFT JOIN (SELECT *, CASE coalesce(storage_class, 'STANDARD') WHEN 'STANDARD' THEN 0 WHEN 'GLACIER' THEN 1 ELSE 2 END AS cur FROM h WHERE hash IS NOT NULL) h ON h.hash = want.hash JOIN o ON o.hash = want.hash"""


def _storage_plan(v):
    objects = fx.objects(v)
    return storage.storage_plan(fx.entries(v), objects, fx.heads(objects), fx.POLICIES, fx.DEFAULT, _now())


@query("storage_actions", _plan_sql)
def storage_actions(v):
    return _storage_plan(v)


@query("storage_summary", f"SELECT action, count(*) AS objects, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes, count(*) FILTER (conflicted) AS conflicted FROM ({_plan_sql}) GROUP BY action")
def storage_summary(v):
    return storage.storage_summary(_storage_plan(v))


# ---- checks -----------------------------------------------------------------------------------

_sanity = fx.with_ctes(fx.V, fx.FOLDERS, fx.ENTRIES, fx.OBJECTS, fx.HEADS, fx.LISTING) + f"""SELECT * FROM (SELECT CASE
  WHEN f.path IS NULL THEN 'missing_locally' WHEN e.path IS NULL THEN CASE WHEN {fx.IGNORED} THEN 'ignored' ELSE 'untracked' END WHEN e.type = 'dir' THEN NULL
  WHEN f.representation = 'both' THEN 'both_stub_and_real' WHEN f.hash IS DISTINCT FROM e.hash THEN CASE WHEN f.representation = 'stub' THEN 'stub_mismatch' ELSE 'hash_mismatch' END
  WHEN h.hash IS NULL THEN 'missing_in_s3' WHEN h.checksum <> o.ciphertext_checksum OR f.representation = 'real' AND f.checksum <> o.ciphertext_checksum THEN 'checksum_mismatch' END AS problem, path, e.hash
FROM listing f FULL JOIN entries e USING (path) LEFT JOIN objects o ON o.hash = e.hash LEFT JOIN heads h ON h.hash = e.hash) WHERE problem IS NOT NULL"""


def _sanity_check(v):
    objects = fx.objects(v)
    return checks.sanity_check(fx.listing(v), fx.entries(v), objects, fx.heads(objects), fx.IGNORE)


@query("sanity_check", _sanity)
def sanity_check(v):
    return _sanity_check(v)


@query("sanity_summary", "SELECT count(*) FILTER (problem <> 'ignored') AS problems, " + ", ".join(f"count(*) FILTER (problem = '{p}') AS {p}" for p in checks.PROBLEMS) + f" FROM ({_sanity})")
def sanity_summary(v):
    return checks.sanity_summary(_sanity_check(v))


_mirror = fx.with_ctes(fx.V, fx.FOLDERS, fx.ENTRIES, fx.CACHE, fx.LISTING, fx.OBJECTS, fx.HEADS, fx.MIRROR)


@query("mirror_verify", _mirror + f"SELECT o.hash, CASE WHEN m.hash IS NULL THEN 'missing' WHEN m.size <> (50 + o.size + CAST(ceil(o.size / 4194304.0) AS BIGINT) * 16) THEN 'wrong_size' WHEN m.checksum <> o.ciphertext_checksum THEN 'checksum_mismatch' ELSE 'ok' END AS verdict FROM objects o LEFT JOIN mirror m ON o.hash = m.hash")
def mirror_verify(v):
    objects = fx.objects(v)
    return checks.mirror_verify(objects, fx.mirror(objects))


@query("mirror_extra", _mirror + "SELECT hash, size FROM mirror WHERE hash NOT IN (SELECT hash FROM objects)")
def mirror_extra(v):
    objects = fx.objects(v)
    return checks.mirror_extra(fx.mirror(objects), objects).select("hash", "size")


_catchup = _mirror + """SELECT o.hash, CASE WHEN m.size = (50 + o.size + CAST(ceil(o.size / 4194304.0) AS BIGINT) * 16) THEN 'already_present' WHEN s.source IS NOT NULL THEN 'recovered' WHEN h.hash IS NULL THEN 'unrecoverable'
  WHEN h.status IN ('immediate', 'restore-ready') THEN CASE WHEN h.intact THEN 'downloaded' ELSE 'unrecoverable' END WHEN h.status = 'restore-ongoing' THEN 'restore_pending' ELSE 'archived_not_requested' END AS step, s.source AS src
FROM objects o LEFT JOIN mirror m ON m.hash = o.hash LEFT JOIN heads h ON h.hash = o.hash LEFT JOIN (
  SELECT e.hash, min(e.path) AS source FROM entries e JOIN cache c ON c.path = e.path AND c.hash = e.hash JOIN listing f ON f.path = e.path JOIN objects x ON x.hash = e.hash AND x.size = c.size WHERE c.state = 'unchanged' AND f.representation <> 'stub' GROUP BY e.hash) s ON s.hash = o.hash"""


def _catchup_steps(v):
    objects = fx.objects(v)
    sources = checks.local_sources(objects, fx.entries(v), fx.cache(v), fx.listing(v))
    return checks.mirror_catchup(objects, fx.mirror(objects), sources, fx.heads(objects), _now(), allow_download=True, request_retrieval=False)


@query("mirror_catchup", f"SELECT hash, step, CASE WHEN step = 'recovered' THEN src END AS source FROM ({_catchup})")
def mirror_catchup(v):
    return _catchup_steps(v)


_steps = ("already_present", "recovered", "downloaded", "restore_pending", "restore_requested", "archived_not_requested", "unrecoverable")


@query("catchup_summary", "SELECT " + ", ".join(f"count(*) FILTER (step = '{s}') AS {s}" for s in _steps) + f", count(*) FILTER (step = 'unrecoverable') = 0 AS pointer_moves FROM ({_catchup})")
def catchup_summary(v):
    return checks.catchup_summary(_catchup_steps(v))


_materialize = fx.with_ctes(fx.V, fx.FOLDERS, fx.ENTRIES, fx.LISTING, fx.OBJECTS, fx.HEADS) + "SELECT e.path, CASE WHEN f.representation IS NULL OR f.representation <> 'stub' THEN 'already_real' WHEN h.hash IS NULL THEN 'missing' WHEN h.status IN ('immediate', 'restore-ready') THEN 'materialize' WHEN h.status = 'restore-ongoing' THEN 'restore_pending' ELSE 'needs_restore' END AS step, e.size FROM entries e LEFT JOIN listing f ON f.path = e.path LEFT JOIN heads h ON h.hash = e.hash WHERE e.type = 'file'"


def _materialize_plan(v):
    return checks.materialize_plan(fx.entries(v), fx.listing(v), fx.heads(fx.objects(v)), _now())


@query("materialize_plan", f"SELECT path, step FROM ({_materialize})")
def materialize_plan(v):
    return _materialize_plan(v)


@query("materialize_estimate", f"SELECT count(*) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM ({_materialize}) WHERE step = 'materialize'")
def materialize_estimate(v):
    return checks.work_estimate(_materialize_plan(v), fx.entries(v), "materialize")


_stubify = _mirror + "SELECT c.path, CASE WHEN f.path IS NULL THEN 'already_stub' WHEN c.state <> 'unchanged' THEN 'skip_pending_changes' WHEN NOT EXISTS (SELECT 1 FROM mirror m WHERE m.hash = c.hash AND m.size = 50 + c.size + CAST(ceil(c.size / 4194304.0) AS BIGINT) * 16) THEN 'skip_not_mirrored' WHEN f.mtime = c.mtime OR f.hash = c.hash THEN 'stubify' ELSE 'skip_changed' END AS step FROM cache c LEFT JOIN (SELECT * FROM listing WHERE representation <> 'stub') f ON f.path = c.path"


def _stubify_plan(v):
    return checks.stubify_plan(fx.cache(v), fx.listing(v), fx.mirror(fx.objects(v)))


@query("stubify_plan", _stubify)
def stubify_plan(v):
    return _stubify_plan(v)


@query("stubify_summary", f"SELECT step, count(*) AS files FROM ({_stubify}) GROUP BY step")
def stubify_summary(v):
    return checks.step_summary(_stubify_plan(v))


@query("needs_hash", _scan + "SELECT f.path, f.type = 'file' AND f.representation <> 'stub' AND NOT (coalesce(f.mtime = c.mtime, false) AND f.representation <> 'both') AS needed FROM listing f LEFT JOIN cache c ON c.path = f.path")
def needs_hash(v):
    return fx.listing(v).alias("fs").join(fx.cache(v).alias("c"), F.col("fs.path") == F.col("c.path"), "left").select("fs.path", changes.needs_hash().alias("needed"))


@query("scan_estimate", _scan + "SELECT count(*) AS paths, count(*) FILTER (need) AS files, CAST(coalesce(sum(CASE WHEN need THEN size END), 0) AS BIGINT) AS bytes FROM (SELECT coalesce(f.type = 'file' AND f.representation <> 'stub' AND NOT (coalesce(f.mtime = c.mtime, false) AND f.representation <> 'both'), false) AS need, f.size FROM listing f FULL JOIN cache c USING (path))")
def scan_estimate(v):
    return changes.scan_estimate(fx.listing(v), fx.cache(v))


@query("remote_summary", "SELECT " + ", ".join(f"count(*) FILTER (change = '{k}') AS {k}" for k in ("created", "modified", "deleted")) + f" FROM ({_delta})")
def remote_summary(v):
    cache = fx.cache(v)
    return sync.remote_summary(sync.remote_delta(cache, fx.entries(v), inventory.dirty(cache)))


@query("verify_summary", _mirror + ", t AS (SELECT CASE WHEN m.hash IS NULL THEN 'missing' WHEN m.size <> (50 + o.size + CAST(ceil(o.size / 4194304.0) AS BIGINT) * 16) THEN 'wrong_size' WHEN m.checksum <> o.ciphertext_checksum THEN 'checksum_mismatch' ELSE 'ok' END AS verdict FROM objects o LEFT JOIN mirror m ON o.hash = m.hash) SELECT count(*) FILTER (verdict = 'missing') AS missing, count(*) FILTER (verdict = 'wrong_size') AS wrong_size, count(*) FILTER (verdict = 'checksum_mismatch') AS checksum_mismatch, (SELECT count(*) FROM mirror WHERE hash NOT IN (SELECT hash FROM objects)) AS extra, count(*) FILTER (verdict <> 'ok') = 0 AS ok FROM t")
def verify_summary(v):
    objects = fx.objects(v)
    mirror = fx.mirror(objects)
    return checks.verify_summary(checks.mirror_verify(objects, mirror), checks.mirror_extra(mirror, objects))


# ---- derived files ----------------------------------------------------------------------------

_derived = fx.with_ctes(fx.V, r"""files AS (SELECT doc_id, path AS original, CASE WHEN doc_id % 3 = 0 THEN md5(hash) ELSE hash END AS has, CASE doc_id % 5 WHEN 0 THEN 'p2-small-ss100-fmtimage_png-pl6' WHEN 1 THEN 'p2-big-iw800-ih600-fmtimage_jpeg-q80' WHEN 2 THEN 'p1-small-ss64' WHEN 3 THEN 'p2-other-ss1' ELSE 'odd' END AS full_params, CASE WHEN doc_id % 5 = 1 THEN 'jpg' ELSE 'png' END AS ext, unnest(CASE WHEN doc_id % 7 = 0 THEN [0, 1] ELSE [0] END) AS copy, hash AS source_hash FROM v WHERE doc_id % 6 <> 5),
parsed AS (SELECT *, CASE WHEN copy = 0 THEN full_params ELSE replace(replace(full_params, 'ss100', 'ss1'), 'iw800', 'ss1') END AS params, split_part(full_params, '-', 2) AS policy, regexp_extract(original, '^(.*)/[^/]*$', 1) || '/_thumbnail/' || regexp_extract(original, '([^/]*)$', 1) || '.' || params || '.' || has || '.' || ext AS path FROM files WHERE full_params <> 'odd')""")  # fmt: skip


@query("derived_parse", _derived + "SELECT path, original AS original_path, params, policy, has AS hash, ext FROM parsed")
def derived_parse(v):
    return derived.parse_names(fx.derived(v))


def _sources(v):
    mime = F.when(F.col("doc_id") % 2 == 0, "text/plain").otherwise("text/html")
    return v.where("doc_id % 8 <> 7").select("path", F.when(F.col("doc_id") % 17 != 3, F.col("hash")).alias("hash"), mime.alias("mime_type"), (F.col("doc_id") % 19 != 4).alias("readable"))


_resolved = "SELECT path, 'small' AS policy, 'p2-small-ss100-fmtimage_png-pl6' AS params, 'png' AS ext FROM v WHERE doc_id % 8 <> 7 UNION ALL SELECT path, 'big', 'p2-big-iw800-ih600-fmtimage_jpeg-q80', 'jpg' FROM v WHERE doc_id % 8 <> 7 AND doc_id % 2 = 0 AND (path LIKE 'en/%' OR path LIKE 'fr/%')"


@query("derived_resolve", fx.with_ctes(fx.V) + _resolved)
def derived_resolve(v):
    return derived.resolve(_sources(v), _generate(v))


def _with_skips(v):
    skip = v.sparkSession.createDataFrame([{"id": 3, "name": "off", "glob": "*/src1/**", "action": "skip"}], schemas.THUMBNAIL_POLICIES)
    return _generate(v).unionByName(skip)


@query("derived_resolve_skips", fx.with_ctes(fx.V) + f"SELECT * FROM ({_resolved}) WHERE NOT regexp_matches(path, '^[^/]+/src1/.+$')")
def derived_resolve_skips(v):
    return derived.resolve(_sources(v), _with_skips(v))


_derived_plan = _derived + f""", wanted AS ({_resolved}), src AS (SELECT path AS original, CASE WHEN doc_id % 17 <> 3 THEN hash END AS h FROM v WHERE doc_id % 8 <> 7 AND doc_id % 19 <> 4),
held AS (SELECT p.original, p.policy, p.path, w.path IS NOT NULL AS asked, coalesce(p.has = s.h AND p.params = w.params AND p.ext = w.ext, false) AS exact FROM parsed p JOIN src s ON s.original = p.original LEFT JOIN wanted w ON w.path = p.original AND w.policy = p.policy WHERE s.h IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY original, policy ORDER BY exact DESC, path) AS nth FROM held)
SELECT original AS original_path, policy, path, CASE WHEN NOT asked OR nth > 1 THEN 'delete' WHEN exact THEN 'up_to_date' ELSE 'regenerate' END AS step FROM ranked
UNION ALL SELECT s.original, w.policy, regexp_extract(s.original, '^(.*)/[^/]*$', 1) || '/_thumbnail/' || regexp_extract(s.original, '([^/]*)$', 1) || '.' || w.params || '.' || s.h || '.' || w.ext, 'generate' FROM src s JOIN wanted w ON w.path = s.original WHERE s.h IS NOT NULL AND NOT EXISTS (SELECT 1 FROM parsed p WHERE p.original = s.original AND p.policy = w.policy)
UNION ALL SELECT original, NULL, NULL, 'missing_cache_entry' FROM src WHERE h IS NULL"""


@query("derived_plan", _derived_plan)
def derived_plan(v):
    sources = _sources(v)
    return derived.reconcile(sources, derived.resolve(sources, _generate(v)), derived.parse_names(fx.derived(v)))


@query("derived_plan_skips", f"SELECT * FROM ({_derived_plan}) WHERE NOT regexp_matches(original_path, '^[^/]+/src1/.+$') UNION ALL " + _derived.replace("WITH v AS", "SELECT * FROM (WITH v AS", 1) + "SELECT original, policy, path, 'delete' FROM parsed JOIN (SELECT path AS source FROM v WHERE doc_id % 8 <> 7) ON source = original WHERE regexp_matches(original, '^[^/]+/src1/.+$'))")
def derived_plan_skips(v):
    sources, rules = _sources(v), _with_skips(v)
    return derived.reconcile(sources, derived.resolve(sources, rules), derived.parse_names(fx.derived(v)), derived.skipped(sources, rules))


@query("derived_stub_previews", _derived + """, s AS (SELECT path AS original, CASE WHEN doc_id % 17 <> 3 THEN hash END AS h FROM v WHERE doc_id % 4 = 0),
r AS (SELECT s.original, s.h, p.path, coalesce(p.has = s.h, false) AS same FROM s LEFT JOIN parsed p USING (original)), k AS (SELECT *, row_number() OVER (PARTITION BY original ORDER BY same DESC, path) AS nth, bool_or(same) OVER (PARTITION BY original) AS any_same FROM r)
SELECT original AS original_path, CASE WHEN h IS NOT NULL THEN path END AS path, CASE WHEN h IS NULL THEN 'missing_cache_entry' WHEN path IS NULL THEN 'stub_without_preview' WHEN any_same THEN CASE WHEN nth = 1 THEN 'preserved' ELSE 'delete' END ELSE 'stale_preview' END AS step FROM k WHERE h IS NOT NULL OR nth = 1""")
def derived_stub_previews(v):
    stubs = v.where("doc_id % 4 = 0").select("path", F.when(F.col("doc_id") % 17 != 3, F.col("hash")).alias("hash"))
    return derived.stub_previews(stubs, derived.parse_names(fx.derived(v)))


@query("derived_orphans", _derived + f"SELECT path FROM parsed WHERE original NOT IN (SELECT path FROM v WHERE doc_id % 8 <> 7 AND (path LIKE 'en/%' OR path LIKE 'fr/%') AND NOT {fx.IGNORED})")
def derived_orphans(v):
    return derived.orphans(derived.parse_names(fx.derived(v)), _sources(v), ["{en,fr}/**"], fx.IGNORE).select("path")


@query("derived_summary", f"SELECT step, count(*) AS files FROM ({_derived_plan}) GROUP BY step")
def derived_summary(v):
    sources = _sources(v)
    return derived.summary(derived.reconcile(sources, derived.resolve(sources, _generate(v)), derived.parse_names(fx.derived(v))))


# ---- scalars ----------------------------------------------------------------------------------

_dims = "SELECT doc_id, doc_id % 97 + 1 AS w, doc_id % 41 + 1 AS h FROM documents"
_scale = "CASE WHEN greatest(w, h) / least(w, h) > 2 * (100 / 60) THEN 60 / least(w, h) ELSE least((CASE WHEN w >= h THEN 100 ELSE 60 END) / w, (CASE WHEN w >= h THEN 60 ELSE 100 END) / h) END"


@query("fit_sizes", f"SELECT doc_id, CAST(greatest(1, floor(w * s + 0.5)) AS BIGINT) AS box_width, CAST(greatest(1, floor(h * s + 0.5)) AS BIGINT) AS box_height, CAST(greatest(1, floor(w * t + 0.5)) AS BIGINT) AS side_width, CAST(greatest(1, floor(h * t + 0.5)) AS BIGINT) AS side_height FROM (SELECT *, {_scale} AS s, 32 / least(w, h) AS t FROM ({_dims}))")
def fit_sizes(v):
    w, h = F.col("doc_id") % 97 + 1, F.col("doc_id") % 41 + 1
    box, side = scalars.contain_fit(w, h, F.lit(100), F.lit(60)), scalars.shorter_side_fit(w, h, 32)
    return v.select("doc_id", box["width"].alias("box_width"), box["height"].alias("box_height"), side["width"].alias("side_width"), side["height"].alias("side_height"))


@query("encrypted_sizes", fx.with_ctes(fx.V) + "SELECT path, 50 + n + CAST(ceil(n / 4194304.0) AS BIGINT) * 16 AS encrypted, CAST(ceil(n / 4194304.0) AS BIGINT) AS chunks, greatest(5242880, CAST(ceil(n / 10000.0) AS BIGINT)) AS upload_part, greatest(536870912, CAST(ceil(n / 10000.0) AS BIGINT)) AS copy_part FROM (SELECT path, size * 100000 AS n FROM v)")
def encrypted_sizes(v):
    n = F.col("size") * 100_000
    return v.select("path", scalars.encrypted_size(n).alias("encrypted"), scalars.chunk_count(n).cast("long").alias("chunks"), scalars.multipart_part_size(n).alias("upload_part"), scalars.copy_part_size(n).alias("copy_part"))


@query("copy_ranges", fx.with_ctes(fx.V) + "SELECT path, k + 1 AS part_number, k * 1000 AS start, least((k + 1) * 1000, size) - 1 AS \"end\" FROM (SELECT *, unnest(range(0, CAST(ceil(size / 1000.0) AS BIGINT))) AS k FROM v)")
def copy_ranges(v):
    return v.select("path", F.inline(scalars.byte_ranges("size", 1000)))


@query("object_keys", fx.with_ctes(fx.V) + "SELECT path, 'objects/' || substr(hash, 1, 2) || '/' || substr(hash, 3, 2) || '/' || hash AS object_key, 'root/objects/' || substr(hash, 1, 2) || '/' || substr(hash, 3, 2) || '/' || hash AS remote_key, 'blake2b:' || hash AS tagged, path || '.stub' AS stub, lower(path) AS collision_key FROM v")
def object_keys(v):
    key = scalars.object_key("hash")
    return v.select("path", key.alias("object_key"), scalars.remote_key(F.lit("/root/"), key).alias("remote_key"), scalars.tagged_hash("hash").alias("tagged"), scalars.stub_path("path").alias("stub"), scalars.collision_key("path").alias("collision_key"))


@query("sample_times", "SELECT doc_id, k, n_chars * (k + 0.5) / 4 AS seconds, k % 2 * 64 AS x, k // 2 * 48 AS y FROM (SELECT doc_id, n_chars, unnest([0, 1, 2, 3]) AS k FROM documents)")
def sample_times(v):
    both = F.arrays_zip(F.sequence(F.lit(0), F.lit(3)).alias("k"), scalars.sample_times(F.col("size").cast("double"), 4).alias("seconds"), scalars.tile_offsets(4, 2, 64, 48).alias("at"))
    return v.select("doc_id", F.inline(both)).select("doc_id", "k", "seconds", F.col("at.x").alias("x"), F.col("at.y").cast("int").alias("y"))


@query("constraint_violations", _both + "SELECT path, 'unknown_object' AS problem FROM entries WHERE hash IS NOT NULL AND hash NOT IN (SELECT hash FROM v WHERE doc_id % 3 <> 0) UNION ALL SELECT path, 'live_file_without_content' FROM cache WHERE FALSE")
def constraint_violations(v):
    found = schemas.validate_entries(fx.entries(v), fx.objects(v.where("doc_id % 3 <> 0")))
    return found.unionByName(schemas.validate_cache(fx.cache(v)))


# ---- trees, ranges, whole plans ---------------------------------------------------------------


@query("glob_scan_folder", _entries + "SELECT path, hash FROM entries WHERE regexp_matches(path, '^en/src1[0-9]/doc[^/]*[02468]\\.txt$')")
def glob_scan_folder(v):
    return inventory.glob_scan(fx.entries(v), "en/src1[0-9]/doc*[02468].txt").select("path", "hash")


@query("glob_scan_alternatives", _entries + "SELECT path, hash FROM entries WHERE regexp_matches(path, '^(en|fr)/src(1|2|3)/[^/]+$')")
def glob_scan_alternatives(v):
    return inventory.glob_scan(fx.entries(v), "{en,fr}/src{1,2,3}/*").select("path", "hash")


@query("ignored_but_synced_at_first", fx.with_ctes(fx.V, fx.FOLDERS, fx.ENTRIES) + f"SELECT path, CASE WHEN regexp_matches(path, '^[^/]+/src1[^/]/[^/]*5\\.txt$') THEN '*/src1?/*5.txt' ELSE 'es/src3/**' END AS glob FROM entries WHERE {fx.IGNORED}")
def ignored_but_synced_at_first(v):
    """A machine that has nothing yet gets everything, and is told what an ignore policy names."""
    nothing = fx.cache(v).where("false")
    return sync.ignored_but_synced(sync.remote_delta(nothing, fx.entries(v), nothing), fx.IGNORE)


@query("listing_fold", fx.with_ctes(fx.V, fx.FOLDERS, fx.RAW) + """SELECT path, CASE WHEN bool_or(dir) THEN 'dir' ELSE 'file' END AS type, CASE WHEN bool_or(dir) OR NOT bool_or(stub) THEN 'real' WHEN bool_or(NOT stub) THEN 'both' ELSE 'stub' END AS representation, arg_min(mtime_ms, stub) AS mtime_ms, arg_min(size, stub) AS size
FROM (SELECT CASE WHEN type = 'file' AND path LIKE '%.stub' THEN left(path, length(path) - 5) ELSE path END AS path, type = 'dir' AS dir, type = 'file' AND path LIKE '%.stub' AS stub, mtime_ms, size FROM raw WHERE path NOT LIKE '%/.x-tmp-%') GROUP BY path""")
def listing_fold(v):
    return tree.fold(fx.raw_tree(v))


@query("listing_temporary", fx.with_ctes(fx.V, fx.FOLDERS, fx.RAW) + "SELECT path, size FROM raw WHERE path LIKE '%/.x-tmp-%'")
def listing_temporary(v):
    return tree.temporary(fx.raw_tree(v)).select("path", "size")


@query("chunk_ranges", fx.with_ctes(fx.V) + """SELECT doc_id, k AS chunk, 50 + k * 1016 AS start, 50 + k * 1016 + least(1000, size - k * 1000) + 16 AS end, greatest(300 - k * 1000, 0) AS plain_start, least(least(size, 2300) - k * 1000, 1000) - greatest(300 - k * 1000, 0) AS plain_length
FROM (SELECT doc_id, size, unnest(range(0, CAST(ceil(least(size, 2300) / 1000.0) AS BIGINT))) AS k FROM v WHERE size > 300)""")
def chunk_ranges(v):
    """The chunks that hold bytes 300 to 2,299 of each content."""
    return v.select("doc_id", F.explode(scalars.chunk_ranges("size", chunk=1000, start=300, length=2000)).alias("r")).select("doc_id", "r.*")


_remote = _both + r""", delta AS (SELECT path, c.type AS own, e.type AS new, CASE WHEN c.path IS NULL THEN 'created' WHEN e.path IS NULL THEN 'deleted' ELSE 'modified' END AS change, e.hash, e.state_version FROM cache c FULL JOIN (SELECT * FROM entries WHERE path NOT LIKE 'en/src1%') e USING (path) WHERE (c.path IS NULL OR e.path IS NULL OR c.hash IS DISTINCT FROM e.hash) AND path NOT IN (SELECT path FROM cache WHERE state <> 'unchanged')),
stays AS (SELECT path FROM cache WHERE path NOT IN (SELECT path FROM delta WHERE change = 'deleted') UNION SELECT path FROM delta WHERE change <> 'deleted'),
up AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:n], '/') AS path FROM (SELECT path, unnest(range(1, len(string_split(path, '/')))) AS n FROM delta WHERE change <> 'deleted'))
SELECT CASE WHEN change = 'deleted' THEN -len(string_split(path, '/')) ELSE CASE WHEN new = 'dir' THEN len(string_split(path, '/')) ELSE 2147483647 END END AS step, path, change, coalesce(new, own) AS type,
  CASE WHEN change = 'deleted' THEN 'remove' WHEN new = 'dir' THEN 'make_dir' WHEN change = 'created' OR path IN (SELECT path FROM v WHERE doc_id % 4 = 0) THEN 'write_stub' ELSE 'download' END AS action, hash, state_version FROM delta
UNION ALL SELECT len(string_split(path, '/')), path, 'implied', 'dir', 'make_dir', NULL, NULL FROM up WHERE path NOT IN (SELECT path FROM entries WHERE type = 'dir' AND path NOT LIKE 'en/src1%')"""


@query("remote_apply_plan", _remote)
def remote_apply_plan(v):
    cache, candidate = fx.cache(v), fx.entries(v).where("path NOT LIKE 'en/src1%'")
    return sync.remote_apply_plan(sync.remote_delta(cache, candidate, inventory.dirty(cache)), cache, candidate, v.where("doc_id % 4 = 0").select("path"))


def _tree_plan(v):
    kind = F.when(F.col("doc_id") % 4 == 0, "stub").when(F.col("doc_id") % 4 == 1, "both").otherwise("real")
    sources = v.where("doc_id % 8 <> 7").select("path", F.when(F.col("doc_id") % 17 != 3, F.col("hash")).alias("hash"), kind.alias("representation"))
    mime = v.select("path", F.when(F.col("doc_id") % 2 == 0, "text/plain").otherwise("text/html").alias("mime_type"), (F.col("doc_id") % 19 != 4).alias("readable"))
    return derived.plan(sources, _with_skips(v), derived.parse_names(fx.derived(v)), lambda rows: rows.join(mime, "path"), ignore=fx.IGNORE)


_tree = _derived + f""", wanted AS ({_resolved}), s AS (SELECT doc_id, path AS original, CASE WHEN doc_id % 17 <> 3 THEN hash END AS h, CASE WHEN doc_id % 4 = 0 THEN 'stub' WHEN regexp_matches(path, '^[^/]+/src1/.+$') THEN 'skip' ELSE 'probe' END AS lane FROM v WHERE doc_id % 8 <> 7 AND NOT {fx.IGNORED}),
src AS (SELECT original, h FROM s WHERE lane = 'probe' AND doc_id % 19 <> 4),
held AS (SELECT p.original, p.policy, p.path, w.path IS NOT NULL AS asked, coalesce(p.has = s.h AND p.params = w.params AND p.ext = w.ext, false) AS exact FROM parsed p JOIN src s ON s.original = p.original LEFT JOIN wanted w ON w.path = p.original AND w.policy = p.policy WHERE s.h IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY original, policy ORDER BY exact DESC, path) AS nth FROM held),
r AS (SELECT s.original, s.h, p.path, coalesce(p.has = s.h, false) AS same FROM s LEFT JOIN parsed p USING (original) WHERE lane = 'stub'), k AS (SELECT *, row_number() OVER (PARTITION BY original ORDER BY same DESC, path) AS nth, bool_or(same) OVER (PARTITION BY original) AS any_same FROM r)
SELECT original AS original_path, policy, path, CASE WHEN NOT asked OR nth > 1 THEN 'delete' WHEN exact THEN 'up_to_date' ELSE 'regenerate' END AS step FROM ranked
UNION ALL SELECT s.original, w.policy, regexp_extract(s.original, '^(.*)/[^/]*$', 1) || '/_thumbnail/' || regexp_extract(s.original, '([^/]*)$', 1) || '.' || w.params || '.' || s.h || '.' || w.ext, 'generate' FROM src s JOIN wanted w ON w.path = s.original WHERE s.h IS NOT NULL AND NOT EXISTS (SELECT 1 FROM parsed p WHERE p.original = s.original AND p.policy = w.policy)
UNION ALL SELECT original, NULL, NULL, 'missing_cache_entry' FROM src WHERE h IS NULL
UNION ALL SELECT original, NULL, NULL, 'unreadable' FROM s WHERE lane = 'probe' AND doc_id % 19 = 4
UNION ALL SELECT original, policy, path, 'delete' FROM parsed JOIN s USING (original) WHERE lane = 'skip'
UNION ALL SELECT original, NULL, CASE WHEN h IS NOT NULL THEN path END, CASE WHEN h IS NULL THEN 'missing_cache_entry' WHEN path IS NULL THEN 'stub_without_preview' WHEN any_same THEN CASE WHEN nth = 1 THEN 'preserved' ELSE 'delete' END ELSE 'stale_preview' END FROM k WHERE h IS NOT NULL OR nth = 1
UNION ALL SELECT original, policy, path, 'delete' FROM parsed WHERE original NOT IN (SELECT original FROM s)"""


@query("derived_tree_plan", _tree)
def derived_tree_plan(v):
    return _tree_plan(v)


@query("derived_counters", "SELECT *, errors = 0 AND stale_stub_previews = 0 AS ok, CAST(CASE WHEN errors = 0 AND stale_stub_previews = 0 THEN 0 ELSE 1 END AS BIGINT) AS status_code FROM (SELECT " + ", ".join(f"count(*) FILTER (step = '{step}') AS {name}" for name, step in derived.COUNTERS.items()) + f", count(DISTINCT CASE WHEN step = 'preserved' THEN original_path END) AS stubbed_preserved, count(DISTINCT CASE WHEN step = 'stale_preview' THEN original_path END) AS stale_stub_previews FROM ({_tree}))")
def derived_counters(v):
    return derived.counters(_tree_plan(v))


def _content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    raw = F.col("text").cast("binary")
    return docs.select("doc_id", blake2b_256(raw).alias("blake2b"), crc64nvme(raw).alias("crc64nvme"))


QUERIES["content_hash"] = _content_hash


def _commit_cas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects after garbage collection as a commit of a snapshot store in the shared folder."""
    v = fx.documents(spark, sf_dir)
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = f"{shared}/store-{uuid.uuid4().hex}"
    store = SnapshotStore.init(spark, root, {"objects": fx.objects(v), "entries": fx.entries_gc(v)})
    store.mutate(lambda now: {"objects": gc.collect_garbage(now["objects"], now["entries"])[0]})
    return store.read("objects").select("hash", "size")


QUERIES["commit_cas"], SQL["commit_cas"] = _commit_cas, SQL["collect_garbage"]
