"""Decision tables and rules, case by case."""

import itertools

import pytest
from pyspark.sql import functions as F

from stocktake import schemas
from stocktake.functions import globs
from stocktake.operators import changes, checks, derived, gc, inventory, policies, storage, sync
from stocktake.plans import fixtures as fx


def table(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


ENTRY = "path string, type string, hash string, state_version string, normalized_path string"
CACHE = "path string, type string, mtime long, hash string, size long, state string, parent_state_version string"


def entry(path, digest="h", version="v1", kind="file"):
    return (path, kind, digest, version, path.lower())


def local(path, state, digest="h", parent="v1", kind="file", mtime=1, size=1):
    return (path, kind, mtime, digest, size, state, parent)


def test_conflict_matrix(spark):
    cases = {
        ("created", None): "apply", ("created", "same"): "noop", ("created", "other"): "conflict",
        ("modified", None): "conflict", ("modified", "parent"): "apply", ("modified", "same"): "noop", ("modified", "other"): "conflict",
        ("deleted", None): "noop", ("deleted", "parent"): "apply", ("deleted", "other"): "conflict", ("unchanged", None): "error",
    }
    dirty, entries = [], []
    for i, (state, there) in enumerate(cases):
        dirty.append(local(f"p{i}", state))
        if there:
            entries.append(entry(f"p{i}", "h" if there == "same" else "x", "v1" if there == "parent" else "v2"))
    got = sync.decide(table(spark, dirty, CACHE), table(spark, entries, ENTRY)).collect()
    assert {int(r.path[1:]): r.decision for r in got} == dict(enumerate(cases.values()))


def test_folders_are_never_modified(spark):
    dirty = table(spark, [local("d", "created", None, kind="dir")], CACHE)
    assert sync.decide(dirty, table(spark, [entry("d", None, kind="dir")], ENTRY)).first().decision == "noop"


def plan(spark, dirty, entries, objects=()):
    rows = sync.plan_sync(table(spark, dirty, CACHE), table(spark, entries, ENTRY), table(spark, [(h,) for h in objects], "hash string"), "v9").collect()
    return {r.path: (r.decision, r.reason, r.upload, r.stamp) for r in rows}


def test_case_only_rename_passes(spark):
    got = plan(spark, [local("a.txt", "deleted"), local("A.txt", "created")], [entry("a.txt")], ["h"])
    assert got == {"a.txt": ("apply", None, None, None), "A.txt": ("apply", None, "dedup", "v9")}


def test_case_collisions(spark):
    got = plan(spark, [local("b.txt", "created", "n1"), local("B.txt", "created", "n2"), local("C.txt", "created")], [entry("c.txt")])
    assert got["B.txt"] == ("apply", None, "upload", "v9")
    assert got["b.txt"][:3] == ("conflict", "case_collision", None)
    assert got["C.txt"][:2] == ("conflict", "case_collision")


def test_first_claim_uploads(spark):
    got = plan(spark, [local("x", "created", "n"), local("y", "created", "n"), local("z", "created", "k")], [], ["k"])
    assert [got[p][2] for p in "xyz"] == ["upload", "attach", "dedup"]


def test_apply_then_diff_is_empty(spark):
    dirty, entries = table(spark, [local("x", "created", "n"), local("y", "deleted"), local("z", "modified", "m")], CACHE), table(spark, [entry("y"), entry("z")], ENTRY)
    p = sync.plan_sync(dirty, entries, table(spark, [], "hash string"), "v9")
    after, cache = sync.apply_sync(entries, p), sync.reconcile(dirty, p)
    assert {r.path: r.hash for r in after.collect()} == {"x": "n", "z": "m"}
    assert inventory.dirty(cache).isEmpty() and sync.unstamped(p).isEmpty()
    assert sync.remote_delta(cache, after, inventory.dirty(cache)).isEmpty()


LIST = "path string, type string, representation string, mtime_ms double, size long, hash string"


@pytest.mark.parametrize(("listed", "known", "outcome", "state"), [
    (("file", "real", 5.0, "n"), None, "created", "created"),
    (None, "deleted", "gone", "deleted"),
    (None, "unchanged", "deleted", "deleted"),
    (("dir", "real", 0.0, None), "deleted", "created", "created"),
    (("dir", "real", 0.0, None), "unchanged", "unchanged", "unchanged"),
    (("file", "real", 1.2, "n"), "unchanged", "unchanged", "unchanged"),
    (("file", "real", 1.2, "n"), "modified", "unchanged", "modified"),
    (("file", "both", 1.2, "n"), "unchanged", "modified", "modified"),
    (("file", "real", 5.0, "h"), "created", "unchanged", "created"),
    (("file", "real", 5.0, "n"), "unchanged", "modified", "modified"),
    (("file", "real", 5.0, "n"), "deleted", "created", "created"),
    (("file", "real", 5.0, "n"), "modified", "modified", "modified"),
])
def test_scan(spark, listed, known, outcome, state):
    listing = table(spark, [("p", *listed[:3], 7, listed[3])] if listed else [], LIST)
    cache = table(spark, [local("p", known)] if known else [], CACHE)
    got = changes.scan_changes(listing, cache, "v5").first()
    assert (got.outcome, got.state) == (outcome, state)
    assert got.parent_state_version == ("v1" if known else "v5")


def test_scan_ignore(spark):
    listing = table(spark, [("t/a", "file", "real", 5.0, 7, "n"), ("t/b", "file", "real", 5.0, 7, "n")], LIST)
    got = {r.path: (r.outcome, r.state) for r in changes.scan_changes(listing, table(spark, [local("t/b", "created")], CACHE), "v5", ["t/*"]).collect()}
    assert got == {"t/a": ("ignored", None), "t/b": ("dropped", None)}


def test_same_content_takes_the_new_time(spark):
    listing = table(spark, [("p", "file", "real", 8.5, 7, "h")], LIST)
    got = changes.scan_changes(listing, table(spark, [local("p", "unchanged")], CACHE), "v5").first()
    assert (got.outcome, got.mtime, got.state) == ("unchanged", 9, "unchanged")


def test_fold_listing(spark):
    files = table(spark, [("a", "file", 1.0, 5), ("a.stub", "file", 2.0, 9), ("b.stub", "file", 3.0, 9), ("c", "file", 4.0, 6)], "path string, type string, mtime_ms double, size long")
    got = {r.path: (r.representation, r.mtime_ms, r.size) for r in changes.fold_listing(files).collect()}
    assert got == {"a": ("both", 1.0, 5), "b": ("stub", 3.0, 9), "c": ("real", 4.0, 6)}


def test_staged_collisions(spark):
    staged = table(spark, [("a", "created"), ("A", "created"), ("b", "created"), ("C", "created"), ("c", "deleted")], "path string, state string")
    durable = table(spark, [("B", "unchanged"), ("c", "unchanged"), ("a", "deleted")], "path string, state string")
    got = {r.path: (r.other, r.source) for r in changes.staged_collisions(staged, durable).collect()}
    assert got == {"a": ("A", "batch"), "A": ("a", "batch"), "b": ("B", "durable")}
    assert {r.path for r in changes.applicable(staged, changes.staged_collisions(staged, durable)).collect()} == {"C", "c"}


def test_dirty_order(spark):
    rows = [("FILE.txt", "created"), ("aaa.txt", "deleted"), ("file.txt", "deleted"), ("zzz.txt", "modified"), ("same", "unchanged")]
    assert [r.path for r in inventory.dirty(table(spark, rows, "path string, state string")).collect()] == ["aaa.txt", "file.txt", "FILE.txt", "zzz.txt"]


def test_orphans(spark):
    objects = table(spark, [("referenced", 10), ("orphan1", 20), ("orphan2", 30)], "hash string, size long")
    entries = table(spark, [("p", "referenced"), ("d", None)], "path string, hash string")
    assert tuple(gc.orphan_summary(objects, entries).first()) == (2, 50)
    assert tuple(gc.orphan_summary(objects.limit(0), entries).first()) == (0, 0)
    left, gone = gc.collect_garbage(objects, entries)
    assert gc.orphans(left, entries).isEmpty() and gone.count() == 2


def test_archive_status_and_actions(spark):
    now = F.lit("2026-06-15 00:00:00").cast("timestamp")
    expiry = 'ongoing-request="false", expiry-date="{}"'
    heads = [(None, None), ("STANDARD", "x"), ("GLACIER", None), ("GLACIER", 'ongoing-request="true"'), ("DEEP_ARCHIVE", expiry.format("Wed, 01 Jul 2026 00:00:00 GMT")), ("GLACIER", expiry.format("Thu, 01 Jan 2026 00:00:00 GMT"))]
    rows = table(spark, [(i, *h) for i, h in enumerate(heads)], "i int, c string, r string")
    got = [r[0] for r in rows.orderBy("i").select(storage.archive_status(F.col("c"), F.col("r"), now)).collect()]
    assert got == ["immediate", "immediate", *storage.STATUSES[1:]]
    cases = list(itertools.product(("STANDARD", "GLACIER", "DEEP_ARCHIVE"), repeat=2))
    for current, target in cases:
        for status in storage.STATUSES:
            action = spark.range(1).select(storage.storage_action(F.lit(current), F.lit(target), F.lit(status))).first()[0] if status == "restore-ready" else None
            if action:
                cold = {"STANDARD": 0, "GLACIER": 1, "DEEP_ARCHIVE": 2}
                assert action == ("already-correct" if current == target else "immediate-copy" if cold[target] > cold[current] else "finalize-copy")


def test_priority_beats_specificity_and_warmest_wins(spark):
    rules = [("archive/**", "GLACIER"), ("archive/keep-warm/*", "STANDARD")]
    paths = table(spark, [("archive/keep-warm/a.jpg", "h"), ("other", "h"), ("archive/x", "i")], "path string, hash string")
    got = dict(tuple(r) for r in paths.select("path", storage.path_class(rules, "DEEP_ARCHIVE")).collect())
    assert got == {"archive/keep-warm/a.jpg": "GLACIER", "other": "DEEP_ARCHIVE", "archive/x": "GLACIER"}
    # The scope selects contents, and all their paths count.
    assert [tuple(r) for r in storage.hash_class(paths, rules, "DEEP_ARCHIVE", scope="other").collect()] == [("h", "GLACIER", True, 2)]


def test_storage_policies(spark):
    rows = table(spark, [(2, "a", "GLACIER", 1, False), (1, "b", "GLACIER", 1, False), (3, None, "STANDARD", None, True)], schemas.STORAGE_POLICIES)
    assert storage.load(rows) == ([("b", "GLACIER"), ("a", "GLACIER")], "STANDARD")
    assert [r.id for r in policies.listed(rows).collect()] == [1, 2, 3]
    assert policies.next_priority(rows).first()[0] == 2 and policies.next_priority(rows.limit(0)).first()[0] == 0
    assert schemas.validate_storage_policies(rows).isEmpty() and schemas.validate_storage_policies(rows.where("id < 3")).count() == 1
    # What is fixed about the default policy is refused, not left out in silence.
    for refused in (lambda: policies.remove(rows, 3), lambda: policies.update(rows, 3, {"glob": "x"}), lambda: policies.update(rows, 3, {"priority": 1})):
        with pytest.raises(policies.Refused):
            refused()
    assert policies.remove(rows, 1).count() == 2
    changed = policies.update(rows, 3, {"target_class": "GLACIER"}).where("id = 3").first()
    assert (changed.glob, changed.target_class) == (None, "GLACIER")
    made = policies.create(rows, {"id": None, "glob": "c", "target_class": "GLACIER", "priority": 5, "is_default": False})
    assert made.agg(F.max("id")).first()[0] == 4


def test_thumbnail_policy_rules(spark):
    good = dict(fx.GENERATE[0])
    skip = {"id": 9, "name": "s", "glob": "x/**", "action": "skip"}
    bad = {
        "name": good | {"name": "a b"}, "skip_fields": skip | {"shorter_side": 1}, "mime_types": good | {"mime_types": []}, "media_type": good | {"mime_types": ["video/*"]},
        "sizing": good | {"resizing_strategy": None}, "output_mime": good | {"media_type": "video", "mime_types": ["video/*"], "output_type": "preview"}, "missing_fields": good | {"png_compression_level": None}, "extra_fields": good | {"jpeg_quality": 3},
    }
    good |= {"mime_types": ["image/*"]}
    fixed = {k: (v | {"mime_types": ["image/*"]} if k not in ("mime_types", "media_type", "output_mime", "skip_fields") else v) for k, v in bad.items()}
    rows = [good | {"id": 100, "name": "good"}, skip | {"id": 101}] + [v | {"id": i, "name": v["name"] if k == "name" else f"n{i}"} for i, (k, v) in enumerate(fixed.items())]
    found = policies.thumbnail_violations(spark.createDataFrame(rows, schemas.THUMBNAIL_POLICIES)).collect()
    by_id = {}
    for r in found:
        by_id.setdefault(r.id, set()).add(r.problem)
    assert 100 not in by_id and 101 not in by_id
    for i, k in enumerate(fixed):
        assert k in by_id[i], (k, by_id.get(i))
    twice = spark.createDataFrame([good | {"id": 1}, good | {"id": 2}], schemas.THUMBNAIL_POLICIES)
    assert {r.problem for r in policies.thumbnail_violations(twice).collect()} == {"duplicate_name"}
    turned = policies.carry_over(spark.createDataFrame([good | {"resizing_strategy": "fit_to_box", "jpeg_quality": 4}], schemas.THUMBNAIL_POLICIES)).first()
    assert (turned.shorter_side, turned.jpeg_quality, turned.png_compression_level) == (None, None, 6)


def test_derived_names(spark):
    paths = ["d/_thumbnail/a.jpg.p2-big-iw1-ih2-fmtimage_jpeg-q80.abc.jpg", "_thumbnail/a.p1-s-ss1.h.png", "d/_thumbnail/a.jpg.abc.jpg", "d/a.p1-s-ss1.h.png", "d/_thumbnail/.p1-s-ss1.h.png"]
    got = [tuple(r) for r in derived.parse_names(table(spark, [(p,) for p in paths], "path string")).orderBy("path").collect()]
    assert got == [(paths[1], "a", "p1-s-ss1", "s", "h", "png"), (paths[0], "d/a.jpg", "p2-big-iw1-ih2-fmtimage_jpeg-q80", "big", "abc", "jpg")]
    rules = spark.createDataFrame(fx.GENERATE, schemas.THUMBNAIL_POLICIES)
    built = rules.where("name = 'big'").select(derived.derived_path(F.lit("d/a.jpg"), derived.params_segment(), F.lit("abc"), derived.extension("output_mime"))).first()[0]
    assert built == "d/_thumbnail/a.jpg.p2-big-iw800-ih600-fmtimage_jpeg-q80.abc.jpg"


def test_sanity_check_order(spark):
    listing = table(spark, [("both", "file", "both", "h", "c"), ("bad", "file", "real", "x", "c"), ("stub", "file", "stub", None, None), ("ok", "file", "real", "h", "c"), ("new", "file", "real", "h", "c"), ("sum", "file", "real", "h", "z"), ("lost", "file", "real", "l", "c")], "path string, type string, representation string, hash string, checksum string")
    entries = table(spark, [entry(p, "l" if p == "lost" else "h") for p in ("both", "bad", "stub", "ok", "gone", "sum", "lost")], ENTRY)
    objects = table(spark, [("h", "c"), ("l", "c")], "hash string, ciphertext_checksum string")
    heads = table(spark, [("h", "c")], "hash string, checksum string")
    got = {r.path: r.problem for r in checks.sanity_check(listing, entries, objects, heads).collect()}
    assert got == {"both": "both_stub_and_real", "bad": "hash_mismatch", "stub": "stub_mismatch", "new": "untracked", "gone": "missing_locally", "sum": "checksum_mismatch", "lost": "missing_in_s3"}


def test_first_match_is_ordered(spark):
    rows = table(spark, [("a/b",)], "path string")
    assert rows.select(globs.first_match("path", ["x", "a/*", "**"])).first()[0] == "a/*"


def test_inspect(spark):
    cache, entries = table(spark, [local("a", "created")], CACHE), table(spark, [entry("b", "h", "v1")], ENTRY)
    versions, objects = table(spark, [(1, "v1")], "sequence long, version_stamp string"), table(spark, [("h", 5)], "hash string, size long")
    got = inventory.inspect(cache, entries, versions, objects, "nowhere").collect()
    assert [(r.path, r.local, r.remote) for r in got] == [("nowhere", None, None)]
    got = {r.path: (r.local and r.local.state, r.remote and r.remote["size"]) for r in inventory.inspect(cache, entries, versions, objects, "*").collect()}
    assert got == {"a": ("created", None), "b": (None, 5)}
    left, history = inventory.delete_with_history(entries, entries.select("path"), "v2", "now", next_id=7)
    assert left.isEmpty() and (history.first().id, history.first().introduced_in_version) == (7, "v1")
    live = table(spark, [("A",), ("a",), ("aA",)], "path string")
    assert {r.path: r.other for r in inventory.collision_partner(live, live).collect()} == {"A": "a", "a": "A"}


def test_many_storage_policies(spark):
    """No policy is dropped, and beyond ``FOLDED`` classes are joined with the same result."""
    many = spark.range(10_050).selectExpr("id", "concat('d/', id, '/*') AS glob", "'GLACIER' AS target_class", "CAST(id AS int) AS priority", "false AS is_default")
    rules, default = storage.load(many.unionByName(table(spark, [(-1, None, "STANDARD", None, True)], "id long, glob string, target_class string, priority int, is_default boolean")))
    assert len(rules) == 10_050 and rules[-1] == ("d/10049/*", "GLACIER")
    entries = table(spark, [entry("d/9/a", "h9"), entry("d/99/a", "h99"), entry("e/1", "h1"), entry("d/99/b", "h1"), entry("d/5/x", "h5")], ENTRY)
    few = [*rules[:storage.FOLDED], ("d/99/*", "GLACIER"), ("d/**", "DEEP_ARCHIVE")]
    got = {r["hash"]: (r.target_class, r.conflicted, r.n_paths) for r in storage.hash_class(entries, few, default).collect()}
    assert got == {"h9": ("GLACIER", False, 1), "h99": ("GLACIER", False, 1), "h1": ("STANDARD", True, 2), "h5": ("GLACIER", False, 1)}
    plan = storage.hash_class(entries, few, default)._jdf.queryExecution().toString()
    assert "RLIKE" in plan and "Join" in plan and "NestedLoopJoin BuildRight, Inner, RLIKE" not in plan


def test_skip_beats_generate(spark):
    rows = [dict(fx.GENERATE[0]) | {"mime_types": ["image/*"]}, {"id": 2, "name": "off", "glob": "private/**", "action": "skip"}]
    rules = spark.createDataFrame(rows, schemas.THUMBNAIL_POLICIES)
    sources = table(spark, [("private/a.jpg", "h", None, None), ("b.jpg", "h", "image/jpeg", True)], "path string, hash string, mime_type string, readable boolean")
    files = derived.parse_names(table(spark, [("private/_thumbnail/a.jpg.p2-small-ss100-fmtimage_png-pl6.h.png",)], "path string"))
    resolved = derived.resolve(sources, rules)
    assert [r.path for r in resolved.collect()] == ["b.jpg"]
    steps = derived.reconcile(sources, resolved, files, derived.skipped(sources, rules)).collect()
    assert {(r.original_path, r.step) for r in steps} == {("private/a.jpg", "delete"), ("b.jpg", "generate")}


def test_mirrored_in_the_right_size_only(spark):
    cache = table(spark, [local(p, "unchanged", p, size=s) for p, s in (("good", 10), ("short", 10), ("unsized", None), ("lost", 10))], CACHE)
    listing = table(spark, [(p, "real", 1.0, p) for p in ("good", "short", "unsized", "lost")], "path string, representation string, mtime_ms double, hash string")
    mirror = table(spark, [("good", 76), ("short", 75), ("unsized", 76)], "hash string, size long")
    got = {r.path: r.step for r in checks.stubify_plan(cache, listing, mirror).collect()}
    assert got == {"good": "stubify", "short": "skip_not_mirrored", "unsized": "skip_not_mirrored", "lost": "skip_not_mirrored"}


def test_deletions_are_numbered_over_ranges(spark):
    entries = spark.range(1_000).selectExpr("concat('d/', id) AS path", "'file' AS type", "'h' AS hash", "'v1' AS state_version", "concat('d/', id) AS normalized_path")
    left, history = inventory.delete_with_history(entries, entries.where("path <> 'd/7'").select("path"), "v2", "now", next_id=5)
    assert [r.path for r in left.collect()] == ["d/7"]
    rows = history.orderBy("id").collect()
    assert [r.id for r in rows] == list(range(5, 1_004)) and [r.path for r in rows] == sorted(f"d/{i}" for i in range(1_000) if i != 7)
    first = inventory.insert_version(spark.createDataFrame([], schemas.VERSIONS), "a", "now")
    assert [tuple(r) for r in inventory.insert_version(first, "b", "now").orderBy("sequence").collect()] == [(1, "a", "now"), (2, "b", "now")]
    assert [r.sequence for r in inventory.versions_with_stamp(first, first).collect()] == [1]


def test_scope_of_materialize_and_policies_by_id(spark):
    cache = table(spark, [local("d/a", "unchanged"), local("e/b", "unchanged")], CACHE)
    listing = table(spark, [("d/a", "stub"), ("e/b", "stub")], "path string, representation string")
    heads = table(spark, [("h", None, None)], "hash string, storage_class string, restore string")
    plan = checks.materialize_plan(cache, listing, heads, F.current_timestamp(), scope="d/**")
    assert [tuple(r) for r in plan.collect()] == [("d/a", "materialize")]
    assert [r.id for r in policies.listed_by_id(table(spark, [(3,), (1,), (2,)], "id long")).collect()] == [1, 2, 3]
