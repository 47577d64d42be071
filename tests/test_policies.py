"""Change sets that are merged and checked as one, upgrades, and small functions that nothing else tests."""

import json

import pytest
from pyspark.sql import functions as F

from stocktake import schemas
from stocktake.functions import scalars
from stocktake.operators import checks, inventory, policies, storage
from stocktake.plans import fixtures as fx
from stocktake.sources import documents, listing, upgrades
from stocktake.sources.store import SnapshotStore

CHANGE = f"op string, set array<string>, {schemas.THUMBNAIL_POLICIES}"
STORAGE_CHANGE = f"op string, set array<string>, {schemas.STORAGE_POLICIES}"
BOX = {"id": 1, "name": "box", "glob": "**", "action": "generate", "mime_types": ["image/*"], "media_type": "image", "resizing_strategy": "fit_to_box", "image_width": 8, "image_height": 6, "output_mime": "image/png", "png_compression_level": 6, "created_at": "t"}
MOSAIC = {"id": 2, "name": "film", "glob": "v/**", "action": "generate", "mime_types": ["video/*"], "media_type": "video", "output_type": "mosaic", "shorter_side": 90, "tile_row_count": 2, "tile_column_count": 3, "output_mime": "image/webp", "webp_quality": 70, "webp_lossless": False, "created_at": "t"}
SKIP = {"id": 3, "name": "off", "glob": "x/**", "action": "skip", "created_at": "t"}


def table(spark, rows):
    return spark.createDataFrame(rows, schemas.THUMBNAIL_POLICIES)


def after(spark, rows, *changes):
    """The table after a change set as dictionaries without nulls by id, and the problems."""
    told = [c if c["op"] == "create" else c | {"set": [k for k in c if k not in ("op", "id")]} for c in changes]
    new, bad = policies.changed(table(spark, rows), spark.createDataFrame(told, CHANGE))
    return {r.id: {k: v for k, v in r.asDict().items() if v is not None} for r in new.collect()}, sorted((r.id, r.problem) for r in bad.collect())


def test_each_change_of_branch(spark):
    rows, bad = after(spark, [BOX, MOSAIC, SKIP], {"op": "update", "id": 1, "resizing_strategy": "resize_shorter_side", "shorter_side": 50}, {"op": "update", "id": 2, "output_type": "preview", "frame_count": 5, "frame_delay_ms": 40})
    # The encoding stays where the format does, the sizing goes where the branch hasn't got it.
    assert bad == []
    assert rows[1] == {k: v for k, v in BOX.items() if not k.startswith("image_")} | {"resizing_strategy": "resize_shorter_side", "shorter_side": 50}
    assert rows[2] == {k: v for k, v in MOSAIC.items() if not k.startswith("tile_")} | {"output_type": "preview", "frame_count": 5, "frame_delay_ms": 40}
    rows, bad = after(spark, [BOX, MOSAIC, SKIP], {"op": "update", "id": 1, "action": "skip"}, {"op": "update", "id": 2, "output_mime": "image/jpeg", "jpeg_quality": 80})
    assert bad == [] and rows[1] == {"id": 1, "name": "box", "glob": "**", "action": "skip", "created_at": "t"}
    assert rows[2] == {k: v for k, v in MOSAIC.items() if not k.startswith("webp")} | {"output_mime": "image/jpeg", "jpeg_quality": 80}
    # From images to videos the shorter side is carried over, from boxes there is none.
    small = {k: v for k, v in BOX.items() if not k.startswith("image_")} | {"resizing_strategy": "resize_shorter_side", "shorter_side": 7}
    to_video = {"op": "update", "id": 1, "media_type": "video", "mime_types": ["video/mp4"], "output_type": "mosaic", "tile_row_count": 1, "tile_column_count": 1}
    assert after(spark, [small], to_video)[1] == [] and after(spark, [small], to_video)[0][1]["shorter_side"] == 7
    assert after(spark, [BOX], to_video)[1] == [(1, "missing_fields")]


def test_what_is_refused(spark):
    every = [BOX, MOSAIC, SKIP]
    cases = {
        "extra_fields": {"op": "update", "id": 1, "jpeg_quality": 3}, "output_mime": {"op": "update", "id": 2, "output_mime": "image/gif", "gif_max_colors": 9, "gif_dither": "none"}, "skip_fields": {"op": "update", "id": 3, "shorter_side": 4},
        "mime_types": {"op": "update", "id": 3, "action": "generate"}, "range": {"op": "update", "id": 1, "png_compression_level": 10}, "duplicate_name": {"op": "update", "id": 2, "name": "box"}, "no_such_policy": {"op": "update", "id": 9, "name": "n"},
        "media_type": {"op": "update", "id": 1, "mime_types": ["video/*"]}, "name": {"op": "create", **SKIP, "id": None, "name": "a b"}, "op": {"op": "drop", "id": 1},
    }
    for problem, change in cases.items():
        assert problem in {p for _, p in after(spark, every, change)[1]}, problem
    twice = after(spark, every, {"op": "update", "id": 1, "name": "a"}, {"op": "delete", "id": 1})[1]
    assert (1, "changed_twice") in twice
    rows, bad = after(spark, every, {"op": "delete", "id": 1}, {"op": "create", **BOX, "id": None})
    assert bad == [] and set(rows) == {2, 3, 4} and rows[4]["name"] == "box"
    assert after(spark, every)[0].keys() == {1, 2, 3}


def test_nothing_is_written_if_anything_is_wrong(spark, tmp_path):
    default = (1, None, "STANDARD", None, True)
    store = SnapshotStore.init(spark, str(tmp_path / "store"), {"storage_policies": spark.createDataFrame([default, (2, "a/**", "GLACIER", 0, False)], schemas.STORAGE_POLICIES)})
    first = store.current()

    def change(*rows):
        return policies.commit_changes(store, "storage_policies", spark.createDataFrame(list(rows), STORAGE_CHANGE))

    good = {"op": "update", "id": 2, "set": ["target_class"], "target_class": "DEEP_ARCHIVE"}
    for bad, problem in (({"op": "update", "id": 1, "set": ["glob"], "glob": "x"}, (1, "default_fixed")), ({"op": "delete", "id": 1}, (1, "default_kept")), ({"op": "create", "glob": "b", "target_class": "WARM", "priority": 1}, (3, "target_class")), ({"op": "update", "id": 1, "set": ["colour"]}, (1, "no_such_field"))):
        with pytest.raises(policies.Refused) as e:
            change(good, bad)
        assert problem in e.value.problems and store.current() == first
    change(good, {"op": "update", "id": 1, "set": ["target_class"], "target_class": "GLACIER"}, {"op": "create", "glob": "b", "target_class": "GLACIER", "priority": 3})
    assert sorted(tuple(r) for r in store.read("storage_policies").collect()) == [(1, None, "GLACIER", None, True), (2, "a/**", "DEEP_ARCHIVE", 0, False), (3, "b", "GLACIER", 3, False)]


def test_policies_by_name(spark, tmp_path):
    store = SnapshotStore.init(spark, str(tmp_path / "store"), {"ignore_policies": spark.createDataFrame([], schemas.IGNORE_POLICIES), "storage_policies": spark.createDataFrame([(1, None, "STANDARD", None, True)], schemas.STORAGE_POLICIES), "thumbnail_policies": table(spark, [SKIP])})
    ignore, classes, previews = (f(store) for f in (policies.ignore_policies, policies.storage_policies, policies.thumbnail_policies))
    ignore.create(glob="*.tmp", created_at="t")
    ignore.create(glob="*.bak", created_at="t")
    ignore.edit(1, glob="**/*.tmp")
    ignore.delete(2)
    assert [(r.id, r.glob) for r in ignore.list().collect()] == [(1, "**/*.tmp")]
    classes.create(glob="a/**", target_class="GLACIER")
    classes.create(glob="b/**", target_class="GLACIER")
    assert [(r.id, r.priority) for r in classes.list().collect()] == [(2, 0), (3, 1), (1, None)]
    before = store.current()
    for wrong in (lambda: ignore.edit(7, glob="x"), lambda: ignore.edit(1, colour="x"), lambda: classes.delete(1), lambda: previews.edit(3, action="generate"), lambda: ignore.create(created_at="t")):
        with pytest.raises(policies.Refused):
            wrong()
    assert store.current() == before
    previews.edit(3, glob="y/**")
    assert [tuple(r)[:4] for r in previews.list().collect()] == [(3, "off", "y/**", "skip")]


def test_of_repeated_rows_the_last_is_put(spark):
    base = spark.createDataFrame([("a", 1), ("b", 1)], "path string, n int")
    delta = spark.createDataFrame([("a", 2, 1), ("a", 3, 2), ("c", 9, 0)], "path string, n int, at int")
    assert sorted(tuple(r) for r in inventory.upsert(base, delta, "path", "at").collect()) == [("a", 3), ("b", 1), ("c", 9)]


def test_upgrades_of_policies(spark):
    old = "id long, glob string, action string, priority long, mime_types array<string>, media_type string, image_width long, image_height long, tile_row_count long, tile_column_count long, tile_size long, jpeg_quality long, created_at string"
    rows = spark.createDataFrame([(1, "**", "generate", 0, ["image/*"], "image", 8, 6, None, None, None, 75, "t"), (2, "v/**", "generate", 1, ["video/*"], "video", None, None, 2, 3, 90, None, "t"), (3, "x/**", "skip", 2, None, None, None, None, None, None, None, None, "t")], old)
    base = {"entries": spark.createDataFrame([], schemas.ENTRIES), "objects": spark.createDataFrame([], schemas.OBJECTS), "versions": spark.createDataFrame([], schemas.VERSIONS)}
    relations, applied = upgrades.upgrade(base | {"thumbnail_policies": rows}, upgrades.UPGRADES, [])
    assert applied == ["07_named", "08_sized", "09_encoded"]
    new = relations["thumbnail_policies"]
    assert {f.name: f.dataType for f in new.schema} == {f.name: f.dataType for f in table(spark, [SKIP]).schema}
    got = {r.id: {k: v for k, v in r.asDict().items() if v is not None} for r in new.collect()}
    assert got[1] == {"id": 1, "name": "policy_1", "glob": "**", "action": "generate", "mime_types": ["image/*"], "media_type": "image", "resizing_strategy": "fit_to_box", "image_width": 8, "image_height": 6, "output_mime": "image/jpeg", "jpeg_quality": 75, "created_at": "t"}
    assert got[2] == {"id": 2, "name": "policy_2", "glob": "v/**", "action": "generate", "mime_types": ["video/*"], "media_type": "video", "output_type": "mosaic", "shorter_side": 90, "tile_row_count": 2, "tile_column_count": 3, "output_mime": "image/jpeg", "jpeg_quality": 80, "created_at": "t"}
    assert got[3] == {"id": 3, "name": "policy_3", "glob": "x/**", "action": "skip", "created_at": "t"}
    assert policies.thumbnail_violations(new.select(table(spark, [SKIP]).columns)).isEmpty()
    # An animation of the second version becomes a preview in its own format.
    middle, _ = upgrades.upgrade(base | {"thumbnail_policies": rows}, {k: upgrades.UPGRADES[k] for k in ("07_named", "08_sized")}, [])
    gif = middle["thumbnail_policies"].where("id = 2").withColumn("output_type", F.lit("gif")).withColumn("frame_count", F.lit(4).cast("long")).withColumn("frame_delay_ms", F.lit(50).cast("long")).withColumn("tile_row_count", F.lit(None).cast("long")).withColumn("tile_column_count", F.lit(None).cast("long"))
    r = upgrades.encoded({"thumbnail_policies": gif})["thumbnail_policies"].first()
    assert (r.output_type, r.output_mime, r.jpeg_quality, r.gif_max_colors, r.gif_dither, r.shorter_side) == ("preview", "image/gif", None, 256, "sierra2_4a", 90)
    assert upgrades.upgrade(relations, upgrades.UPGRADES, applied)[0] is relations


# ---- small functions --------------------------------------------------------------------------


def test_lookups_and_pages(spark):
    versions = spark.createDataFrame([(1, "a", "t"), (2, "b", "t")], schemas.VERSIONS)
    assert [r.sequence for r in inventory.versions_with_stamp(versions, spark.createDataFrame([("b",), ("c",)], "version_stamp string")).collect()] == [2]
    rows = spark.createDataFrame([(p,) for p in "abcd"], "path string")
    assert [r.path for r in inventory.page(rows, "path", 2, after="b").collect()] == ["c", "d"]
    assert [r.path for r in inventory.page(rows, "path", 2, after="b", inclusive=True).collect()] == ["b", "c"]
    assert [r.path for r in inventory.page(rows, "path", 2).collect()] == ["a", "b"]


def test_names_keys_and_lists(spark):
    one = spark.createDataFrame([("d/" + "x" * 250, ["a/b", "c"]), ("d/" + "é" * 126, None)], "path string, mimes array<string>")
    got = one.select(scalars.fits_with_stub_suffix("path").alias("fits"), documents.decode_list(documents.encode_list("mimes")).alias("back"), scalars.snapshot_key(F.lit("s1")).alias("key")).collect()
    assert [(r.fits, r.back, r.key) for r in got] == [(True, ["a/b", "c"], "states/s1.db"), (False, None, "states/s1.db")]


def test_lines_of_results(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("é", None)], "path string, n int")
    listing.write_lines(rows, str(tmp_path / "out"))
    lines = [json.loads(x) for f in (tmp_path / "out").glob("part-*") for x in f.read_text().splitlines()]
    assert sorted(lines, key=str) == sorted([{"path": "a", "n": 1}, {"path": "é"}], key=str)


def test_contents_without_an_object(spark):
    entries = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("c", None)], "path string, hash string")
    objects = spark.createDataFrame([("h1",)], "hash string")
    assert [r.hash for r in storage.unknown_objects(entries, objects).collect()] == ["h2"]


def test_counts_of_a_materialisation(spark):
    v = fx.documents(spark, "/root/testdata/sf0.001")
    objects = fx.objects(v)
    plan = checks.materialize_plan(fx.cache(v), fx.listing(v), fx.heads(objects), F.lit(fx.NOW).cast("timestamp"))
    steps = {r.step: r for r in checks.step_summary(plan).collect()}
    assert sum(r[1] for r in steps.values()) == plan.count() and len(steps) > 2
