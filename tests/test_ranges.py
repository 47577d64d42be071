"""Checksums of ranges and contents, chunk ranges, remote plans, retries."""

import base64
import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stocktake.functions import digests, scalars
from stocktake.operators import derived, sync
from stocktake.plans import catalogue
from stocktake.plans import fixtures as fx
from stocktake.sources import contents, tree
from stocktake.sources.documents import is_transient

DATA = "/root/testdata/sf0.001"


def bitwise(data):
    c = digests.ONES
    for b in data:
        c ^= b
        for _ in range(8):
            c = c >> 1 ^ (digests._POLYNOMIAL if c & 1 else 0)
    return c ^ digests.ONES


def test_checksum():
    assert digests.crc64nvme_value(b"123456789") == 0xAE8B14860A799888
    rnd = random.Random(1)
    for size in (0, 1, 7, 8, 511, 512, 513, 1024, 5000, 100_003):
        data = rnd.randbytes(size)
        assert digests.crc64nvme_value(data) == bitwise(data)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.lists(st.integers(0, 3000), max_size=5))
def test_any_cut_gives_the_same_checksum(data, cuts):
    cuts = sorted({0, len(data), *(c for c in cuts if c < len(data))})
    value = digests.frame(len(data))
    for a, b in zip(cuts, cuts[1:]):
        value ^= digests.piece(data[a:b], b, len(data))
    assert value == bitwise(data)


def test_a_batch_is_digested_together(spark, monkeypatch):
    """Odd values in one column, nulls and slices too; the lanes of many small values advance together."""
    import pyarrow as pa

    rnd = random.Random(5)
    values = [None, b"", b"", *(rnd.randbytes(n) for n in (1, 7, 8, 511, 512, 513, 1025, 5000)), None, b"x"]
    want = [None if v is None else (digests.encoded(bitwise(v)), hashlib.blake2b(v, digest_size=32).hexdigest()) for v in values]
    for kind in (pa.binary(), pa.large_binary()):
        for first in (0, 1, 4, len(values) - 1, len(values)):
            part = pa.array(values, kind).slice(first)
            got = zip(digests.crc64nvme.func(part).to_pylist(), digests.blake2b_256.func(part).to_pylist())
            assert [None if c is None and b is None else (c, b) for c, b in got] == want[first:]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v binary").repartition(3)
    got = rows.select("i", digests.crc64nvme("v").alias("c"), digests.blake2b_256("v").alias("b")).orderBy("i").collect()
    assert [None if r.c is None and r.b is None else (r.c, r.b) for r in got] == want
    steps, calls = digests._steps, []
    monkeypatch.setattr(digests, "_steps", lambda words: calls.append(len(words)) or steps(words))
    monkeypatch.setattr(digests, "LANES", 1000)
    many = [rnd.randbytes(600) for _ in range(1200)]
    assert digests.crc64nvme.func(pa.array(many, pa.binary())).to_pylist() == [digests.encoded(digests.crc64nvme_value(v)) for v in many]
    assert calls[:3] == [1000, 1000, 400]


def test_digests_of_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(contents, "PIECE", 1000)
    rnd, want = random.Random(3), {}
    for i, size in enumerate((0, 1, 999, 1000, 4096, 50_001)):
        data = rnd.randbytes(size)
        (tmp_path / f"d{i % 2}").mkdir(exist_ok=True)
        (tmp_path / f"d{i % 2}" / f"f{i}").write_bytes(data)
        want[f"d{i % 2}/f{i}"] = (base64.b64encode(bitwise(data).to_bytes(8, "big")).decode(), hashlib.blake2b(data, digest_size=32).hexdigest())
    files = tree.walk(spark, str(tmp_path)).where("type = 'file'")
    for size in (700, 4096, 1 << 20):
        got = contents.checksums(files.unionByName(files), str(tmp_path), size_of_range=size).collect()
        assert {r.path: r.checksum for r in got} == {p: c for p, (c, _) in want.items()} and len(got) == len(want)
    assert {r.path: r.hash for r in contents.content_hashes(files, str(tmp_path)).collect()} == {p: h for p, (_, h) in want.items()}
    with pytest.raises(Exception, match="shorter"):
        contents.checksums(files.withColumn("size", F.col("size") + 10), str(tmp_path)).collect()


def test_a_large_file_in_bounded_memory(spark, tmp_path):
    """A sparse file of 3 GB: a range at a time is read, and zeros are moved over."""
    with open(tmp_path / "big", "wb") as f:
        f.seek(3 * 2**30 - 3)
        f.write(b"end")
    size = 3 * 2**30
    files = spark.createDataFrame([("big", size)], "path string, size long")
    got = contents.checksums(files, str(tmp_path)).first().checksum
    value = digests.frame(size) ^ digests.raw(b"end")
    assert got == digests.encoded(value)


def chunks(size, start, length, chunk=10, header=50, tag=16):
    """Byte by byte."""
    out = {}
    for i in range(max(0, start), min(size, start + length)):
        out.setdefault(i // chunk, []).append(i % chunk)
    ends = {k: header + k * (chunk + tag) + min(chunk, size - k * chunk) + tag for k in out}
    return [(k, header + k * (chunk + tag), ends[k], min(v), len(v)) for k, v in sorted(out.items())]


def test_chunk_ranges(spark):
    cases = [(s, a, n) for s in (0, 1, 9, 10, 11, 25, 30) for a in (0, 3, 10, 29, 40) for n in (0, 1, 7, 10, 100)]
    rows = spark.createDataFrame(cases, "size long, a long, n long")
    got = rows.select("size", "a", "n", scalars.chunk_ranges("size", chunk=10, start=F.col("a"), length=F.col("n")).alias("r")).collect()
    for r in got:
        assert [tuple(x) for x in r.r] == chunks(r["size"], r.a, r.n), (r["size"], r.a, r.n)
    assert [tuple(x) for x in spark.range(1).select(scalars.chunk_ranges(F.lit(25), chunk=10).alias("r")).first().r] == chunks(25, 0, 25)


class Told(Exception):
    def __init__(self, **what):
        self.__dict__.update(what)


@pytest.mark.parametrize("name", ["NetworkingError", "TimeoutError", "RequestTimeout", "RequestTimeoutException", "SlowDown", "ThrottlingException", "RequestThrottled", "RequestThrottledException", "InternalError", "ServiceUnavailable"])
def test_names_worth_another_attempt(name):
    assert is_transient(Told(name=name)) and is_transient(Told(response={"Error": {"Code": name}}))
    assert is_transient(type(name, (Exception,), {})())
    outer = RuntimeError("x")
    outer.__cause__ = Told(response={"Error": {"Code": name}, "ResponseMetadata": {"HTTPStatusCode": 400}})
    assert is_transient(outer)


def test_answers_are_no_reason_for_another_attempt():
    for name in ("PreconditionFailed", "NoSuchKey", "NotFound", "AccessDenied"):
        assert not is_transient(Told(name=name, response={"Error": {"Code": name}, "ResponseMetadata": {"HTTPStatusCode": 404}}))
    assert is_transient(Told(response={"ResponseMetadata": {"HTTPStatusCode": 503}})) and is_transient(ConnectionResetError()) and not is_transient(ConnectionRefusedError())


# ---- remote changes ---------------------------------------------------------------------------


def test_folders_go_last_and_come_first(spark):
    entry = "path string, type string, hash string, state_version string"
    cache = spark.createDataFrame([("a", "dir", None, "v"), ("a/b", "dir", None, "v"), ("a/b/x", "file", "h", "v"), ("a/c", "dir", None, "v"), ("a/c/mine", "file", "h", "v"), ("s", "file", "h", "v"), ("m", "file", "h", "v"), ("t", "dir", None, "v")], entry)
    candidate = spark.createDataFrame([("new/deep/f", "file", "h2", "w"), ("new/deep", "dir", None, "w"), ("s", "file", "h3", "w"), ("m", "file", "h3", "w"), ("t/u/f", "file", "h", "w")], entry)
    excluded = spark.createDataFrame([("a/c/mine",)], "path string")
    plan = sync.remote_apply_plan(sync.remote_delta(cache, candidate, excluded), cache, candidate, spark.createDataFrame([("s",), ("s",)], "path string"))
    rows = plan.orderBy("step", "path").collect()
    # "t" is deleted remotely and yet needed for "t/u/f", so that it stays, as do "a" and "a/c" for an excluded file.
    assert {r.path: r.action for r in rows} == {"a": "keep_dir", "a/b": "remove_dir", "a/b/x": "remove", "a/c": "keep_dir", "t": "keep_dir", "new": "make_dir", "new/deep": "make_dir", "new/deep/f": "write_stub", "s": "write_stub", "m": "download", "t/u": "make_dir", "t/u/f": "write_stub"} | {}
    order = [r.path for r in rows]
    assert order.index("a/b/x") < order.index("a/b") < order.index("a") and order.index("new") < order.index("new/deep") < order.index("new/deep/f")
    assert {r.path: r.change for r in rows}["new"] == "implied"


def test_a_frequent_content_is_numbered_by_many_tasks(spark):
    rows = spark.range(3000).selectExpr("concat('p', id) path", "CASE WHEN id % 3 < 2 THEN 'hot' WHEN id % 7 = 0 THEN null ELSE concat('h', id % 50) END hash")
    got, groups = sync.claims(rows).collect(), {}
    for r in got:
        groups.setdefault(r.hash, []).append((r.path, r.claim))
    assert len(got) == 3000 and len(groups["hot"]) == 2000
    for own in groups.values():
        assert [c for _, c in sorted(own)] == list(range(1, len(own) + 1))


def test_a_scan_is_applied_but_for_collisions(spark):
    from stocktake.operators import changes

    listing = spark.createDataFrame([(p, "file", "real", 5.0, 1, "h") for p in ("A", "a", "b", "Old", "new")], "path string, type string, representation string, mtime_ms double, size long, hash string")
    cache = spark.createDataFrame([(p, "file", 1, "h0", 1, s, "v1", p.lower()) for p, s in (("b", "unchanged"), ("old", "unchanged"), ("gone", "unchanged"), ("NEW", "unchanged"))], catalogue.schemas.CACHE_ENTRIES)
    listing = listing.unionByName(listing.where("path = 'b'").withColumn("path", F.lit("NEW")).withColumn("mtime_ms", F.lit(1.0)))
    after, collisions = changes.apply_scan(listing, cache, "v2")
    assert sorted((r.path, r.other, r.source) for r in collisions.collect()) == [("A", "a", "batch"), ("a", "A", "batch"), ("new", "NEW", "durable")]
    got = {r.path: (r.state, r.hash, r.parent_state_version) for r in after.collect()}
    # "old" is deleted in this batch, so that "Old" may take its place.
    assert got == {"b": ("modified", "h", "v1"), "Old": ("created", "h", "v2"), "old": ("deleted", None, "v1"), "gone": ("deleted", None, "v1"), "NEW": ("unchanged", "h0", "v1")}
    status = changes.scan_status(changes.scan_changes(listing, cache, "v2"), collisions).first()
    assert (status.collisions, status.status_code, status.created) == (3, 1, 4)


# ---- plans ------------------------------------------------------------------------------------


def _count(df, word):
    """Nodes of the plan before adaptive execution."""
    text = df._jdf.queryExecution().sparkPlan().toString() if word == "FileScan" else df._jdf.queryExecution().executedPlan().toString()
    return sum(line.lstrip(" :+-").startswith(word) for line in text.split("\n"))


@pytest.mark.parametrize(("name", "scans"), [("upload_plan", 8), ("sync_summary", 8), ("apply_sync", 10), ("reconcile", 9)])
def test_a_sync_is_planned_in_few_scans(spark, name, scans):
    got = catalogue.QUERIES[name](spark, DATA)
    assert 0 < _count(got, "FileScan") <= scans


def _sorts(df):
    """The most sorts in one stage of the plan before adaptive execution."""
    stages, above = {}, []
    for k, line in enumerate(df._jdf.queryExecution().executedPlan().toString().split("\n")):
        text = line.lstrip(" :+-")
        depth = len(line) - len(text)
        while above and above[-1][0] >= depth:
            above.pop()
        own = above[-1][1] if above else 0
        stages[own] = stages.get(own, 0) + text.startswith("Sort ")
        above.append((depth, k if "Exchange" in text.split(" ")[0] else own))
    return max(stages.values())


def test_previews_are_planned_with_few_sorted_tables_in_a_task(spark, monkeypatch):
    """All that a plan joins has the source's path for a key, so that one task would hold it all."""
    parts, before = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    kept = derived.cut
    monkeypatch.setattr(derived, "cut", lambda df: parts.append(df) or kept(df))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = catalogue.QUERIES["derived_plan_skips"](spark, DATA)
        assert [_sorts(x) for x in [*parts, got] if _sorts(x) > 7] == []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_previews_of_odd_sources(spark):
    """Sources without a hash, unreadable, without policies or files; files of unknown policies, current twice, of no source."""
    sources = spark.createDataFrame([("a", "h", True), ("b", None, True), ("c", "h", False), ("d", "h", True), ("e", None, True), ("f", "h", True), ("g", "h", True), ("s", None, False)], "path string, hash string, readable boolean")
    resolved = spark.createDataFrame([(p, n, f"p2-{n}-ss1", "png") for p in "abcfg" for n in ("x", "y")], "path string, policy string, params string, ext string")
    names = ["a.p2-x-ss1.h.png", "a.p1-x-ss9.h.png", "a.p2-z-ss1.h.png", "b.p2-x-ss1.h.png", "c.p2-x-ss1.old.png", "d.p2-x-ss1.h.png", "e.p2-x-ss1.h.png", "f.p2-y-ss1.old.png", "f.p2-y-ss1.older.png", "s.p2-x-ss1.h.png", "t.p2-x-ss1.h.png", "u.p2-x-ss1.h.png"]
    files = derived.parse_names(spark.createDataFrame([("_thumbnail/" + n,) for n in names], "path string"))
    skipped = spark.createDataFrame([("s",), ("s",), ("t",), ("g",)], "path string")
    at = "_thumbnail/{}.p2-{}-ss1.h.png".format
    steps = [("a", "x", at("a", "x"), "up_to_date"), ("a", "x", "_thumbnail/a.p1-x-ss9.h.png", "delete"), ("a", "z", at("a", "z"), "delete"), ("a", "y", at("a", "y"), "generate"), ("b", None, None, "missing_cache_entry")]
    steps += [("d", "x", at("d", "x"), "delete"), ("e", "x", at("e", "x"), "delete"), ("f", "y", "_thumbnail/f.p2-y-ss1.old.png", "regenerate"), ("f", "y", "_thumbnail/f.p2-y-ss1.older.png", "delete"), ("f", "x", at("f", "x"), "generate")]
    fresh = [("g", n, at("g", n), "generate") for n in "xy"]
    gone = [(p, "x", at(p, "x"), "delete") for p in "st"]
    for rest, more in ((None, fresh), (skipped, gone), (skipped.limit(0), fresh)):
        got = derived.reconcile(sources, resolved, files, rest)
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, steps + more))


def test_only_survivors_are_probed(spark):
    """Ignored, skipped, unnamed, stubbed sources and, when ensuring, finished ones are never probed."""
    policies = spark.createDataFrame([dict(fx.GENERATE[0]) | {"glob": "pics/**", "mime_types": ["image/*"]}, {"id": 9, "name": "off", "glob": "pics/private/**", "action": "skip"}], catalogue.schemas.THUMBNAIL_POLICIES)
    sources = spark.createDataFrame([("pics/a.jpg", "h", "real"), ("pics/b.jpg", "h", "stub"), ("pics/c.tmp", "h", "real"), ("pics/private/d.jpg", "h", "real"), ("docs/e.txt", "h", "real"), ("pics/_thumbnail/x", "h", "real"), ("pics/bad", "h", "both"), ("pics/done.jpg", "h", "real")], "path string, hash string, representation string")
    ready = "pics/_thumbnail/done.jpg.p2-small-ss100-fmtimage_png-pl6.h.png"
    files = derived.parse_names(spark.createDataFrame([(p,) for p in (ready, ready.replace("done", "c").replace(".jpg", ".tmp"), ready.replace("done", "private_gone"), "pics/private/_thumbnail/d.jpg.p2-small-ss1.h.png", "pics/_thumbnail/bad.p2-small-ss1.h.png")], "path string"))
    probed = []

    def probe(rows):
        probed.append(sorted(r.path for r in rows.collect()))
        return rows.withColumn("readable", ~F.col("path").endswith("bad")).withColumn("mime_type", F.lit("image/jpeg"))

    for mode, want in (("state", ["pics/a.jpg", "pics/bad", "pics/done.jpg"]), ("ensure", ["pics/a.jpg", "pics/bad"])):
        steps = derived.plan(sources, policies, files, probe, ignore=["**/*.tmp"], mode=mode)
        assert probed.pop() == want
        assert {(r.original_path, r.step) for r in steps.collect()} == {("pics/a.jpg", "generate"), ("pics/bad", "unreadable"), ("pics/done.jpg", "up_to_date"), ("pics/b.jpg", "stub_without_preview"), ("pics/c.tmp", "delete"), ("pics/private_gone.jpg", "delete"), ("pics/private/d.jpg", "delete")}
        c = derived.counters(steps).first()
        assert (c.up_to_date, c.to_generate, c.to_delete, c.unreadable, c.stubbed_original, c.ok, c.status_code) == (1, 1, 3, 1, 1, True, 0)
    steps = derived.plan(sources, policies, files, probe, scope="pics/private/**")
    assert {(r.original_path, r.step) for r in steps.collect()} == {("pics/private/d.jpg", "delete")}
    with pytest.raises(ValueError):
        derived.plan(sources, policies, files, probe, mode="other")
