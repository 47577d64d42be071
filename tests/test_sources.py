import hashlib
import json
import os
import threading

import pytest

from stocktake.functions import digests
from stocktake.operators import changes
from stocktake.sources import listing
from stocktake.sources.store import Conflict, SnapshotStore


def test_store(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = spark.createDataFrame([(1,)], "x int")
    store = SnapshotStore.init(spark, root, {"r": rows})
    first = store.current()
    second = store.commit(first, {"r": rows.union(rows)})
    assert store.versions() == [first, second]
    assert (store.read("r").count(), store.read("r", first).count()) == (2, 1)
    with pytest.raises(Conflict):
        store.commit(first, {"r": rows})
    with pytest.raises(Conflict):
        SnapshotStore.init(spark, root, {"r": rows})
    with pytest.raises(FileNotFoundError):
        SnapshotStore.attach(spark, str(tmp_path / "none"))
    # Committing the very same snapshot again is no conflict.
    assert SnapshotStore.attach(spark, root).current() == second
    assert store.commit(first, {"r": rows}, stamp=second) == second and store.read("r").count() == 2
    with pytest.raises(Conflict):
        store.commit(second, {"r": rows}, stamp=first)
    # An attempt that stopped before it was published can be made again.
    rows.write.parquet(f"{root}/states/v-left/r")
    assert store.commit(second, {"r": rows.union(rows).union(rows)}, stamp="v-left") == "v-left" and store.read("r").count() == 3


def test_unchanged_relations_are_shared(spark, tmp_path):
    root = tmp_path / "store"
    rows = spark.createDataFrame([(1,)], "x int")
    store = SnapshotStore.init(spark, str(root), {"a": rows, "b": rows})
    first = store.current()
    second = store.mutate(lambda now: {"a": now["a"].union(now["b"])})
    assert os.listdir(root / "states" / second) == ["a"]
    assert (store.read("a").count(), store.read("b").count(), store.relations()) == (2, 1, ["a", "b"])
    assert store._manifest(second)["b"] == store._manifest(first)["b"]
    third = store.commit(second, {"c": rows}, drop=["a"])
    assert store.relations() == ["b", "c"] and store.relations(first) == ["a", "b"]
    with pytest.raises(FileNotFoundError):
        store.read("a", "no such version")
    assert store.versions() == [first, second, third]


def test_reads_cost_the_same_at_many_versions(spark, tmp_path, monkeypatch):
    """The log is laid down by hand; what counts is how many files are looked at."""
    store = SnapshotStore.init(spark, str(tmp_path / "store"), {"r": spark.createDataFrame([(1,)], "x int")})
    (tmp_path / "store/.newest.crc").unlink()
    first, looked = store.current(), []
    exists, read = store._exists, store._read
    monkeypatch.setattr(store, "_exists", lambda name: looked.append(name) or exists(name))
    monkeypatch.setattr(store, "_read", lambda name: looked.append(name) or read(name))
    cost = {}
    for upto in (300, 10_000):
        for i in range(len(os.listdir(tmp_path / "store/commits")) + 1, upto + 1):
            (tmp_path / f"store/commits/{i:012d}").write_text(json.dumps({"stamp": f"s{i}", "parent": first if i == 2 else f"s{i - 1}"}))
            if i % 100 == 0:
                (tmp_path / "store/compacted").mkdir(exist_ok=True)
                (tmp_path / f"store/compacted/{i:012d}").write_text(json.dumps({"stamps": [first, *(f"s{k}" for k in range(2, i + 1))]}))
        (tmp_path / "store/newest").write_text(json.dumps({"number": upto - 3}))
        looked.clear()
        assert store.current() == f"s{upto}"
        cost[upto] = len(looked)
        (tmp_path / "store/newest").unlink()
        looked.clear()
        assert store.current() == f"s{upto}" and len(looked) <= 40
        looked.clear()
        assert len(store.versions()) == upto and len(looked) <= 150
    assert cost[300] == cost[10_000] <= 8
    assert store.read("r", first).count() == 1


def test_a_torn_commit_is_burnt(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = spark.createDataFrame([(1,)], "x int")
    store = SnapshotStore.init(spark, root, {"r": rows})
    first = store.current()
    (tmp_path / "store/commits/000000000002").write_text("")
    assert store.current() == first and store.read("r").count() == 1
    second = store.commit(first, {"r": rows.union(rows)})
    assert SnapshotStore.attach(spark, root).versions() == [first, second] and store.read("r").count() == 2
    # A hint that can't be read, or that is ahead of the log, does no harm.
    for hint in ("", '{"number": 900}'):
        (tmp_path / "store/newest").write_text(hint)
        assert store.current() == second


def test_a_crash_before_publication_leaves_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(1,)], "x int")
    store = SnapshotStore.init(spark, str(tmp_path / "store"), {"r": rows})
    first = store.current()

    def crash(made, name):
        raise RuntimeError("power")

    with pytest.raises(RuntimeError):
        SnapshotStore(spark, str(tmp_path / "store"), publish=crash).commit(first, {"r": rows.union(rows)}, stamp="s2")
    assert store.versions() == [first] and store.read("r").count() == 1
    assert store.commit(first, {"r": rows.union(rows)}, stamp="s2") == "s2" and store.read("r").count() == 2


def test_of_two_writers_one_wins(spark, tmp_path):
    root, rows = str(tmp_path / "store"), spark.createDataFrame([(1,)], "x int")
    store = SnapshotStore.init(spark, root, {"r": rows})
    first, ready, out = store.current(), threading.Barrier(4), []

    def write(k):
        own = SnapshotStore(spark, root)
        try:
            out.append(own.commit(first, {f"r{k}": rows}, before_swap=ready.wait))
        except Conflict:
            out.append(None)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(timeout=120)
    won = [x for x in out if x]
    assert len(out) == 4 and len(won) == 1 and store.versions() == [first, won[0]]


def test_unknown_file_systems_are_refused(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))

    class Other:
        def getUri(self):
            return self

        def getScheme(self):
            return "ftp"

    store._fs = Other()
    with pytest.raises(ValueError, match="ftp"):
        store._publisher()


def test_lost_race_is_done_again(spark, tmp_path):
    store = SnapshotStore.init(spark, str(tmp_path / "store"), {"r": spark.createDataFrame([(1,)], "x int")})
    races = [2]

    def somebody_else():
        if races[0]:
            races[0] -= 1
            store.commit(store.current(), {"r": store.read("r").union(spark.createDataFrame([(races[0] + 10,)], "x int"))})

    store.mutate(lambda now: {"r": now["r"].union(spark.createDataFrame([(99,)], "x int"))}, before_swap=somebody_else)
    assert sorted(r.x for r in store.read("r").collect()) == [1, 10, 11, 99]
    races[0] = 100
    with pytest.raises(Conflict):
        store.mutate(lambda now: {}, before_swap=somebody_else)


def test_listing(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "d").mkdir(parents=True)
    (root / "a.txt").write_bytes(b"hello")
    (root / "d" / "b.txt.stub").write_text("blake2b:" + "0" * 64 + "\n")
    (root / "d" / "c.txt.stub").write_text("nonsense")
    (root / ".hidden").write_bytes(b"")
    (root / "_big.stub").write_text("blake2b:" + "0" * 5000)
    (root / "_raw.stub").write_bytes(b"\xff\xfe")
    found = listing.files(spark, str(root), content=True)
    assert {r.path: r.size for r in found.collect()}["a.txt"] == 5
    assert found.where("path = 'a.txt'").first().hash == hashlib.blake2b(b"hello", digest_size=32).hexdigest()
    manifest = spark.createDataFrame([(x,) for x in ("a", "d/.x-tmp-" + "0" * 32, "d/.x-tmp-" + "0" * 32 + ".jpg", "d/b.x-tmp-1", "m/x")], "path string")
    assert listing.temporary(manifest).count() == 2 and {r.path for r in listing.settled(manifest, exclude="m").collect()} == {"a", "d/b.x-tmp-1"}
    folded = changes.fold_listing(listing.settled(listing.files(spark, str(root))))
    assert {r.path: r.representation for r in folded.collect()} == {"a.txt": "real", "d/b.txt": "stub", "d/c.txt": "stub", ".hidden": "real", "_big": "stub", "_raw": "stub"}
    stubs = {r.path: r.hash for r in listing.stubs(spark, str(root)).collect()}
    assert stubs == {"d/b.txt.stub": "0" * 64, "d/c.txt.stub": None, "_big.stub": None, "_raw.stub": None}
    assert {r.path: r.checksum for r in found.collect()}["a.txt"] == digests.encoded(digests.crc64nvme_value(b"hello"))
    assert not listing.is_empty(found)


def test_documents(spark, tmp_path):
    from stocktake.sources import documents

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "lock.json").write_text('{"pid": 7, "acquiredAt": "now",\n "hostname": "h"}')
    got = documents.read(spark, str(tmp_path / "a"), documents.LOCK, ("pid", "hostname")).first()
    assert (got.pid, got.valid) == (7, True)
    (tmp_path / "a" / "lock.json").write_text("broken")
    assert not documents.read(spark, str(tmp_path / "a"), documents.LOCK, ("pid",)).first().valid
    error = ValueError()
    error.__cause__ = ConnectionResetError()
    assert documents.is_transient(error) and not documents.is_transient(ValueError()) and not documents.is_transient(None)


def test_upgrades(spark):
    from stocktake.sources import upgrades

    base = {
        "entries": spark.createDataFrame([("p", "h", "v1")], "path string, hash string, state_version string"),
        "objects": spark.createDataFrame([("h",)], "hash string"),
        "versions": spark.createDataFrame([("v1",)], "version_stamp string"),
    }
    known = {"2": lambda r: {"objects": r["objects"].selectExpr("hash", "1 AS size")}, "1": lambda r: {}}
    after, applied = upgrades.upgrade(base, known, ["1"])
    assert applied == ["1", "2"] and after["objects"].columns == ["hash", "size"] and upgrades.pending(known, applied) == []
    with pytest.raises(ValueError):
        upgrades.upgrade(base, {"3": lambda r: {"objects": r["objects"].limit(0)}}, [])


def test_temporary_summary(spark):
    from stocktake.operators.checks import temporary_summary

    rows = spark.createDataFrame([("a", 5), (".x-tmp-" + "0" * 32, 7)], "path string, size long")
    assert tuple(temporary_summary(rows).first()) == (1, 7, False)


def test_transient_network_errors():
    import errno
    import socket

    from stocktake.sources import documents

    assert documents.is_transient(socket.gaierror(-3, "try again")) and documents.is_transient(OSError(errno.ENETUNREACH, "unreachable")) and documents.is_transient(TimeoutError())
    assert not documents.is_transient(ConnectionRefusedError(errno.ECONNREFUSED, "refused")) and not documents.is_transient(OSError(errno.ENOENT, "none"))
