"""Trees, glob joins and digests of ranges, against plain walks over files and lists."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stocktake.functions import globindex, globs
from stocktake.sources import listing, tree

TEMP = ".x-tmp-" + "0" * 32


def plain(root, exclude=()):
    """Logical rows by recursion, in the order of the full paths' bytes."""
    out = {}
    for folder, dirs, names in os.walk(root):
        at = os.path.relpath(folder, root)
        at = "" if at == "." else at + "/"
        if not at:
            dirs[:] = [d for d in dirs if d not in exclude]
            names = [n for n in names if n not in exclude]
        for d in dirs:
            out[at + d] = ("dir", "real")
        for n in names:
            if n.startswith(".x-tmp-"):
                continue
            logical = n.removesuffix(".stub")
            kind = "stub" if n != logical else "real"
            if out.get(at + logical, ("file",))[0] != "dir":
                old = out.get(at + logical, (None, kind))[1]
                out[at + logical] = ("file", kind if old == kind else "both")
    return [(p, *out[p]) for p in sorted(out, key=lambda p: p.encode())]


@pytest.fixture
def folder(tmp_path):
    for name in ("a", "a/_thumbnail", "a.b", "a/.hidden", "z.stub", "e", "e/f", "e/f/g", ".sync", "a/.sync", "é"):
        (tmp_path / name).mkdir()
    for name in ("a/x.txt", "a/x.txt.stub", "a/_thumbnail/x.txt.p1.h.png", "a!", "a/.hidden/_y", "a.b/only.stub", "z.stub/in", "e/f/g/deep", ".sync/state", "a/.sync/kept", f"e/{TEMP}", f"{TEMP}.jpg", "_under", "é/ü", "～", "\U0001f600", "e.stub"):
        (tmp_path / name).write_text(name)
    return tmp_path


def test_walk_and_fold(spark, folder):
    raw = tree.walk(spark, str(folder), exclude=[".sync"]).cache()
    assert sorted(r.path for r in tree.temporary(raw).collect()) == [f"{TEMP}.jpg", f"e/{TEMP}"]
    rows = tree.listing(spark, f"file://{folder}", exclude=[".sync"]).collect()
    assert [(r.path, r.type, r.representation) for r in rows] == plain(str(folder), [".sync"])
    by = {r.path: r for r in rows}
    assert by["a/x.txt"].size == len("a/x.txt") and by["a/x.txt"].representation == "both"
    assert by["a.b/only"].size == len("a.b/only.stub")
    assert by["a/_thumbnail"].type == "dir" and by["a/x.txt"].mtime_ms == os.stat(folder / "a/x.txt").st_mtime_ns / 1e6
    # A directory and a stub of one name: the directory stands.
    assert (by["e"].type, by["e"].representation) == ("dir", "real")
    assert tree.fold(raw.unionByName(raw)).count() == len(rows)


def test_walk_through_arrow(spark, folder):
    from pyarrow import fs

    raw = tree.walk(spark, str(folder), exclude=[".sync"], filesystem=fs.LocalFileSystem)
    assert sorted((r.path, r.type, r.size) for r in raw.where("type = 'file'").collect()) == sorted((r.path, r.type, r.size) for r in tree.walk(spark, str(folder), [".sync"]).where("type = 'file'").collect())


def test_links_and_missing_roots(spark, tmp_path):
    (tmp_path / "d").mkdir()
    os.symlink(tmp_path, tmp_path / "d" / "loop")
    os.symlink(tmp_path / "nowhere", tmp_path / "d" / "broken")
    assert sorted((r.path, r.type) for r in tree.walk(spark, str(tmp_path)).collect()) == [("d", "dir"), ("d/loop", "file")]
    with pytest.raises(Exception, match="FileNotFound"):
        tree.walk(spark, str(tmp_path / "none")).count()


def test_many_directories_in_rounds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tree, "PER_TASK", 5)
    monkeypatch.setattr(tree, "BATCH", 3)
    for i in range(60):
        d = tmp_path / f"d{i % 7}" / f"s{i}"
        d.mkdir(parents=True)
        (d / "f").write_text("x")
    assert [(r.path, r.type, r.representation) for r in tree.listing(spark, str(tmp_path)).collect()] == plain(str(tmp_path))


def test_mirror_of_a_tree(spark, tmp_path):
    """Names that are digests count, at any depth; temporary and other names don't."""
    good = ["ab" * 32, "cd" * 32]
    (tmp_path / "objects/ab").mkdir(parents=True)
    for name in (f"objects/ab/{good[0]}", good[1], "objects/ab/readme", f"objects/{'AB' * 32}", f"objects/{TEMP}"):
        (tmp_path / name).write_text("12345")
    raw = tree.walk(spark, str(tmp_path))
    assert sorted((r.hash, r.size) for r in listing.mirror_objects(raw.where("type = 'file'")).collect()) == [(g, 5) for g in good]
    assert tree.temporary(raw).count() == 1


# ---- globs ------------------------------------------------------------------------------------

SEGMENT = st.text(st.sampled_from("ab.*?{},[]!\\"), min_size=1, max_size=5)
PATTERN = st.lists(st.one_of(SEGMENT, st.just("**"), st.sampled_from(["a", "b", "*.b", "a.b"])), min_size=1, max_size=4).map("/".join)
PATH = st.lists(st.text(st.sampled_from("ab."), min_size=1, max_size=4), min_size=1, max_size=4).map("/".join)


@settings(max_examples=600, deadline=None)
@given(PATTERN, PATH)
def test_anchor_is_necessary(pattern, path):
    import re

    parts = path.split("/")
    met = {"=" + path, *("/" + "/".join(parts[:n]) for n in range(1, len(parts)))}
    if "." in parts[-1]:
        met.add("." + parts[-1].rsplit(".", 1)[1])
    for one in globs.alternatives(pattern):
        try:
            hit = re.search(globs.glob_to_regex(one).replace(r"\z", r"\Z"), path)
        except re.error:
            continue
        assert not hit or globindex.anchor(one) is None or globindex.anchor(one) in met


def test_match_is_every_pair(spark):
    import re

    rnd = random.Random(5)
    paths = ["/".join(rnd.choice(["a", "b", "c.d", "é", "x.txt", "y.tar.gz"]) for _ in range(rnd.randint(1, 5))) for _ in range(150)]
    patterns = ["**", "*", "a/**", "**/*.txt", "{a,b}/**", "{a,a/b}/**", "a/b", "*.gz", "**/[xy].t?t", "a/*/c.d", "é/*", "**/b/**", "nothing/here", "x.{txt,gz}", "y.*.gz"]
    policies = spark.createDataFrame(list(enumerate(patterns)), "id int, glob string")
    rows = spark.createDataFrame([(p,) for p in paths + paths[:9]], "path string")
    want = {(p, i) for p in paths for i, g in enumerate(patterns) if re.search(globs.glob_to_regex(g).replace(r"\z", r"\Z"), p)}
    got = [(r.path, r.id) for r in globindex.match(rows, policies).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert globindex.match(rows, policies.limit(0)).count() == 0


def test_match_has_no_nested_loop(spark):
    policies = spark.range(3000).selectExpr("id", "concat('d', id, '/**/*.txt') glob")
    rows = spark.range(500).selectExpr("concat('d', id % 50, '/a/', id, '.txt') path")
    got = globindex.match(rows, policies)
    text = got._sc._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")
    assert "NestedLoop" not in text and "Cartesian" not in text
    assert got.count() == 500
