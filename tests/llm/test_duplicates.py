import collections
import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stocktake.llm import _graph
from stocktake.llm import near_duplicates as nd
from stocktake.llm._graph import components
from stocktake.llm._lcp_merge import common, front_code, merge
from stocktake.llm._shingles import shingle_sets
from stocktake.llm.near_duplicates import near_duplicates
from stocktake.llm import suffix_dedup
from stocktake.llm.suffix_dedup import remove_repeats

from .conftest import table


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles(text, width=5):
    w = words(text)
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute_components(texts, share):
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and 100 * n >= share * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label, [len(s) for s in sets]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("abAB \t\né,")), max_size=60), min_size=1, max_size=6))
def test_sets(texts):
    _, sizes = shingle_sets(texts, 5)
    assert sizes.tolist() == [len(shingles(t)) for t in texts]


def copies(seed=2):
    rnd = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)]
    bases = [[rnd.choice(vocabulary) for _ in range(rnd.randint(5, 260))] for _ in range(14)]
    out = []
    for _ in range(220):
        w = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4, 8])):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        out.append(" ".join(w).upper() if rnd.random() < 0.1 else " ".join(w))
    return out


def test_near_duplicates(spark, odd, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK_SHINGLES", 2_000)  # groups are cut into several blocks
    monkeypatch.setattr(nd, "KEY_BLOCK", 5)
    monkeypatch.setattr(nd, "KEY_PIVOTS", 2)
    monkeypatch.setattr(nd, "PIVOTS", 8)
    texts = [*copies(), *odd]
    for share in (85, 80):
        label, sizes = brute_components(texts, share)
        got = {r.doc_id: r for r in near_duplicates(table(spark, texts), share=share).collect()}
        assert [got[i].component_id for i in range(len(texts))] == label
        assert [got[i].n_shingles for i in range(len(texts))] == sizes
        assert all(got[i].kept == (label[i] == i) for i in got)
    assert near_duplicates(table(spark, texts).limit(0)).count() == 0


def test_null_and_repeated_identifiers(spark):
    rows = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, ""), (2, "x")], "doc_id long, text string")
    got = near_duplicates(rows).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (0, 1, False), (1, 1, True), (1, 1, True), (2, 2, True)]


@pytest.mark.parametrize("edges_each", [200_000, 7])
def test_components(spark, monkeypatch, edges_each):
    monkeypatch.setattr(_graph, "EDGES", edges_each)
    rnd = random.Random(4)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    label = {}
    for a, b in edges:
        if a != b:
            x, y = label.setdefault(a, a), label.setdefault(b, b)
            label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == label


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=6).map(lambda b: bytes(x % 3 for x in b)), max_size=8), min_size=1, max_size=6))
def test_merge(runs):
    runs = [sorted(r) for r in runs]
    got = list(merge([((h, rest, None) for h, rest in zip(*front_code(r), strict=True)) for r in runs]))
    want = sorted(x for r in runs for x in r)
    assert [g[1] for g in got] == want
    assert [g[0] for g in got] == [common(a, b, 0) for a, b in zip([b"", *want], want, strict=False)]


def brute_repeats(raw, size=400):
    seen = collections.Counter(t[i : i + size] for t in raw for i in range(len(t) - size + 1))
    out = []
    for t in raw:
        mark = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                mark[i : i + size] = b"\1" * size
        kept = bytes(x for x, m in zip(t, mark, strict=True) if not m)
        out.append((len(t), sum(mark), sum(1 for i in range(len(t)) if mark[i] and (not i or not mark[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup(spark, odd):
    rnd = random.Random(5)

    def some(n):
        return "".join(rnd.choice("abcdefgh é") for _ in range(n))

    base, texts = [some(900) for _ in range(4)], []
    for _ in range(120):
        parts = []
        for _ in range(rnd.randint(0, 4)):
            b, i = rnd.choice(base), rnd.randint(0, 500)
            part = list(b[i : i + rnd.randint(200, 700)])
            if rnd.random() < 0.4:
                part[rnd.randrange(len(part))] = "Z"
            parts += [some(rnd.randint(0, 200)), "".join(part)]
        texts.append("".join(parts))
    texts += [*odd, "a" * 399, "b" * 401, "xy" * 700, "🙂" * 150 + some(5)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in remove_repeats(table(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats([(t or "").encode() for t in texts])
    assert remove_repeats(table(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("wide", [5_000, 20])
def test_many_blocks_of_one_gram(spark, monkeypatch, wide):
    """A group of more than a dozen blocks takes the counting way, one of very many is counted over tasks."""
    monkeypatch.setattr(suffix_dedup, "WIDE", wide)
    rnd = random.Random(8)
    core = "".join(rnd.choice("abcdef") for _ in range(420))
    texts = ["".join(rnd.choice("ghij") for _ in range(rnd.randint(0, 90))) + core[rnd.randint(0, 60) : 420 - rnd.randint(0, 60)] + "".join(rnd.choice("ghij") for _ in range(80)) for _ in range(60)]
    texts += [t[: rnd.randint(300, len(t))] for t in texts[:20]]
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans)) for r in remove_repeats(table(spark, texts)).select("doc_id", "n_bytes", "n_removed", "spans").collect()}
    assert [got[i] for i in range(len(texts))] == [x[:3] for x in brute_repeats([t.encode() for t in texts])]


def test_copies_keep_their_rows(spark):
    text = "".join(random.Random(1).choice("abcdef") for _ in range(900))
    rows = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    assert [(r.n_bytes, r.n_removed) for r in remove_repeats(rows).where(F.col("n_bytes") > 0).collect()] == [(900, 900)] * 3


def test_templated_documents_are_no_group(spark):
    """At a similarity of about 0.4 most share keys by chance, but hardly a signature is within the distance."""
    rnd = random.Random(9)
    frame = [["t%d" % rnd.randrange(10**6) for _ in range(60)] for _ in range(2)]
    texts = [" ".join([*frame[0], *("r%d" % rnd.randrange(10**9) for _ in range(80)), *frame[1]]) for _ in range(2000)]
    texts += [texts[5] + " end", texts[7]]
    docs = table(spark, texts)
    classes = nd.shingled(docs.select("doc_id", "text"), 5).groupBy("node").agg(F.first("low").alias("low"), F.first("high").alias("high")).withColumn("handle", F.xxhash64("node"))
    sizes = [r["count"] for r in components(nd.candidate_pairs(classes)).groupBy("root").count().collect()]
    assert sum(sizes) < 100 and max(sizes) < 50
    got = near_duplicates(docs)
    assert sorted((r.doc_id, r.component_id) for r in got.where("not kept").collect()) == [(2000, 5), (2001, 7)]


def test_a_family_makes_few_tile_rows(spark, monkeypatch):
    """Rows that are compared in tiles grow with the family, not with its square."""
    monkeypatch.setattr(nd, "KEY_BLOCK", 100)
    monkeypatch.setattr(nd, "KEY_PIVOTS", 4)
    rows, plain = [], nd.compared

    def counted(tiles):
        held = tiles.cache()
        rows.append(held.count())
        return plain(held)

    monkeypatch.setattr(nd, "compared", counted)
    rnd, a_class = random.Random(7), {}
    base = ["w%d" % i for i in range(150)]
    for size in (1000, 2000):
        rows.clear()
        texts = [" ".join("z%d" % rnd.randrange(10**6) if i == k else w for i, w in enumerate(base)) for k in (rnd.randrange(150) for _ in range(size))]
        docs = table(spark, texts)
        classes = nd.shingled(docs.select("doc_id", "text"), 5).groupBy("node").agg(F.first("low").alias("low"), F.first("high").alias("high")).withColumn("handle", F.xxhash64("node")).cache()
        assert components(nd.candidate_pairs(classes)).count() == classes.count()
        a_class[size] = sum(rows) / size
    # Each class once for each of its 65 keys at most, and the pivots; all blocks meeting each other would make 20 times as many.
    assert max(a_class.values()) < 65 * (1 + 2 * 4 / 100)


def test_parts_are_what_hangs_together_within_the_distance():
    rnd = random.Random(3)
    base = [rnd.randrange(256) for _ in range(65)]
    rows = [[rnd.randrange(256) if rnd.random() < share else b for b in base] for share in [0.1] * 30 + [0.3] * 30 + [0.9] * 10]
    low = np.array(rows, np.uint8)
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (low[i] != low[j]).sum() <= nd.MOST:
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    want = [[i for i, x in enumerate(label) if x == k] for k in sorted(set(label))]
    assert sorted(sorted(p) for p in nd.parts(low)) == [p for p in want if len(p) > 1]


def test_one_identifier_of_several_texts(spark):
    base = ["w%d" % i for i in range(40)]
    a, b = " ".join(base), " ".join(base[:39])
    rows = spark.createDataFrame([(1, a), (1, "other words that have nothing in common with it"), (2, b), (3, "x")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(rows).collect())
    assert got == [(1, 5, 1), (1, 36, 1), (2, 35, 1), (3, 1, 3)]


def test_suffix_query_and_passages(spark):
    """The query's digests and its passages, against all windows of a given table."""
    from stocktake.llm.queries import op7_suffix_dedup

    folder = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    want = brute_repeats([t.encode() for _, t in docs])
    runs = {n: collections.defaultdict(set) for n in (suffix_dedup.PASSAGE, suffix_dedup.PASSAGE_GRAM)}
    for n, seen in runs.items():
        for i, t in docs:
            w = t.split()
            for a in range(len(w) - n + 1):
                seen[tuple(w[a : a + n])].add(i)
    whole, part = ({i for s in runs[n].values() if len(s) > 1 for i in s} for n in runs)
    for r, (i, _), x in zip(op7_suffix_dedup(spark, folder).orderBy("doc_id").collect(), docs, want, strict=True):
        assert (r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (i, *x)
        assert r.passage if i in whole else not r.passage or i in part
    assert whole
