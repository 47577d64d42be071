"""Quality rules, spelling variants and whitening against brute force."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stocktake.llm import quality_rules as qr
from stocktake.llm import spelling, whitening

from .conftest import table

DATA = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# ---- quality rules ----------------------------------------------------------------------------


def measures(text):
    text = text or ""
    words = WORDS.findall(text)
    seen = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed


def odd_texts():
    rnd = random.Random(2)
    out = [" ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 40))) for _ in range(60)]
    out += ["\n".join(rnd.choice(["x y", "", " ", "z\r", "#|<", "x y "]) for _ in range(rnd.randint(0, 12))) for _ in range(30)]
    return [*out, "a b c d e a b c d e", "\x1ca\x85b c d", "\n\n", "\tq\x0b", "a b c d e f a b c d e", "é ß 🙂 " * 9, " ".join(map(str, range(3000))), " ".join("w%d" % (i % 700) for i in range(3000))]


def test_measures(spark, odd):
    texts = [*odd_texts(), *odd]
    got = {r.doc_id: tuple(r[c] for c in (*qr.MEASURES, "base_failed")) for r in qr.measured(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert got[i] == measures(t), t[:80] if t else t
    assert qr.measured(table(spark, texts).limit(0)).count() == 0


def exact_tail(n, k, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 300), st.integers(0, 300), st.floats(0.001, 0.6))
def test_binomial(n, k, p):
    assert qr.binomial_tail(n, min(k, n), p) == pytest.approx(min(1.0, exact_tail(n, min(k, n), p)), rel=1e-9)


def test_bounds():
    assert qr.upper_bound(100, 0, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100))
    n = qr.least_holdout(0.02, 0.01)
    assert qr.binomial_tail(n, 0, 0.02) <= 0.01 < qr.binomial_tail(n - 1, 0, 0.02)
    assert qr.binomial_tail(10**7, 10**5, 0.02) == 0.0


def labelled(spark, n=4000, seed=1, noise=0.0):
    """Good prose, bad texts of symbols; ``noise`` of the good ones look bad in one language."""
    rnd = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        lang, good = rnd.choice(["en", "en", "fr", "xx" if i % 50 == 0 else "en", None]), rnd.random() < 0.8
        words = ["".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randint(3, 8))) for _ in range(40)]
        if not good or (lang == "fr" and rnd.random() < noise):
            words = [w + "%%" for w in words]
        rows.append((i, " ".join(words), lang))
        labels.append((i, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_false_rejection_is_limited_by_stratum(spark):
    docs, labels = labelled(spark, noise=0.04)
    rows = qr.measured(docs).cache()
    rules = qr.fit(rows, labels)
    assert set(rules.standing) == {"en", "fr", None}
    # In French good texts look bad too often, so that no such step stands there.
    got = qr.judge(rows, rules).join(docs.select("doc_id", "lang"), "doc_id").join(labels, "doc_id")
    rate = {r.lang: r.rate for r in got.where("quality = 1").groupBy("lang").agg(F.avg(F.when(F.col("kept"), 0).otherwise(1)).alias("rate")).collect()}
    caught = {r.lang: r.rate for r in got.where("quality = 0").groupBy("lang").agg(F.avg(F.when(F.col("kept"), 0).otherwise(1)).alias("rate")).collect()}
    assert all(v <= qr.ALPHA for v in rate.values())
    assert caught["en"] > 0.95 > caught["fr"]
    for n, k, bound in rules.report.values():
        assert bound <= qr.ALPHA and (k == 0 or exact_tail(n, k, bound) <= qr.DELTA / 3 + 1e-9)


def test_holdout_counts_each_text_once(spark):
    docs, labels = labelled(spark, 600)
    one = docs.where("doc_id = 0").crossJoin(spark.range(3000)).select((F.col("id") + 10_000).alias("doc_id"), "text", F.lit("zz").alias("lang"))
    rules = qr.fit(qr.measured(docs.unionByName(one)), labels.unionByName(one.select("doc_id", F.lit(1).alias("quality"))))
    assert "zz" not in rules.standing


def test_quality_odd_rows(spark, odd):
    docs = table(spark, odd)
    none = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 0), (2, 0)], "doc_id long, quality int")
    for labels in (none, none.limit(0)):
        got = qr.quality_rules(docs.unionByName(docs), labels)
        assert got.count() == 2 * len(odd) and got.where("kept = base_failed").count() == 0
    assert qr.quality_rules(docs.limit(0), none).count() == 0


def test_quality_query(spark):
    from stocktake.llm.queries import op11_quality_rules

    rows = op11_quality_rules(spark, DATA).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[c] for c in (*qr.MEASURES, "base_failed")) == measures(texts[r.doc_id])
        assert not (r.kept and r.base_failed)


def test_quality_plan_has_no_python(spark):
    docs, labels = labelled(spark, 300)
    judged = qr.judge(qr.measured(spark.read.parquet(f"{DATA}/documents.parquet")), qr.fit(qr.measured(docs), labels))
    text = judged._sc._jvm.PythonSQLUtils.explainString(judged._jdf.queryExecution(), "formatted")
    assert not re.search("Python|Pandas|Arrow", text)


# ---- spelling ---------------------------------------------------------------------------------

LOW = {i: i + 32 for i in range(65, 91)}


def brute_words(docs, least=3):
    n = collections.Counter()
    for i, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(LOW)):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 5:
                n[w] += 1
    return {w: k for w, k in n.items() if k >= least}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_groups(n):
    """All words by all their deletions; then all pairs that share one."""
    by = collections.defaultdict(set)
    for w in n:
        for x in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by[x].add(w)
    beside = collections.defaultdict(set)
    for own in by.values():
        for a in own:
            beside[a] |= {b for b in own if near(a, b)}
    form = {}
    for w in n:
        best = min(beside[w], key=lambda b: (-n[b], b), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(beside[w]), n[form[w]] if form[w] else None)
    return out


def found(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@pytest.mark.parametrize("rounds", [4, 2, 400])
def test_groups(spark, monkeypatch, rounds):
    """Short words over few letters, runs of equal letters, and long ones that only differ late."""
    monkeypatch.setattr(spelling, "ROUNDS", rounds)
    monkeypatch.setattr(spelling, "ROWS", 500)
    rnd = random.Random(4)
    size = 60 if rounds > 100 else 300
    words = {"".join(rnd.choice("abÿ") for _ in range(rnd.randint(5, 9))): rnd.randint(3, 60) for _ in range(400)}
    words |= {"x" * k: k for k in range(5, 12)}
    base = "".join(rnd.choice("acgt") for _ in range(size))
    for _ in range(25):
        i = rnd.randrange(size)
        words[rnd.choice((base[:i] + "n" + base[i + 1 :], base[:i] + base[i + 1 :], base[:i] + "n" + base[i:]))] = rnd.randint(3, 9)
    words[base] = 40
    got = found(spelling.grouped(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == brute_groups(words)


def test_spelling_of_texts(spark, odd):
    rnd = random.Random(6)
    vocabulary = ["".join(rnd.choice("abcé") for _ in range(rnd.randint(4, 8))) for _ in range(120)]
    texts = [" ".join(rnd.choice((w, w.upper(), w.title())) for w in rnd.choices(vocabulary, k=60)) + rnd.choice(["", "×", "1", "ā"]) for _ in range(80)]
    texts += [*odd, "ÀÉÎÕÜ àéîõü ÀÉÎÕÜ ÀÉÎÕÜ"]
    docs = table(spark, texts).unionByName(spark.createDataFrame([(None, texts[0], "x", "s", 1, "k", "n", 1, "h")] * 2, table(spark, [""]).schema))
    pairs = [*enumerate(texts), (None, texts[0]), (None, texts[0])]
    assert found(spelling.spelling_variants(docs)) == brute_groups(brute_words(pairs))
    assert spelling.spelling_variants(docs.limit(0)).count() == 0


def test_spelling_query(spark):
    from stocktake.llm.queries import op12_spelling_variants

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = found(op12_spelling_variants(spark, DATA))
    assert got == brute_groups(brute_words(docs)) and any(v[0] for v in got.values())


# ---- whitening --------------------------------------------------------------------------------


def brute_whitening(rows, k=4):
    x = {tuple(int(math.floor(256 * float(c))) for c in v) for _, v in rows}
    m = np.array(sorted(x), float)
    n, mean = len(m), m.mean(axis=0)
    values, vectors = np.linalg.eigh((m - mean).T @ (m - mean) / n)
    total = [sum(c) for c in zip(*x, strict=True)]
    return n, total, mean, values[::-1][:k], vectors[:, ::-1][:, :k], values.sum()


def check_whitening(rows, got, k=4):
    n, total, mean, values, vectors, trace = brute_whitening(rows, k)
    assert len(got) == len(rows) * len(values)
    by = collections.defaultdict(list)
    for r in got:
        by[(r.vec_id, r.component)].append(r)
    sign = {}
    for i, v in rows:
        x = [int(math.floor(256 * float(c))) for c in v]
        for c in range(1, len(values) + 1):
            r = by[(i, c)][0]
            want = (np.array(x) - mean) @ vectors[:, c - 1] / np.sqrt(values[c - 1])
            if abs(want) > 0.1:
                assert sign.setdefault(c, math.copysign(1, want * r.whitened)) == math.copysign(1, want * r.whitened)
            assert abs(r.whitened) == pytest.approx(abs(want), abs=1e-8)
            assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, total, strict=True))
            assert r.explained == pytest.approx(values[c - 1] / trace, rel=1e-9) and r.identity_error < 1e-9


def test_whitening_query(spark):
    from stocktake.llm.queries import op13_whitening

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    check_whitening(rows, op13_whitening(spark, DATA).collect())


def test_whitening_odd_rows(spark):
    draw = np.random.default_rng(3)
    good = [(i, [float(c) for c in draw.normal(size=6)]) for i in range(40)]
    good += [(100, good[0][1]), (101, good[0][1]), (102, [-0.0] * 6)]
    bad = [(200, None), (201, []), (202, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (203, [float("nan")] * 6), (204, [float("inf")] + [0.0] * 5), (205, [1.0, 2.0]), (206, [3.0] * 7)]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").withColumn("x", F.lit(1)).withColumn("i", F.lit(2))
    check_whitening(good, whitening.whiten(df).collect())
    check_whitening([(0, [0.1, 0.5]), (1, [0.7, 0.1]), (2, [0.0, 9.0])], whitening.whiten(spark.createDataFrame([(0, [0.1, 0.5]), (1, [0.7, 0.1]), (2, [0.0, 9.0])], "vec_id long, embedding array<double>")).collect())
    assert whitening.whiten(df.where("vec_id in (100, 101)")).count() == 0
    assert whitening.whiten(df.limit(0)).count() == 0
    vast = whitening.whiten(spark.createDataFrame([(0, [1e300, 0.0]), (1, [-1e300, 1.0]), (2, [5.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: r.deviation is None for r in vast} == {0: True, 1: True, 2: False}


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(0, 10**6), st.sampled_from(["full", "equal", "low", "diagonal", "tiny", "close"]))
def test_components(size, seed, kind):
    draw = np.random.default_rng(seed)
    q = np.linalg.qr(draw.normal(size=(size, size)))[0]
    spectrum = {"full": draw.random(size) + 0.1, "equal": np.ones(size), "low": np.r_[[3.0], np.zeros(size - 1)], "diagonal": np.arange(size) + 1.0, "tiny": 1e-9 * (np.arange(size) + 1), "close": 1 + 1e-10 * np.arange(size)}[kind]
    a = np.diag(spectrum) if kind == "diagonal" else (q * spectrum) @ q.T
    a = (a + a.T) / 2
    values, vectors = whitening.components(a, 4)
    want = np.sort(np.linalg.eigvalsh(a))[::-1][:4]
    want = want[: len(values)]
    assert len(values) == min(4, size, 1 if kind == "low" else 4)
    assert np.allclose(values, want, rtol=1e-12, atol=1e-13 * want.max())
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
    assert np.allclose(a @ vectors, vectors * values, atol=1e-11 * want.max())


def test_components_of_a_large_matrix():
    draw = np.random.default_rng(1)
    m = draw.normal(size=(400, 128)) * np.linspace(1, 3, 128)
    a = m.T @ m
    values, vectors = whitening.components(a, 6)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:6], rtol=1e-13)
    assert np.abs(a @ vectors - vectors * values).max() < 1e-11 * values[0]
