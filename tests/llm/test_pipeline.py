"""The stages of the pipeline, each on what it is given, against plain Python over the same rows."""

import hashlib
import re

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from stocktake.llm import language_id, pii

from .test_duplicates import brute_components, copies

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def wider(df):
    """With columns whose names the stages use themselves."""
    for name in ("_kept", "_bad", "spans", "base", "row", "node", "hash", "key", "label", "level"):
        df = df.withColumn(name, F.lit(name))
    return df


def odd(spark):
    """Nulls in any column, empty and blank texts, repeated rows, one identifier of two texts."""
    text = "Is and retitioning ouen the of, nterti thorreou ndernt. Is ndble whst the by and for threea. Ores the oredat the, anntly re."
    rows = [(1, text, "en", "s", 9), (1, text, "en", "s", 9), (None, text + " Also here.", None, None, None), (2, None, "en", "s", 0), (3, "", "en", "s", 0), (4, " \n\t ", None, "s", 4), (5, text + " One more word.", "en", None, None), (1, "mail jane.doe@example.org or call +44 20 7946 0958 about the " + text, "en", "s", 1), (6, "x" * 5000, "en", "s", 1)]
    return spark.createDataFrame(rows, SCHEMA)


def test_language_stage(spark, docs):
    got = cp.identify_language(spark, wider(docs), DATA)
    assert got.columns == wider(docs).columns
    model = language_id.fit(docs)
    want = {r.doc_id for r in docs.collect() if not model.predict([r.text or ""])[2][0]}
    assert {r.doc_id for r in got.collect()} == want and len(want) > 0.95 * docs.count()


def test_near_duplicate_stage(spark):
    texts = copies(seed=6)
    df = wider(spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA))
    got = cp.drop_near_duplicates(spark, df, DATA)
    label, _ = brute_components(texts, 80)
    assert rows_of(got) == rows_of(df.where(F.col("doc_id").isin([i for i, x in enumerate(label) if x == i])))


UNITS_AND_NUMBERS = re.compile(r"[0-9]")


def plain_windows(text, exact, width=8):
    """Windows of words; unless ``exact``, whatever might be a number, a unit or a name is anything."""
    from stocktake.llm.decontamination import NUMBER_WORDS, UNITS

    open_words, out, held = set(NUMBER_WORDS) | set(UNITS), [], []
    for w in re.findall(r"[^\W_]+", text or ""):
        low = w.lower()
        if exact:
            out.append(low)
        elif UNITS_AND_NUMBERS.search(w) or low in set(NUMBER_WORDS):
            held.append(1)
            if not out or out[-1] != "#":
                out.append("#")
        else:
            out.append("?" if low in open_words else low)
    return [tuple(out[i : i + width]) for i in range(len(out) - width + 1)], out


def test_decontamination_stage(spark, docs):
    """Every pair of a document and an item: whole copies go, and what shares no window of templates stays."""
    items = {r.item_id: r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    kept = cp.drop_contaminated(spark, wider(docs), DATA)
    assert kept.columns == wider(docs).columns
    left = {r.doc_id for r in kept.collect()}
    windows = {x for t in items.values() for x in plain_windows(t, False)[0]}
    low = [" ".join(plain_windows(t, True)[1]) for t in items.values() if len(plain_windows(t, True)[1]) >= 8]
    must, may = set(), set()
    for r in docs.collect():
        text = f" {' '.join(plain_windows(r.text, True)[1])} "
        if any(f" {x} " in text for x in low):
            must.add(r.doc_id)
        if any(x in windows for x in plain_windows(r.text, False)[0]):
            may.add(r.doc_id)
    gone = {r.doc_id for r in docs.collect()} - left
    assert must and must <= gone <= may


def test_personal_data_stage(spark, docs):
    frame = docs.unionByName(odd(spark).where("doc_id = 1"))
    got = cp.redact_personal_data(spark, wider(frame), DATA)
    assert got.columns == wider(frame).columns and got.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    want = []
    spans = pii.find(frame.withColumn("doc_id", F.xxhash64("doc_id", "text")).dropDuplicates(["doc_id"]), pii.fit(frame))
    by = {r.doc_id: sorted((s.start, -s.end, s.end, s.kind) for s in r.spans) for r in spans.collect()}
    for r in frame.select("*", F.xxhash64("doc_id", "text").alias("h")).collect():
        out, at, reach, name = "", 0, None, None
        merged = []
        for start, _, end, kind in by[r.h]:
            if merged and start < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], end)
            else:
                merged.append([start, end, kind])
        for start, end, kind in merged:
            out, at = out + r.text[at:start] + f"[{kind.upper()}]", end
        out += r.text[at:]
        want.append((r.doc_id, out, r.lang, r.source, len(out)))
    assert rows_of(got.select(docs.columns)) == sorted(want, key=repr)
    assert any("[EMAIL]" in w[1] for w in want)


def test_encoding_stage(spark, docs):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    frame = docs.limit(60).unionByName(odd(spark))
    texts = [r.text or "" for r in frame.collect()]
    want = sorted((e.ids, hashlib.sha256(library.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()) for e in library.encode_batch(texts, add_special_tokens=False))
    got = cp.encode(spark, wider(frame), DATA).collect()
    assert sorted((list(r.ids), r.decoded_sha256) for r in got) == want and all(r.n_tokens == len(r.ids) for r in got)


@pytest.mark.parametrize("k", range(len(cp.STAGES)))
def test_odd_rows_and_empty_tables(spark, k):
    name, stage = cp.STAGES[k]
    frame = wider(odd(spark))
    got = stage(spark, frame, DATA)
    rows = got.collect()
    assert stage(spark, frame.limit(0), DATA).count() == 0
    if name == "bpe":
        assert len(rows) == frame.count()
        return
    assert got.columns == frame.columns
    ids = sorted((r.doc_id or 0, (r.text or "")[:4]) for r in rows)
    if name == "language":
        # Null, empty and blank texts have no language.
        assert not {2, 3, 4} & {r.doc_id for r in rows}
    elif name == "near_dedup":
        # Rows that repeat stay together, empty texts are linked with nothing, a row without identifier goes with its group.
        assert {i for i, _ in ids} >= {1, 2, 3, 4, 6} and sum(i == 1 for i, _ in ids) == 3
    elif name == "decontamination":
        assert len(rows) == frame.count()
    else:
        assert len(rows) == frame.count() and {r.text for r in rows if r.doc_id == 2} == {None}
        assert all(r.n_chars == len(r.text) for r in rows if r.text is not None)


def test_run(spark, docs):
    """The whole pipeline equals its stages one after another."""
    rows = cp.run(spark, DATA).collect()
    left = docs
    for name, stage in cp.STAGES[:-1]:
        before = left.count()
        left = stage(spark, left, DATA).cache()
        assert left.count() <= before and left.columns == docs.columns
    want = {(r.doc_id, tuple(r.ids)) for r in cp.STAGES[-1][1](spark, left, DATA).collect()}
    assert {(r.doc_id, tuple(r.ids)) for r in rows} == want and 0 < len(rows) < docs.count()
