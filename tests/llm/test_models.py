import collections
import hashlib
import math
import re
import time
import zlib
from functools import lru_cache

import numpy as np
import pytest
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stocktake.llm import context_tree as ct
from stocktake.llm import language_id, pii, secrets
from stocktake.llm.decontamination import contaminated, decontaminate, leaks
from stocktake.llm.nearest import nearest

from .conftest import table

DATA = "/root/testdata/sf0.001"


# ---- language ---------------------------------------------------------------------------------

#: Texts of no learned language: Russian, Chinese, Greek, Italian, Dutch, and codes.
FOREIGN = (
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
    "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。",
    "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα.",
    "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza.",
    "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten.",
    "QWxsIGh1bWFuIGJlaW5ncyBhcmUgYm9ybiBmcmVlIGFuZCBlcXVhbCBpbiBkaWduaXR5IGFuZCByaWdodHMuIFRoZXkgYXJl",
    "def train(rows, epochs=4):\n    for k in range(epochs):\n        loss = model.step(rows[k], lr=0.1)\n    return loss",
)


def test_foreign_texts_are_rejected_and_clean_ones_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = language_id.fit(docs, ~held_out)
    assert model.predict(list(FOREIGN))[2] == [True] * len(FOREIGN)
    rows = language_id.identify(docs.where(held_out), model)
    assert rows.where("rejected").count() <= 0.01 * rows.count()
    # A language that wasn't learned, told by its own n-grams.
    for lang in ("de", "fr", "es"):
        other = language_id.fit(docs, ~held_out & (F.col("lang") != lang))
        own = language_id.identify(docs.where(held_out & (F.col("lang") == lang)), other)
        assert own.where("rejected").count() >= 0.9 * own.count()


def test_language_held_out_accuracy(spark):
    from stocktake.llm.queries import op1_language_id

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = op1_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang", F.length("text").alias("n")), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    long = [r for r in rows if r.held_out and r.n >= 200]
    assert len(long) > 150 and sum(r.lang == r.lang_pred for r in long) / len(long) > 0.95
    # Clean texts stay, the same texts with their letters shuffled go.
    assert sum(r.rejected for r in rows) <= 5
    model = language_id.fit(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    draw = np.random.default_rng(4)
    junk = [language_id.shuffled(r.text[:2000], draw) for r in docs.where("length(text) > 100").limit(200).collect()]
    got = language_id.identify(table(spark, junk), model)
    assert got.where("rejected").count() > 0.9 * len(junk)


def test_language_query_against_brute_force(spark):
    """Each gram looked up by itself, text by text."""
    from stocktake.llm.queries import op1_language_id

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language_id.fit(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    known = language_id.letters()
    for r in op1_language_id(spark, DATA).join(docs.select("doc_id", "text"), "doc_id").limit(25).collect():
        chars = np.array([32, *(int(known[ord(c)]) for c in r.text), 32], np.uint32)
        total, grams = np.zeros(len(model.bias)), 0
        for n in language_id.ORDERS:
            for i in range(len(chars) - n + 1):
                b = int(language_id.buckets(chars[i : i + n], n)[0])
                if b < 1 << language_id.BITS:
                    total += model.table[b]
                    grams += 1
        p = language_id.softmax((total / max(1, grams) + model.bias) / model.temperature)[: len(model.languages)]
        assert r.lang_pred == model.languages[int(p.argmax())] and abs(r.score - p.max()) < 1e-4
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_every_language_is_learned(spark):
    """None of many languages is left out."""
    texts = [(chr(97 + i % 26) + chr(97 + i // 26)) * 6 + " " + (chr(97 + i // 26) + chr(97 + i % 26)) * 4 for i in range(520)]
    docs = table(spark, texts).withColumn("lang", F.concat(F.lit("l"), F.col("doc_id").cast("string")))
    assert len(set(language_id.sample(docs, F.lit(True), 100, 1000, "doc_id", "text", "lang")[1])) == 520


def test_language_odd_rows(spark, odd):
    docs = table(spark, ["der die das und nicht " * 5, "the of and to in is " * 5] * 30).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "de").otherwise("en"))
    model = language_id.fit(docs)
    texts = [*odd, "123 456 !!", "und die nicht das", "and the is of to"]
    got = {r.doc_id: r for r in language_id.identify(table(spark, texts), model).collect()}
    n = len(odd)
    assert all((got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True) for i in (0, 1, 2, n))
    assert (got[n + 1].lang_pred, got[n + 2].lang_pred) == ("de", "en")
    kept = language_id.accepted(table(spark, texts), model)
    assert kept.columns == table(spark, texts).columns and not {0, 1, 2, n} & {r.doc_id for r in kept.collect()}
    nothing = language_id.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language_id.identify(docs, nothing).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), model).count() == 0


def test_language_long_text_in_pieces(monkeypatch):
    model = language_id.train(["der die das und", "the of and to"] * 20, ["de", "en"] * 20, epochs=2)
    text = "der the die of 9 das and und to " * 4000
    whole = next(model.sums([text]))
    monkeypatch.setattr(language_id, "PIECE", 20_000)
    parts = next(model.sums([text]))
    assert whole[1] == parts[1] and np.allclose(whole[0], parts[0])


# ---- personal data ----------------------------------------------------------------------------


def luhn(text):
    d = [int(c) for c in text if c.isdigit()][::-1]
    return sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(d)) % 10 == 0


def base_spans(text):
    out = []
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text or ""):
            n = sum(c.isdigit() for c in m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (13 <= n <= 19 and luhn(m[0])) or kind == "phone" and not 9 <= n <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


@pytest.fixture(scope="module")
def selector(spark):
    return pii.fit(spark.read.parquet(f"{DATA}/documents.parquet"))


def test_pii_base(spark, selector, odd):
    import random

    rnd = random.Random(3)
    bits = ["1", "2", "55", ".", ".", "@", "a", "b.c", "-", " ", "+", "(", ")", "4111111111111111", "é", "🙂", "255", "\n", "_", "4", "0", "000255"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40))) for _ in range(600)] + odd + ["a@b.c" + ".d" * 20_000, "1" * 50_000, "+" * 5_000 + "1" + "(" * 5_000]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s.kind in ("email", "ip", "card", "phone")] for r in pii.find(table(spark, texts), selector).collect()}
    order = ("email", "ip", "card", "phone")
    for i, text in enumerate(texts):
        assert sorted(got[i], key=lambda s: (order.index(s[0]), s[1])) == base_spans(text), text and text[:80]


def test_pii_examples_and_redaction(spark, selector, odd):
    examples = table(spark, [t for t, _ in pii.EXAMPLES])
    got = {r.doc_id: bool(r.spans) for r in pii.find(examples, selector).collect()}
    assert [got[i] for i in range(len(got))] == [bool(y) for _, y in pii.EXAMPLES]
    texts = [*odd, "to a@b.co or +1 (702) 555-0742, ip 1.2.3.4.", "card 4111 1111 1111 1111 +4111111111111"]
    docs = table(spark, texts)
    out = {r.doc_id: r.text for r in pii.redact(docs, selector).collect()}
    assert pii.redact(docs, selector).columns == docs.columns
    assert [out[i] for i in range(len(odd))] == odd
    assert out[len(odd)] == "to [EMAIL] or [PHONE], ip [IP]."
    assert pii.find(docs.limit(0), selector).count() == 0 and pii.fit(docs.limit(0)).trees


def test_pii_thresholds_are_calibrated(selector):
    assert len(set(selector.thresholds.values())) == len(pii.MORE)
    assert all(precision >= 0.9 and recall >= 0.6 for precision, recall in selector.report.values())


def test_pii_many_spans(spark, selector):
    """More than one block of a sweep, spans of all kinds and overlaps."""
    parts = [f"x{i}@b.co, +1 (702) 555-{i:04d} or call 415-555-{i:04d}; 10.0.{i % 256}.1" for i in range(700)]
    rows = pii.find(table(spark, [" ".join(parts)]), selector).collect()[0].spans
    base = sorted((s.kind, s.start, s.end) for s in rows if s.kind in ("email", "ip", "phone", "card"))
    assert base == sorted(base_spans(" ".join(parts)))
    more = [(s.start, s.end) for s in rows if s.kind == "phone_alt"]
    assert len(more) == 700 and all(" ".join(parts)[a:b].startswith("415-555") for a, b in more)
    out = pii.redact(table(spark, [" ".join(parts)]), selector).collect()[0].text
    assert out == " ".join(["[EMAIL], [PHONE] or call [PHONE_ALT]; [IP]"] * 700)


def test_pii_query(spark):
    """The digests of the query, from plain patterns."""
    import hashlib

    from stocktake.llm.queries import op2_pii

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = op2_pii(spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = base_spans(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")]
        every = [s for s in r.spans.split(",") if s]
        assert r.n_spans == len(every) and ",".join(s for s in every if s.split(":")[0] in ("email", "ip", "card", "phone")) == joined


def test_pii_plan_has_no_python(spark, selector):
    df = pii.find(spark.read.parquet(f"{DATA}/documents.parquet"), selector)
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert not re.search("Python|Pandas|Arrow", text)


# ---- benchmark --------------------------------------------------------------------------------


def test_templates(spark, odd):
    items = spark.createDataFrame([(1, "Tom has 12 apples and gives Anna 5 of them to eat at lunch. How many apples does Tom have left now?"), (2, "short one here now"), (3, "tiny"), (4, None), (5, "")], "item_id long, text string")
    texts = [
        *odd,
        "bla bla. Then Mary has 15 apples and gives Peter 7 of them to eat at lunch. How many apples does Mary have left now? More text",
        "a SHORT one, here now ok",
        "tom has 12 apples and gives anna 5 of them to eat at lunch. how many apples does tom have left now",
        "Tom has twenty two apples and gives Anna 3.5 of them to eat at lunch. How many apples does Tom have left now?",
        "so Mary has 15 pears or takes Peter 7 of those to see at night. How few plums does Jim have left then",
    ]
    docs = table(spark, texts)
    got = sorted((r.doc_id - len(odd), r.item_id) for r in leaks(docs, items).collect())
    assert got == [(0, 1), (1, 2), (2, 1), (3, 1)]
    kept = decontaminate(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(texts) - 4
    assert decontaminate(docs, items.limit(0)).count() == len(texts) and decontaminate(docs.limit(0), items).count() == 0


def test_slots_must_be_consistent(spark):
    # One line of names, and hardly anything besides: the same template with names that don't correspond.
    items = spark.createDataFrame([(1, "then Tom met Anna near Tom beside Anna before Tom left Anna under Tom behind Anna")], "item_id long, text string")
    good = "then Kim met Lou near Kim beside Lou before Kim left Lou under Kim behind Lou"
    bad = "then Kim met Lou near Joe beside Kim before Lou left Joe under Ann behind Bob"
    assert [r.doc_id for r in leaks(table(spark, [good, bad]), items).collect()] == [0]


def test_leaks_without_broadcast(spark, monkeypatch):
    from stocktake.llm import decontamination

    docs, items = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    want = sorted((r.doc_id, tuple(r["items"])) for r in contaminated(docs, items).collect())
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 0)
    assert want and sorted((r.doc_id, tuple(r["items"])) for r in contaminated(docs, items).collect()) == want


def test_short_and_numeric_items(spark):
    """Items with too few plain words for a template match their copies, and only with equal values."""
    items = ["What is 12 + 7?", "What is 15 percent of 240?", "Convert 5 miles to 8 km", "Add 3 km, 4 miles, 5 feet, 6 inches, 7 yards, 8 cm and 9 mm", "red blue green"]
    changed = ["What is 12 + 8?", "What is 15 percent of 250?", "Convert 6 miles to 8 km", "Add 2 km, 3 miles, 4 feet, 5 inches, 6 yards, 7 cm and 8 mm", "red blue grey"]
    docs = table(spark, [f"some text before. {x} and some after" for x in items + changed])
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.cover) for r in leaks(docs, benchmark).collect()) == [(i, i, 1.0) for i in range(5)]


def test_items_of_one_and_two_tokens_are_whole_lines(spark):
    items = spark.createDataFrame([(1, "tiny"), (2, "12, 34 and"), (3, "Paris France")], "item_id long, text string")
    docs = table(spark, ["tiny", "before\n\"Tiny.\"\nafter", "a tiny thing", "x\n12 34 AND\ny", "12 35 and", "paris, france", "in Paris France is", "the\ue0f1se are pariS\n"])
    assert sorted((r.doc_id, r.item_id, r.cover) for r in leaks(docs, items).collect()) == [(0, 1, 1.0), (1, 1, 1.0), (3, 2, 1.0), (5, 3, 1.0)]


def test_long_run_of_a_longer_item(spark):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    docs = table(spark, [" ".join(words[20:70]), " ".join(words[20:69]), " ".join(words[:30] + ["x"] + words[60:90])])
    benchmark = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    assert [(r.doc_id, r.cover) for r in leaks(docs, benchmark).collect()] == [(0, 0.25)]


# ---- neighbours -------------------------------------------------------------------------------


def test_nearest(spark):
    draw = np.random.default_rng(1)
    rows = [(i, [float(x) for x in draw.normal(size=8).astype(np.float32)]) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(30)]  # one point many times
    rows += [(400, None), (401, []), (402, [0.0] * 8), (403, [float("nan")] * 8), (404, [None] * 8), (405, [float("inf")] * 8), (500, [1.0, 2.0]), (501, [2.0, 2.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("x")).withColumn("dim", F.lit(7))
    got = collections.defaultdict(list)
    for r in nearest(df, F.col("id") % 50 == 0, k=10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    usable = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    for q in [i for i in usable if i % 50 == 0]:
        want = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(usable[q], v, strict=True))), i) for i, v in usable.items() if i != q and len(v) == len(usable[q]))[:10]
        assert [v for v, _ in got[q]] == [i for _, i in want] and np.allclose([s for _, s in got[q]], [d for d, _ in want], atol=1e-12)
    assert len(got[500]) == 1 and nearest(df.limit(0), F.col("id") % 50 == 0).count() == 0


def test_nearest_in_double_precision(spark, monkeypatch):
    """Distances under the steps of single precision, components over its range, and heaps emptied between tiles."""
    from stocktake.llm import nearest as module

    monkeypatch.setattr(module, "HEAPS", 1)
    rows = [(0, [1.0, 2.0]), (1, [1.0 + 1e-9, 2.0]), (2, [1.0 + 2e-9, 2.0]), (3, [1e300, 1.0]), (100, [5.0, 5.0])]
    got = [(r.query_id, r.vec_id, r.score) for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 100 == 0).orderBy("query_id", "rank").collect()]
    assert [g[1] for g in got if g[0] == 0] == [1, 2, 100, 3] and [g[1] for g in got if g[0] == 100] == [2, 1, 0, 3]
    assert got[0][2] == (1.0 + 1e-9) - 1.0 and got[1][2] == (1.0 + 2e-9) - 1.0 and got[3][2] == math.inf


# ---- secrets ----------------------------------------------------------------------------------


def test_secrets(spark, odd):
    key = "q9Zx7Lr2Vw8Kp4Tn6Yb3Hd5"
    texts = [
        *odd, 'PassWord = "hunter22"', "token: abc", "AKIA" + "A" * 16, "AKIA" + "A" * 15, "hex " + "0123456789abcdef" * 2, "key " + key, "id 123e4567-e89b-12d3-a456-426614174000", "sum " + "0123456789ABCDEF" * 2,
        "name customer_account_number_2024_final", "éé " + key, "ſecret=abcdefgh", f"api_key={key}",
    ]
    found = secrets.find_secrets(table(spark, texts), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in found.collect()}
    n = len(odd)
    assert not any(got[i] for i in range(n))
    assert [[s[0] for s in got[n + i]] for i in range(12)] == [["assign"], [], ["access"], [], ["hex"], ["random"], [], [], [], ["random"], [], ["assign"]]
    assert got[n] == [("assign", 0, 20)] and got[n + 9] == [("random", 3, 3 + len(key))]
    assert secrets.find_secrets(table(spark, texts).limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_keys_without_digits_and_within_paths():
    encoding, key = secrets.vocabulary(P.path("byte_bpe_50k.tiktoken"), P.PATTERN), "q9Zx7Lr2Vw8Kp4Tn6Yb3Hd5"

    def of(text):
        return [text[a:b] for k, a, b in secrets.spans_of(text, encoding, 2.2) if k == "random"]

    assert of("qWzXkPvBnMtRyGhJdFsLcQwZ") == ["qWzXkPvBnMtRyGhJdFsLcQwZ"]
    assert of(f"see https://host/customers/accounts/archive/information/{key}/download for it") == [key]
    assert of(f"?session_information_of_the_customer={key}") == [key]
    for plain in ("customerAccountNumberFinalVersion", "internationalisation", "the_name_of_the_variable", "/usr/share/documents/information/archive", "=" * 40, "1234567890" * 4, "INTERNATIONALISATION"):
        assert of(plain) == []


def test_many_runs_and_base_spans():
    """Twice as many take about twice as long."""
    encoding, took = secrets.vocabulary(P.path("byte_bpe_50k.tiktoken"), P.PATTERN), []
    for n in (4_000, 16_000):
        text = " ".join(f"token={i:06d} q9Zx7Lr2Vw8Kp4Tn6Y{i:06d}" for i in range(n))
        began = time.process_time()
        assert len(secrets.spans_of(text, encoding, 2.2)) == 2 * n
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0]


def test_secrets_query(spark):
    """Base spans by the plain patterns, and the ratio of each further span, text by text."""
    from stocktake.llm.queries import op8_secrets

    folder = "/root/testdata/sf0.01"
    encoding = secrets.vocabulary(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    plain = (("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), lambda m: len(m[2]) >= 6), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24))
    rows = op8_secrets(spark, folder).collect()
    assert {r.doc_id for r in rows} == set(texts)
    more = 0
    for r in rows:
        text = texts[r.doc_id]
        base = sorted((m.start(), i, m.end(), k) for i, (k, p, good) in enumerate(plain) for m in p.finditer(text) if good(m))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(b[3] == k for b in base) for k, _, _ in plain)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{e}" for a, _, e, k in base).encode()).hexdigest()
        every = [x.split(":") for x in r.spans.split(",")] if r.spans else []
        assert {(k, int(a), int(e)) for k, a, e in every if k != "random"} == {(k, a, e) for a, _, e, k in base} and len(every) == r.n_spans
        for k, a, e in every:
            if k == "random":
                run = text[int(a) : int(e)]
                more += 1
                assert len(run) <= 2.2 * len(encoding.encode_ordinary(run)) and not any(s <= int(a) and int(e) <= x for s, _, x, _ in base)
    assert sum(r.n_assign + r.n_access + r.n_hex for r in rows) > 5


# ---- language model ---------------------------------------------------------------------------


def brute_score(train, text):
    """The weighting by its definition, node by node."""
    counts, kids = collections.Counter(), collections.defaultdict(set)

    def path(x, depth):
        return (x >> 18, x >> 13 & 31, x >> 8 & 31)[:depth]

    for t in train:
        for x in ct.symbols([t])[0].tolist():
            for depth in range(4):
                for k in range(8):
                    counts[path(x, depth), k, (x & 255) >> (8 - k), x >> (7 - k) & 1] += 1
                    if depth:
                        kids[path(x, depth - 1), k, (x & 255) >> (8 - k)].add(path(x, depth))

    def estimate(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    @lru_cache(None)
    def weighted(c, k, prefix):
        own = estimate(counts[c, k, prefix, 0], counts[c, k, prefix, 1])
        return own if len(c) == 3 else np.logaddexp(own, sum(weighted(x, k, prefix) for x in kids[c, k, prefix])) - math.log(2)

    total = 0.0
    for x in ct.symbols([text])[0].tolist():
        for k in range(8):
            prefix, bit, p = (x & 255) >> (8 - k), x >> (7 - k) & 1, None
            for depth in (3, 2, 1, 0):
                c = path(x, depth)
                n = counts[c, k, prefix, 0], counts[c, k, prefix, 1]
                own = (n[bit] + 0.5) / (sum(n) + 1)
                w = math.exp(estimate(*n) - math.log(2) - weighted(c, k, prefix)) if depth < 3 else 1
                p = own if depth == 3 else w * own + (1 - w) * p
            total += math.log10(p)
    return total


def test_context_tree():
    train, text = [b"the cat sat on the mat", "día höre 12.".encode(), b""], b"the hat, "
    index, count = np.unique(np.concatenate([ct.symbols([t])[0] for t in train]), return_counts=True)
    model = ct.probability_table(index, count)
    assert abs(model[ct.symbols([text])[0]].sum(dtype=float) - brute_score(train, text)) < 1e-4
    assert np.allclose((10 ** model.astype(float).reshape(-1, 256)[[0, 5000, 30000]]).sum(axis=1), 1, atol=1e-5)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=9).map(lambda b: bytes(x % 250 for x in b)), min_size=1, max_size=5))
def test_symbols_of_a_batch(raw):
    index, starts = ct.symbols(raw)
    assert [x.tolist() for x in np.split(index, starts[1:])] == [ct.symbols([r])[0].tolist() for r in raw]
    assert len(index) == sum(map(len, raw)) + len(raw)


def test_scores(spark, odd):
    texts = ["the cat Sat on the mat", "The DOG sat", "a b  c", *odd, "the cat sat on the mat"]
    low = [re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + [None] for t in texts]
    seen = collections.Counter(w for i, ws in enumerate(low) if i % 3 for w in ws)
    n, v = sum(seen.values()), len(seen)
    for frequent in (1, 10, 1_000_000):  # nearly all words by the join, some, none
        got = {r.doc_id: r for r in ct.score(table(spark, texts), F.col("doc_id") % 3 > 0, frequent=frequent).collect()}
        for i, ws in enumerate(low):
            r = got[i]
            assert (r.n_tokens, r.n_known, r.train_tokens, r.n_bytes) == (len(ws), sum(seen[w] > 0 for w in ws), n, len((texts[i] or "").encode()))
            assert math.isclose(r.base_score, sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9) and r.score < 0
    rows = spark.createDataFrame([(1, "x y"), (1, "x y"), (2, "x")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_tokens, r.n_known) for r in ct.score(rows, F.col("doc_id") == 2).collect()) == [(1, 3, 2), (1, 3, 2), (2, 2, 2)]
    nothing = ct.score(rows, F.lit(False)).collect()
    assert {(r.n_known, r.train_tokens, r.base_score) for r in nothing} == {(0, 0, 0.0)}
    assert ct.score(rows.limit(0)).count() == 0


def test_score_query(spark):
    """The query's own columns, token by token."""
    from stocktake.llm.queries import op5_context_tree

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    low = {i: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t)) + [None] for i, t in docs.items()}
    held_out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    seen = collections.Counter(w for i, ws in low.items() if not held_out[i] for w in ws)
    n, v = sum(seen.values()), len(seen)
    rows = op5_context_tree(spark, DATA).collect()
    assert {r.doc_id for r in rows} == set(docs)
    for r in rows:
        ws = low[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held_out[r.doc_id], len(ws), sum(seen[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert r.score < 0 and math.isfinite(r.score)


def brute_deep(train, text):
    """The weighting over all levels by its definition, node by node."""
    def path(x):
        classes = int(ct.class_of(np.array([x >> 8 * (ct.DEEP - 2)], np.uint64))[0])
        return [(), (classes >> 10,), (classes >> 5,), (0, classes), *((d, x >> 8 * (ct.DEEP + 1 - d)) for d in range(3, ct.DEEP + 1))]

    counts, kids = collections.Counter(), collections.defaultdict(set)
    for t in train:
        for x in ct.keys_of([t])[0].tolist():
            for k in range(8):
                for level, c in enumerate(path(x)):
                    counts[level, c, k, (x & 255) >> (8 - k), x >> (7 - k) & 1] += 1
                    if level:
                        kids[level - 1, path(x)[level - 1], k, (x & 255) >> (8 - k)].add((level, c))

    def estimate(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    last = ct.DEEP + 1

    @lru_cache(None)
    def log(level, c, k, prefix):
        own = estimate(counts[level, c, k, prefix, 0], counts[level, c, k, prefix, 1])
        return own if level == last else np.logaddexp(own, sum(log(*x, k, prefix) for x in kids[level, c, k, prefix])) - math.log(2)

    total = 0.0
    for x in ct.keys_of([text])[0].tolist():
        for k in range(8):
            prefix, bit, p = (x & 255) >> (8 - k), x >> (7 - k) & 1, None
            for level, c in reversed(list(enumerate(path(x)))):
                n = counts[level, c, k, prefix, 0], counts[level, c, k, prefix, 1]
                own = (n[bit] + 0.5) / (sum(n) + 1)
                w = math.exp(estimate(*n) - math.log(2) - log(level, c, k, prefix)) if level < last else 1
                p = own if level == last else w * own + (1 - w) * p
            total += math.log10(p)
    return total


def test_deep_contexts(spark, monkeypatch):
    """Contexts of real bytes beyond three, in several chunks and buckets, against the definition."""
    texts = ["the cat sat on the mat", "the cat Sat on the hat", "día höre 12. код 345; 12! мир", "", "the cat sat on the mat", "unseen цвет 99? on the mat", "x1 = 17; y2 = 28"] * 2
    docs = table(spark, texts)
    monkeypatch.setattr(ct, "CHUNK", 40)
    monkeypatch.setattr(ct, "BUCKETS", 5)
    got = {r.doc_id: r.score for r in ct.score(docs, F.col("doc_id") < 5).collect()}
    train = [t.encode() for t in texts[:5]]
    for i, t in enumerate(texts):
        assert abs(got[i] - brute_deep(train, t.encode())) < 1e-4, t


def test_deep_contexts_tell_digits_and_case_apart(spark):
    """Three classes say the same of both; only the bytes before tell what follows."""
    train = ["code 1234567a", "code 7654321b", "Abcdefg+", "aBCDEFG-"] * 30
    tests = ["code 1234567a", "code 1234567b", "Abcdefg+", "Abcdefg-"]
    got = {r.doc_id: r.score for r in ct.score(table(spark, train + tests), F.col("doc_id") < len(train)).collect()}
    right, wrong, plus, minus = (got[len(train) + i] for i in range(4))
    assert right > wrong + 0.5 and plus > minus + 0.5


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=9).map(lambda b: bytes(x % 250 for x in b)), min_size=1, max_size=5))
def test_keys_of_a_batch(raw):
    index, starts = ct.keys_of(raw)
    assert [x.tolist() for x in np.split(index, starts[1:])] == [ct.keys_of([r])[0].tolist() for r in raw]
    assert len(index) == sum(map(len, raw)) + len(raw)
    assert ((ct.class_of(index >> np.uint64(8 * (ct.DEEP - 2))) << np.uint64(8)) | (index & np.uint64(255))).tolist() == ct.symbols(raw)[0].tolist()
