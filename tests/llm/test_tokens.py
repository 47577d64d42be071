import hashlib
import random

import numpy as np
import pytest
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stocktake.llm import bpe_codec
from stocktake.llm import token_counts as token_counts_module
from stocktake.llm._bpe import Merges
from stocktake.llm.bpe_codec import codec, concatenate, round_trip, tree
from stocktake.llm.token_counts import counter, token_counts

from .conftest import table

BYTES, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
byte_library, word_library = Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)
pieces = st.sampled_from(list("ab'sSretvmld ÀÉΣΑσ\t\n\r 12²½!?.,<|>́\x1c\x85\xa0日本🙂ſKİ")) | st.sampled_from(["<|endoftext|>", "<|startoftext|>", "  ", " \t", "the", "'re", "internationalization"]) | st.characters(exclude_categories=["Cs"])
texts = st.lists(pieces, max_size=40).map("".join)


@settings(max_examples=400, deadline=None)
@given(texts)
def test_counts_are_the_library_s(text):
    assert counter(BYTES)(text) == len(byte_library.encode(text, add_special_tokens=False).ids)


@settings(max_examples=400, deadline=None)
@given(texts)
def test_codes_are_the_library_s(text):
    ids, shown = codec(WORDS).round_trip(text)
    want = word_library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, np.int32).tolist() == want
    assert shown == word_library.decode(want, skip_special_tokens=False)


def test_letters_and_digits_are_the_library_s():
    """Each code point that the two Unicode versions could see in different ways, and others between them."""
    of, recent = counter(BYTES), token_counts_module.younger()
    every = [c for c in map(chr, range(0x80, 0x110000)) if not 0xD800 <= ord(c) < 0xE000]
    odd = [c for c in every if recent.match(c)]
    assert len(odd) > 10_000
    for c in [*odd, *every[:: 97]]:
        text = f"1{c}'re a{c}a"
        assert of(text) == len(byte_library.encode(text, add_special_tokens=False).ids), hex(ord(c))


def test_count_is_symbols_less_merges():
    merges = Merges(BYTES)
    for word in (b"", b"a", b" the", b"internationalization", b"\xff\xfe"):
        assert merges.count(word) == len(merges.encode(word)) <= len(word)


@pytest.mark.parametrize("seed", range(40))
def test_tree_concatenation(seed):
    rnd = random.Random(seed)
    merges = codec(WORDS).merges
    word = "".join(rnd.choice("aeinth"[: rnd.randint(1, 6)]) for _ in range(rnd.randint(1, 400)))
    raw, leaf = word.encode(), rnd.randint(1, 50)
    leaves = [merges.encode(raw[a : a + leaf], a + leaf >= len(raw)) for a in range(0, len(raw), leaf)]
    assert tree(merges, leaves) == merges.encode(raw) == word_library.encode(word, add_special_tokens=False).ids
    assert concatenate(merges, [], leaves[0], len(leaves) == 1) == leaves[0]


def test_tables(spark, odd, monkeypatch):
    monkeypatch.setattr(bpe_codec, "LONG_CHARS", 10_000)
    monkeypatch.setattr(bpe_codec, "PIECE_BYTES", 1000)
    odd = [*odd, "ab" * 5000 + " <|endoftext|> word " + "c" * 9000]
    got = {r.doc_id: r for r in token_counts(table(spark, odd), BYTES, limit=1024).collect()}
    for i, text in enumerate(odd):
        want = len(byte_library.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), want, want > 1024)
    coded = {r.doc_id: r for r in round_trip(table(spark, odd), WORDS).collect()}
    for i, text in enumerate(odd):
        want = word_library.encode(text or "", add_special_tokens=False).ids
        assert coded[i].ids == want and coded[i].decoded == word_library.decode(want, skip_special_tokens=False)
    empty = table(spark, odd).limit(0)
    assert token_counts(empty, BYTES).count() == 0 and round_trip(empty, WORDS).count() == 0


def test_query(spark):
    from stocktake.llm.queries import op6_bpe_codec

    rows = op6_bpe_codec(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        ids = word_library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(word_library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_count_query(spark):
    from stocktake.llm.queries import op10_token_counts

    rows = op10_token_counts(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        n = len(byte_library.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(docs[r.doc_id].encode()), n > 1024)
    assert {r.over_limit for r in rows} == {True, False}


def test_words_go_through_joins(monkeypatch):
    """On a given table: over half of the documents hold words of several leaves, which only concatenation makes."""
    import pyarrow.parquet as pq

    own, joined = bpe_codec.Codec(WORDS), []
    plain = bpe_codec.concatenate
    monkeypatch.setattr(bpe_codec, "concatenate", lambda *a: joined.append(1) or plain(*a))
    through = 0
    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()
    for text in rows:
        before = len(joined)
        own.ids_of_word.clear(), own.coded.clear()
        ids, _ = own.round_trip(text or "")
        assert np.frombuffer(ids, np.int32).tolist() == word_library.encode(text or "", add_special_tokens=False).ids
        through += len(joined) > before
    assert through > 0.5 * len(rows)
