"""Encoding, token counts and the token store against the tokenizers library."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plantlens.llm import bpe, token_counts, token_store

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
ENC = bpe.Encoder(PATH)
STORE = token_store.LibraryEncoder(PATH)


def ids(text):
    return LIB.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t 　'sdtab12é,.!漢"), st.characters(codec="utf-8")), max_size=60))
def test_same_ids_as_the_library(text):
    want = ids(text)
    assert np.frombuffer(ENC.encode(text), "<u4").tolist() == want
    assert ENC.decode(want) == LIB.decode(want, skip_special_tokens=False)
    assert np.frombuffer(STORE.encode(text), "<u4").tolist() == want


def test_long_word_same_ids():
    word = "thing" * 300 + "q" * 500
    assert np.frombuffer(ENC.encode(word), "<u4").tolist() == ids(word)


def test_encode_documents(docs_of, odd_texts):
    rows = bpe.encode_documents(docs_of(odd_texts), PATH, ids=True).collect()
    assert len(rows) == len(odd_texts)
    for r in rows:
        want = ids(odd_texts[r.doc_id])
        assert r.token_ids == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIB.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_token_store(docs_of, odd_texts, monkeypatch):
    keys = [None if i == 3 else (i * 7) % 23 for i in range(len(odd_texts))]
    rows = token_store.store_tokens(docs_of(odd_texts, keys), PATH).collect()
    texts = sorted(zip(keys, odd_texts), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    start = 0
    got = sorted(rows, key=lambda r: r.start)
    for (k, text), r in zip(texts, got, strict=True):
        want = np.array([*ids(text), 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (k, start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=60))
def test_code_round_trip(values):
    v = np.array(values, "<u4")
    assert token_store.unpack(*token_store.pack(v), len(v)).tolist() == values
    small = v % 70000
    assert token_store.decode_segment(*token_store.encode_segment(small), len(small)).tolist() == small.tolist()


def test_empty_tables(docs_of):
    empty = docs_of(["a"]).limit(0)
    assert token_store.store_tokens(empty, PATH).count() == 0
    assert bpe.encode_documents(empty, PATH).count() == 0
    assert token_counts.length_histogram(token_counts.document_lengths(empty, PATH, ["lang"]), ["lang"]).count() == 0


def test_histogram_against_plain_counting(docs_of, odd_texts):
    lengths = token_counts.document_lengths(docs_of(odd_texts), PATH, ["lang"])
    hist = token_counts.length_histogram(lengths, ["lang"])
    plain = [("en" if i % 2 else None, len(ids(t))) for i, t in enumerate(odd_texts)]
    rows = hist.collect()
    assert {(r.lang, r.n_tokens) for r in rows} == set(plain)
    for r in rows:
        own = [n for g, n in plain if g == r.lang]
        assert r.n_docs == own.count(r.n_tokens)
        assert r.docs_longer == sum(n > r.n_tokens for n in own)
        assert r.tokens_longer == sum(n for n in own if n > r.n_tokens)
        assert r.truncated_total == sum(min(n, r.n_tokens) for n in own)
        assert r.quantile == (len(own) - r.docs_longer) / len(own)
    cut = {(r.lang, r.context_limit): (r.tokens, r.docs_cut) for r in token_counts.truncated_totals(hist, [3, 100], ["lang"]).collect()}
    for (g, limit), (tokens, docs) in cut.items():
        own = [n for x, n in plain if x == g]
        assert tokens == sum(min(n, limit) for n in own) and docs == sum(n > limit for n in own)
    for r in token_counts.quantiles(hist, [0.5, 1.0], ["lang"]).collect():
        own = sorted(n for g, n in plain if g == r.lang)
        assert r.n_tokens == next(n for n in own if sum(x <= n for x in own) >= r.share * len(own))


def test_lengths_over_blocks(spark):
    lengths = spark.createDataFrame([(n * 700 % 5000,) for n in range(200)], "n_tokens long")
    plain = [n * 700 % 5000 for n in range(200)]
    for r in token_counts.length_histogram(lengths).collect():
        assert r.tokens_longer == sum(n for n in plain if n > r.n_tokens) and r.tokens_total == sum(plain)


def test_parts_grow_with_the_table(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i} " * 50) for i in range(400)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    monkeypatch.setattr(token_store, "PART_BYTES", 500)
    token_store.write_tokens(docs, str(tmp_path / "store"), PATH)
    store = spark.read.parquet(str(tmp_path / "store"))
    assert store.select("part").distinct().count() > 8
    got = token_store.read_tokens(spark, str(tmp_path / "store")).orderBy("doc_id").collect()
    at = 0
    for i, r in enumerate(got):
        want = [*ids(f"text {i} " * 50), token_store.END]
        assert (r.doc_id, r.start, r.n_tokens) == (i, at, len(want))
        at += len(want)


def test_lengths_with_clashing_columns(docs_of):
    rows = token_counts.document_lengths(docs_of(["a b", "a b", None, ""]), PATH, ["lang"]).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in rows) == [(0, len(ids("a b"))), (1, len(ids("a b"))), (2, 0), (3, 0)]


def test_white_space_before_a_single_space_is_no_cut():
    for text in ("é \xa0 \xa0\n\n語&&!", "x\t \ty", "a\n \nb"):
        assert np.frombuffer(STORE.encode(text), "<u4").tolist() == ids(text)
        assert np.frombuffer(ENC.encode(text), "<u4").tolist() == ids(text)


def test_marks_and_line_ends_make_no_pieces_of_their_own():
    """Words with a mark or a line's end behind them were pieces beside the bare words."""
    store, seen = token_store.LibraryEncoder(PATH), []
    encode = store.cache.encode
    store.cache.encode = store.cache.bare.encode = lambda piece: seen.append(piece) or encode(piece)
    text = "one two.\nThree two, one: two;\nThree two&&& one 12. été!"
    assert np.frombuffer(store.encode(text), "<u4").tolist() == ids(text)
    assert not [p for p in store.cache if p[:1] != "\0" and (p[-1:] in (".", ",", ":", ";", "!") or "\n" in p)]
    assert len(seen) == len(set(seen)) and {" two", " one", "Three"} <= set(seen)
