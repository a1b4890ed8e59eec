"""Packing against brute force over all divisions and the tokenizers library."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plantlens.llm import packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)
WORDS = packing.WordIds(PATH)


def ids_of(text):
    return LIB.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t\x1c\x85 　İΣé'stdab12.,!?漢"), st.characters(codec="utf-8")), max_size=60))
def test_same_ids_as_the_library(text):
    got, stops = WORDS.encode(text)
    assert got.tolist() == ids_of(text)
    assert all(0 < x < len(got) for x in stops) and (np.diff(stops) > 0).all()


def test_sentences_and_lines_end_pieces():
    got, stops = WORDS.encode("One two. Three four? five\nsix e.g. seven 3.5 eight")
    marks = [len(ids_of(x)) for x in ("One two.", "One two. Three four?", "One two. Three four? five\n", "One two. Three four? five\nsix e.g.")]
    assert stops.tolist() == marks


class Counting:
    """The library or its model, with a count of what it was asked for."""

    def __init__(self, inner):
        self.inner, self.asked = inner, 0

    def __getattr__(self, name):
        self.asked += name in ("encode", "tokenize")
        return getattr(self.inner, name)


def test_the_library_sees_each_word_of_the_pattern_once():
    words = packing.WordIds(PATH)
    words.lib, words.model = Counting(words.lib), Counting(words.model)
    some = "one two three four five six seven eight nine été".split()
    text = " ".join(f"{a}-{b}'s/{b.upper()}!! 7" for a in some for b in some)
    assert words.encode(text)[0].tolist() == ids_of(text)
    assert words.lib.asked + words.model.asked <= len(some) + len(["-", "'s", "/", "!!", "7"])


ODD = "don't it'll we've 'tis ''s x's' 'S'm I'D 12a3 ÀÉß×÷ ª µ ½ \u00a0 a\u0085b é' 'éd <|endoftext|> <| 漢 \x1c\x00 rock'n'roll abcdefghijklmnop abcdefghijklmnopq.".split(" ")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*ODD, "", ".", "\n", "word"]), max_size=8), max_size=6), st.sampled_from(["", " ", "'", "\n"]), st.sampled_from([1, 3, 64]))
def test_texts_of_a_batch_are_apart(rows, between, limit):
    words = packing.WordIds.__new__(packing.WordIds)
    words.__dict__.update(WORDS.__dict__)
    words.table = packing.WordTable(limit)
    texts = [between.join(row) for row in rows]
    got = [(ids.tolist(), stops.tolist()) for ids, stops in words.encode_all(pa.array(["skipped", *texts], pa.string())[1:])]
    assert [ids for ids, _ in got] == [ids_of(t) for t in texts]
    assert got == [(ids.tolist(), stops.tolist()) for ids, stops in map(WORDS.encode, texts)]


def cheapest(at, penalty, window, fee):
    """The least cost of all divisions, tried one by one."""
    best = {0: 0}
    for j in range(1, len(at)):
        tries = []
        for i in range(j):
            n = at[j] - at[i]
            if n <= window and i in best:
                tries.append(best[i] + (0 if n & (n - 1) == 0 else window - n) + fee + penalty[j])
        if tries:
            best[j] = min(tries)
    return best[len(at) - 1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 16), st.integers(0, 9)), min_size=1, max_size=40), st.integers(0, 5))
def test_cuts_against_all_divisions(steps, fee):
    at = np.concatenate([[0], np.cumsum([s for s, _ in steps])])
    penalty = np.array([0, *[p for _, p in steps]])
    chosen = packing.least_cost_cuts(at, penalty, 16, fee)
    length = np.diff(at[chosen])
    assert chosen[0] == 0 and chosen[-1] == len(at) - 1 and length.max() <= 16
    cost = sum((0 if n & (n - 1) == 0 else 16 - n) + fee for n in length.tolist()) + penalty[chosen[1:]].sum()
    assert cost == cheapest(at.tolist(), penalty.tolist(), 16, fee)


def checked(rows, texts, window):
    """Pieces cover every document once and sequences have no gap; the share of padding."""
    own, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        own[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    assert set(own) == set(texts)
    for k, found in own.items():
        want = [*ids_of(texts[k]), packing.END]
        found.sort(key=lambda r: r.start)
        at = 0
        for r in found:
            part = np.array(want[r.start : r.start + r.length], "<u4").tobytes()
            assert r.start == at and r.length > 0 and r.doc_tokens == len(want)
            assert (r.ids == part) if "ids" in r else (r.ids_crc32 == zlib.crc32(part))
            at += r.length
        assert at == len(want)
    padding = 0
    for found in seq.values():
        found.sort(key=lambda r: r.offset)
        assert [r.offset for r in found] == [sum(x.length for x in found[:i]) for i in range(len(found))]
        n = sum(r.length for r in found)
        assert n <= window
        padding += 0 if n & (n - 1) == 0 else window - n
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset))]
    assert order == sorted(order, key=lambda k: (k is not None, k or 0))
    return padding / sum(r.length for r in rows)


def test_odd_texts(docs_of, odd_texts):
    texts = {(None if i == 3 else i): t for i, t in enumerate([*odd_texts, "word " * 9000, "x" * 20_000])}
    rows = packing.pack_documents(docs_of(list(texts.values()), list(texts)), PATH).collect()
    checked(rows, texts, 4096)


def test_small_blocks_and_windows(docs_of, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 100)
    texts = {i: "A few words here. Then some more, and a stop. " * (i % 7) + "tail" for i in range(60)}
    rows = packing.pack_documents(docs_of(list(texts.values())).coalesce(1), PATH, window=64).collect()
    assert checked(rows, texts, 64) < 0.1


def test_repeated_rows_are_packed_each(docs_of):
    rows = packing.pack_documents(docs_of(["a b c.", "a b c."], [5, 5]), PATH).collect()
    assert {(r.doc_id, r.doc_tokens) for r in rows} == {(5, 5)}
    assert sum(r.length for r in rows) == 10 and [r.length for r in rows if r.start == 0].count(0) == 0


def test_empty_table_and_window(docs_of):
    assert packing.pack_documents(docs_of(["a"]).limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(docs_of(["a"]), PATH, window=1000)


def test_query_over_the_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op12_packing(spark, sf_dir).collect()
    assert checked(rows, texts, 4096) < 0.005


def test_long_text_is_cut(spark):
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 200_000).alias("text"))
    rows = packing.pack_documents(docs, PATH).collect()
    assert checked(rows, {0: "word " * 200_000}, 4096) < 0.001
