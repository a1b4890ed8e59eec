"""Each stage against brute force on its own input."""

import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from plantlens.llm import minhash, quality
from plantlens.llm.common import table, written
from tests.llm.test_minhash import brute_force
from tests.llm.test_quality import frequent, lines_of, plain


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    docs, out = table(spark, sf_dir, "documents"), []
    for name, stage in cp.STAGES:
        new = written(stage(spark, docs, sf_dir), name)
        out.append((docs.toPandas(), new.toPandas(), docs.dtypes, new.dtypes))
        docs = new
    return dict(zip([n for n, _ in cp.STAGES], out))


def test_columns_stay_and_documents_go(steps):
    for before, after, kinds, new in list(steps.values())[:-1]:
        assert kinds == new
        assert 0 < len(after) < len(before) and set(after.doc_id) < set(before.doc_id)


def test_quality(steps):
    before, after, *_ = steps["quality_rules"]
    often = frequent(list(zip(before.source, before.text)), quality.LEAST_DOCUMENTS, quality.SHARE)
    want = {}
    for r in before.itertuples():
        n, *_, failed = plain(r.text)
        rest = [x for x in r.text.split("\n") if not x.strip() or (r.source, lines_of(x)[0]) not in often]
        left = plain("\n".join(rest))[0]
        if not failed and n - left <= 0.5 * n:
            want[r.doc_id] = "\n".join(rest) if left < n else r.text
    assert dict(zip(after.doc_id, after.text)) == want
    assert (after.n_chars == after.text.str.len()).all()


def test_toxicity(steps, spark, sf_dir):
    before, after, *_ = steps["toxicity"]
    toxic = table(spark, sf_dir, "labels").toPandas().set_index("doc_id").toxic
    gone = set(before.doc_id) - set(after.doc_id)
    known = [k for k in gone if k in toxic.index]
    assert np.mean([toxic[k] for k in known]) > 0.9
    insult = re.compile("idiot|moron|scum|worthless|pathetic|disgusting")
    assert sum(bool(insult.search(t)) for t in after.text) <= 0.2 * sum(bool(insult.search(t)) for t in before.text)


def test_near_dedup(steps):
    before, after, *_ = steps["near_dedup"]
    want = brute_force(list(zip(before.doc_id, before.text)), 5)
    assert set(after.doc_id) == {k for k, (_, c) in want.items() if k == c}


def test_decontamination(steps, spark, sf_dir):
    before, after, *_ = steps["decontamination"]
    flat = lambda s: re.sub(r"\s+", " ", s.lower())
    items = [flat(x.text) for x in table(spark, sf_dir, "benchmark").collect()]
    leaked = {k for k, t in zip(before.doc_id, before.text) if any(i in flat(t) for i in items)}
    assert leaked and set(before.doc_id) - set(after.doc_id) == leaked


def test_encoding(steps):
    before, after, *_ = steps["bpe"]
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = dict(zip(before.doc_id, before.text))
    assert set(after.doc_id) == set(text)
    for k, ids in zip(after.doc_id, after.token_ids):
        assert list(ids) == lib.encode(text[k], add_special_tokens=False).ids


def test_keep_first_of_repeated_rows(docs_of):
    docs = docs_of(["a b c d e f"] * 3 + ["x y", "x y", None], [4, 4, 2, 9, 9, None])
    assert sorted((r.doc_id or -1, r.text) for r in minhash.keep_first(docs).collect()) == [(-1, None), (2, "a b c d e f"), (9, "x y")]


def test_empty_documents(spark, sf_dir, steps):
    docs = table(spark, sf_dir, "documents")
    empty = written(docs.limit(0), "empty")
    for name, stage in cp.STAGES:
        out = stage(spark, empty, sf_dir)
        assert out.dtypes == steps[name][3] and out.count() == 0


def test_whole_chain_with_odd_rows(spark, sf_dir, steps):
    """Null ids, sources and texts, repeated rows, a very long text and columns
    whose names clash with those inside the stages: what is kept of the others
    is the same, the odd rows with words stay, and each document stands once."""
    plain_docs = table(spark, sf_dir, "documents")
    own = {c: F.lit(7) for c in ("gone", "again", "key", "rank", "rep", "host", "line", "score", "kept", "shingles", "token_ids")}
    words = lambda tag, n: " ".join(f"{tag}{i} stone" for i in range(n))
    odd = spark.createDataFrame([(None, words("river", 60)), (-1, words("hill", 40_000)), (-2, ""), (-3, None), (None, None)], "doc_id long, text string")
    again = plain_docs.filter(F.col("doc_id") == int(steps["bpe"][0].doc_id.iloc[0]))
    docs = plain_docs.unionByName(again).unionByName(again).unionByName(odd, allowMissingColumns=True).withColumns(own)
    kinds = docs.dtypes
    for name, stage in cp.STAGES:
        assert docs.dtypes == kinds
        docs = written(stage(spark, docs, sf_dir), f"odd-{name}")
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    assert sorted(ids, key=str) == sorted([*steps["bpe"][1].doc_id, None, -1], key=str)


def test_whole_run(spark, sf_dir, steps):
    rows = cp.run(spark, sf_dir)
    assert {r.doc_id for r in rows.select("doc_id").collect()} == set(steps["bpe"][1].doc_id)
