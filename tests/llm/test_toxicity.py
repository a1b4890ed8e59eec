import zlib

import numpy as np
import pytest

from plantlens.llm import toxicity
from plantlens.llm.common import table


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    return toxicity.score_toxicity(docs, labels).join(labels, "doc_id").toPandas()


def test_held_out_accuracy(scored):
    held = scored[scored.held_out]
    assert (held.held_out == [zlib.crc32(str(k).encode()) % 4 == 2 for k in held.doc_id]).all()
    hit = ((held.predicted == 1) & (held.toxic == 1)).sum()
    assert hit / (held.predicted == 1).sum() > 0.9 and hit / (held.toxic == 1).sum() > 0.75
    assert held.score.between(0, 1).all() and ((held.score >= 0.3) == (held.predicted == 1)).all()


def test_odd_rows(docs_of, odd_texts, spark):
    labels = spark.createDataFrame([(1, None), (6, 1), (6, 0), (None, 1), (9, 0), (3, 0)], "doc_id long, toxic int")
    rows = toxicity.score_toxicity(docs_of([*odd_texts, "a"], [*range(len(odd_texts)), None]), labels).collect()
    assert len(rows) == len(odd_texts) + 1 and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in rows if r.doc_id in (0, 1)} == {next(r.score for r in rows if r.doc_id == 0)}


def test_no_labels_and_no_rows(docs_of, spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    docs = docs_of(["some words", None])
    assert all(r.score < 1e-6 for r in toxicity.score_toxicity(docs, labels).collect())
    assert toxicity.keep_civil(docs, labels).dtypes == docs.dtypes
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0


def test_ngrams_against_plain_slices():
    texts = ["Ab c", "", "é!x yz"]
    owner, feature = toxicity.ngrams(texts)
    plain = []
    for i, t in enumerate(texts):
        t = "".join(c if c.isalpha() else " " for c in f" {t.lower()} ")
        plain += [(i, t[k : k + n]) for n in toxicity.SIZES for k in range(len(t) - n + 1)]
    assert len(owner) == len(plain)
    assert len(set(zip(owner.tolist(), feature.tolist()))) == len(set(plain))


def test_logistic_finds_the_plane():
    rng = np.random.default_rng(1)
    x = rng.random((500, 3)).astype(np.float32)
    w, b = toxicity.logistic(x, (x[:, 0] > 0.5).astype(float), penalty=1e-4, steps=2000)
    assert ((x @ w + b > 0) == (x[:, 0] > 0.5)).mean() > 0.97


def test_scores_against_plain_recomputation(spark):
    """Counts, ratios, selection, fit and sigmoid over n-grams as strings; the fit by plain gradient steps."""
    rng = np.random.default_rng(7)
    words = ["river", "stone", "cloud", "paper", "green", "table", "Window", "garden"]
    rows = []
    for i in range(160):
        bad = int(i % 3 == 0)
        text = " ".join(rng.choice(words, 6)) + (f" {rng.choice(['vile', 'Scum'])}!" if bad and i % 12 else "")
        rows.append((i, None if i == 5 else text, bad))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 120], "doc_id long, toxic int")

    def grams(t):
        t = "".join(c if c.isalpha() else " " for c in f" {(t or '').lower()} ")
        return {t[k : k + n] for n in toxicity.SIZES for k in range(len(t) - n + 1)}

    sets = [grams(t) for _, t, _ in rows]
    learn = [i for i in range(120) if zlib.crc32(str(i).encode()) % 4 != 2]
    n = [sum(rows[i][2] == k for i in learn) for k in (0, 1)]
    ratio = {}
    for g in set().union(*(sets[i] for i in learn)):
        c = [sum(g in sets[i] for i in learn if rows[i][2] == k) for k in (0, 1)]
        a, b = c[1] + 1, c[0] + 1
        share = (a + b) / (sum(n) + 2)
        g2 = 2 * (a * np.log(a / (n[1] + 1) / share) + b * np.log(b / (n[0] + 1) / share))
        if sum(c) >= toxicity.LEAST_ROWS and g2 >= toxicity.LEAST_G2:
            ratio[g] = np.log(a / (n[1] + 2)) - np.log(b / (n[0] + 2))
    names = sorted(ratio)
    x = np.array([[ratio[g] * (g in s) for g in names] for s in sets])
    y = np.array([r[2] for r in rows], float)
    w, bias = np.zeros(len(names)), 0.0
    for _ in range(60_000):
        p = 1 / (1 + np.exp(-(x[learn] @ w + bias)))
        w -= 0.05 * (x[learn].T @ (p - y[learn]) / len(learn) + toxicity.PENALTY * w)
        bias -= 0.05 * (p - y[learn]).mean()
    want = 1 / (1 + np.exp(-(x @ w + bias)))
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, labels).collect()}
    assert len(names) > 5 and max(abs(got[i] - want[i]) for i in range(160)) < 0.02


def test_windows_and_long_texts(monkeypatch):
    texts = ["Ab c", "", "é!x yz", "long words " * 300, "ab"]
    whole = toxicity.ngrams(texts)
    want = set(zip(*map(np.ndarray.tolist, whole)))
    for window in (7, 64, 1 << 17):
        monkeypatch.setattr(toxicity, "WINDOW", window)
        assert set(zip(*map(np.ndarray.tolist, toxicity.distinct_ngrams(texts)))) == want
    slots = np.full(toxicity.BUCKETS, -1, np.int32)
    slots[np.unique(whole[1])[::2]] = np.arange(len(np.unique(whole[1])[::2]))
    assert set(zip(*map(np.ndarray.tolist, toxicity.distinct_ngrams(texts, slots)))) == {(r, int(slots[f])) for r, f in want if slots[f] >= 0}


def test_repeated_ids_and_clashing_columns(spark):
    """Of several texts of an id the least is learnt, however the rows are split."""
    rows = [(i, f"plain words {i}" if i % 2 else f"vile scum {i}", "x", 1.0) for i in range(40)] + [(i, "zz other text", "y", 0.5) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string, score double")
    labels = spark.createDataFrame([(i, 1 - i % 2, 3) for i in range(40)], "doc_id long, toxic int, n long")
    got = [sorted((r.doc_id, r.score) for r in toxicity.score_toxicity(df.repartition(n), labels).collect()) for n in (1, 5)]
    assert got[0] == got[1] and len(got[0]) == 80
    assert toxicity.keep_civil(df, labels).columns == df.columns
