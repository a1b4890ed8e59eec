import numpy as np
import pytest

from plantlens.llm import graph, minhash


def words_of(text):
    return (text or "").encode().lower().split()


def brute_force(rows, n, percent=80):
    """doc_id to (set size, component), over all pairs."""
    sets = {}
    for k, text in rows:
        w = words_of(text)
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in keys}


def edited(rng, words, share):
    out = list(words)
    for i in np.flatnonzero(rng.random(len(out)) < share):
        out[i] = f"new{rng.integers(1e6)}"
    return out


@pytest.fixture(scope="module")
def copies():
    """Groups of copies at many distances, one of them much larger."""
    rng = np.random.default_rng(5)
    rows = []
    for group in range(12):
        base = [f"w{rng.integers(400)}" for _ in range(rng.integers(3, 120))]
        for _ in range(150 if group == 0 else 12):
            rows.append(" ".join(edited(rng, base, rng.choice([0, 0.02, 0.05, 0.1]))))
    return [(i * 3 % 1009, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("words", "block"), [(2, 1024), (5, 1024), (2, 256), (2, 8)])
def test_same_groups_as_all_pairs(spark, copies, monkeypatch, words, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    df = spark.createDataFrame(copies, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, words).collect()}
    assert got == brute_force(copies, words)


def test_odd_rows(docs_of, odd_texts):
    texts = [*odd_texts, "a", "a b", "A B", None, ""]
    rows = minhash.near_duplicates(docs_of(texts), 2).collect()
    want = brute_force(list(enumerate(texts)), 2)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_repeated_rows_null_ids_and_empty(spark, docs_of):
    rows = minhash.near_duplicates(docs_of(["a b c", "a b c", "a b c", "x y"], [5, 5, None, 7]), 2).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in rows) == [(-1, -1, True), (5, 5, True), (5, 5, True), (7, 7, True)]
    assert minhash.near_duplicates(docs_of(["a"]).limit(0)).count() == 0


def test_densified_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    both, own = rng.integers(0, 2**63, 80, dtype=np.uint64), rng.integers(0, 2**63, 20, dtype=np.uint64)
    two = [np.sort(np.concatenate([both, own[:10]]) * np.uint64(2)), np.sort(np.concatenate([both, own[10:]]) * np.uint64(2))]
    sig = minhash.signatures(np.concatenate(two), np.array([0, 90, 180]))
    assert abs((sig[0] == sig[1]).mean() - 0.8) < 0.15
    assert (sig != np.uint64(2**64 - 1)).all()


def test_components_of_chains_and_loops(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100), (200, 201), (201, 202), (202, 200), (None, 3)]
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {201: 200, 202: 200}


def test_keep_first_with_any_columns(spark):
    """Names of helper columns, names with dots, and types without an order."""
    text = "one two three four five six seven"
    rows = [(4, text, 1, 2, "x", {"k": "b"}), (4, text, 1, 2, "x", {"k": "a"}), (2, text, 0, 0, "y", None), (None, text, 5, 5, None, None), (9, None, 0, 0, None, None), (9, "", 0, 0, None, None), (7, "a b", 3, 3, "z", {"q": "q"})]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone int, again long, `kept.rows` string, r map<string,string>")
    got = minhash.keep_first(df)
    assert got.dtypes == df.dtypes
    assert sorted((r[0] or -1, r[2], r[5] and dict(r[5])) for r in got.collect()) == [(-1, 5, None), (2, 0, None), (7, 3, {"q": "q"}), (9, 0, None)]
    again = minhash.keep_first(df.filter("doc_id = 4"))
    assert [(r[0], dict(r[5])) for r in again.collect()] == [(4, {"k": "a"})]
