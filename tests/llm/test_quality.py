import re
from collections import Counter, defaultdict

import numpy as np

from plantlens.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    tri = Counter(zip(w, w[1:], w[2:]))
    hit = set()
    for i in range(len(w) - 2):
        if tri[tuple(w[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n


def lines_of(text):
    return [" ".join(re.sub("[A-Z]", lambda m: m[0].lower(), x).split()) for x in map(lambda y: " ".join(WORD.findall(y)), (text or "").split("\n")) if x]


def frequent(rows, least, share):
    docs, count = defaultdict(set), defaultdict(set)
    for host, text in rows:
        docs[host].add(text)
        for x in lines_of(text):
            count[host, x].add(text)
    return {k for k, v in count.items() if len(v) > least and len(v) > share * len(docs[k[0]])}


def sample():
    rng = np.random.default_rng(2)
    line = lambda n: " ".join(f"W{rng.integers(300)}" for _ in range(n))
    rows = []
    for i in range(300):
        host = rng.choice(["a", "a", "b", ""])
        body = [line(rng.integers(5, 40)) for _ in range(rng.integers(1, 5))]
        if rng.random() < 0.5:
            body.insert(rng.integers(len(body) + 1), rng.choice(["All rights  reserved.", "ALL RIGHTS reserved. "]))
        if rng.random() < 0.2:
            body += body[:1]
        rows.append((i, "\n".join(body), host))
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(50)]
    return rows


def test_counts_and_verdicts(spark, odd_texts):
    rows = sample() + [(5000 + i, t, "b") for i, t in enumerate(odd_texts)] + [(7000, "one two " * 60, "b"), (7001, "x y\nx y\n\nx y \n" * 40, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    text, host = {r[0]: r[1] for r in rows}, {r[0]: r[2] or "" for r in rows}
    often = frequent([(r[2] or "", r[1] or "") for r in rows], 10, 0.3)
    assert often
    for r in quality.judge(df, least=10, share=0.3).collect():
        n, chars, symbols, dup, repeat, failed = plain(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n, chars, symbols, dup, repeat, failed), text[r.doc_id][:80]
        gone = sum(len(x.split()) for x in lines_of(text[r.doc_id]) if (host[r.doc_id], x) in often)
        assert r.removed_words == gone
        assert r.kept == (not failed and not gone > 0.5 * n)


def test_cleaned_rows_keep_their_columns(spark):
    rows = [(*r, len(r[1]), i) for i, r in enumerate(sample())]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int, kept int")
    out = quality.keep_good(df, least=10, share=0.3)
    assert out.dtypes == df.dtypes
    often = frequent([(r[2], r[1]) for r in rows], 10, 0.3)
    text = {r[0]: r[1] for r in rows}
    got = out.collect()
    assert 0 < len(got) < len(rows)
    for r in got:
        want = [x for x in text[r.doc_id].split("\n") if (r.source, lines_of(x)[0]) not in often]
        assert r.text == "\n".join(want) and r.n_chars == len(r.text)


def test_rows_get_only_their_own_frequent_lines(spark):
    """A list of all frequent lines of a host would have no bound without a share."""
    rows = [(i, f"shared {i // 3}\nalone {i}", "a") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    assert quality.frequent_lines(df, 2, 0.0).count() == 20
    got = quality._with_frequent(df, "text", "source", 2, 0.0).collect()
    assert len(got) == len(rows) and all(len(r[quality.FREQUENT]) == 1 for r in got)


def test_empty_table(docs_of):
    assert quality.judge(docs_of(["a"]).limit(0)).count() == 0


def test_columns_of_the_names_used_inside(spark):
    text = "\n".join(" ".join(f"w{i}{c}" for c in "abcdefgh") for i in range(9))
    rows = [(1, text, "s", 1, 2, "x", "y", "z", "w"), (2, None, None, 1, 2, "x", "y", "z", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, frequent_lines_host long, frequent_lines_of_text long, host string, content string, lines string, _host string")
    got = quality.keep_good(df)
    assert got.columns == df.columns and [tuple(r) for r in got.collect()] == [rows[0]]
