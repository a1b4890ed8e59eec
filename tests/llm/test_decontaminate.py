import re

import numpy as np
import pytest

from plantlens.llm import decontaminate as dc


def distance(item, text):
    """Fewest edits of the item against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edit(rng, text, n):
    out = list(text)
    for _ in range(n):
        i = rng.integers(len(out))
        kind = rng.integers(3)
        if kind == 0:
            out[i] = rng.choice(list("abcxyzé"))
        elif kind == 1:
            out.insert(i, rng.choice(list("abcxyz ")))
        else:
            del out[i]
    return "".join(out)


def make(seed=4):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefghimnoé"), rng.integers(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(rng.integers(4, 40))) for i in range(12)]
    docs = []
    for i in range(160):
        body = text(rng.integers(0, 60))
        _, t = items[rng.integers(12)]
        if i % 2:
            body += " " + edit(rng, t, rng.integers(0, max(1, len(t) // 7))) + " " + text(rng.integers(0, 30))
        docs.append((i, body))
    return items, docs


def plain(s):
    return re.sub(" +", " ", s.lower())


def test_same_documents_as_whole_alignment(spark):
    items, docs = make()
    found = dc.find_leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): r.edits for r in found}
    want = {}
    for k, t in items:
        m = len(t)
        budget = max(0, min(int(dc.EDIT_SHARE * m), m // dc.Q - 1))
        for i, d in docs:
            if (n := distance(plain(t), plain(d))) <= budget:
                want[i, k] = n
    assert len(want) > 40
    assert got == want
    text = dict(docs)
    for r in found:
        assert abs(r.end_char - r.start_char - len(dict(items)[r.item_id])) <= r.edits
        assert distance(plain(dict(items)[r.item_id]), plain(text[r.doc_id][r.start_char : r.end_char])) == r.edits


def test_blocks_and_drop(spark):
    items, docs = make(9)
    d, b = spark.createDataFrame([(*x, "u") for x in docs], "doc_id long, text string, row_of_table string"), spark.createDataFrame(items, "item_id long, text string")
    whole = {tuple(r) for r in dc.find_leaks(d, b).collect()}
    assert {tuple(r) for r in dc.find_leaks(d, b, chars=300).collect()} == whole
    kept = dc.drop_leaks(d, b, chars=300)
    assert kept.dtypes == d.dtypes
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {r[0] for r in whole}


def test_odd_rows(docs_of, odd_texts, spark):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (4, "Some  passage\nto look FOR here"), (4, "Some  passage\nto look FOR here"), (None, "another passage of the set")], "item_id long, text string")
    texts = [*odd_texts, "so SOME passage to  look for here, and some passage to look for here", "another passage of the set"]
    rows = dc.find_leaks(docs_of(texts), items).collect()
    n = len(odd_texts)
    assert sorted((r.doc_id, r.item_id or -1, r.start_char, r.edits) for r in rows) == [(n, 4, 3, 0), (n, 4, 39, 0), (n + 1, -1, 0, 0)]
    assert dc.find_leaks(docs_of(["a"]).limit(0), items).count() == 0
    assert dc.find_leaks(docs_of(texts), items.limit(0)).count() == 0


def test_case_does_not_count_beside_letters_of_longer_lower_case(docs_of, spark):
    item = "some passage to look for here, with acronyms in it such as nasa and unesco"
    text = "\u0130stanbul: " + item.upper()
    rows = dc.find_leaks(docs_of([text]), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [(r.item_id, r.start_char, r.end_char, r.edits) for r in rows] == [(1, 10, len(text), 0)]
    assert dc.lower_each("\u0391\u03a3\u0130 \u0391\u03a3") == "\u03b1\u03c3\u0130 \u03b1\u03c2"


def test_short_items_are_found_between_words(docs_of, spark):
    items = spark.createDataFrame([(1, "Yes"), (2, " x  = 1\n"), (3, "a"), (3, "a"), (4, "(b)"), (5, "  "), (6, "yes")], "item_id long, text string")
    texts = ["oh YES, yes; yesterday", "x =\t1 and x = 12", "fa(b)c", "eyes", None, "a"]
    want = {(0, k, s, e) for k in (1, 6) for s, e in ((3, 6), (8, 11))} | {(1, 2, 0, 5), (2, 4, 2, 5), (5, 3, 0, 1)}
    for chars in (dc.BLOCK_CHARS, 4):
        got = dc.find_leaks(docs_of(texts), items, chars=chars).collect()
        assert sorted((r.doc_id, r.item_id, r.start_char, r.end_char) for r in got) == sorted(want)
        assert all(r.edits == 0 for r in got)
        assert sorted(r.doc_id for r in dc.drop_leaks(docs_of(texts), items, chars=chars).collect()) == [3, 4]


@pytest.mark.parametrize("q", [1, 3, 8, 11])
def test_qgram_hashes(q):
    points = np.frombuffer("abcabcabcabcabd".encode("utf-32-le"), np.uint32)
    h, _ = dc.qgrams(points, np.zeros(len(points), int), q)
    s = "abcabcabcabcabd"
    grams = [s[i : i + q] for i in range(len(s) - q + 1)]
    assert len(h) == len(grams)
    assert all((h[i] == h[j]) == (grams[i] == grams[j]) for i in range(len(h)) for j in range(len(h)))


def test_several_blocks_leave_nothing_in_the_driver(spark):
    """Each block's places are read from what it has written."""
    items = [(i, f"benchmark item number {i} of a long list of questions about rivers and {'hills' * (i % 5)}") for i in range(12)]
    texts = [f"Some text before. {t.upper()} And after it {j}." for j, (_, t) in enumerate(items)] + ["clean text of no item at all"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dc.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string"), chars=200)
    assert {(r.doc_id, r.item_id) for r in got.collect()} >= {(j, i) for j, (i, _) in enumerate(items)}
    assert "MapInArrow" not in got._jdf.queryExecution().toString()
    assert [r.doc_id for r in dc.drop_leaks(docs, spark.createDataFrame(items, "item_id long, text string"), chars=200).collect()] == [12]


def test_any_white_space_and_none_at_all(spark):
    """Spaces of any kind are one, and marks that take no room are not there."""
    item = "the quick brown fox jumps over the lazy dog beside a river bank"
    spaces = ["\u2003", "\u3000", "\u202f", "\u2009\u2009", "\x85", "\u2028", "\t\n"]
    texts = [f"before {item.replace(' ', c)} after" for c in spaces] + [item.replace("o", "o\u200b").replace("r", "r\u00ad"), item.replace(" ", "\u200b"), "nothing of it"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in dc.find_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == set(range(len(spaces) + 1))
