import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plantlens.llm import licenses as lic
from plantlens.llm.common import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for p, label in lic.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


PARTS = ["under the MIT License", "Apache License, Version 2.0", "CC BY-NC 4.0", "under the mit", "license", "cc by", "nc", "version", "2", "the", "under", "x", "É", "apache-license version 2", "\n", "."]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=30))
def test_base_places(parts):
    text = " ".join(parts)
    assert lic.Scanner().scan(text.encode())[:5] == base(text)


def test_matching_statistics_are_longest_stretches():
    rng = np.random.default_rng(1)
    words = [b"a", b"b", b"c"]
    templates = [[words[i] for i in rng.integers(0, 3, 12)] for _ in range(3)]
    automaton = lic.SuffixAutomaton(templates, [[b"a", b"b"]])
    parts = {tuple(t[i:j]) for t in templates for i in range(12) for j in range(i + 1, 13)}
    for _ in range(100):
        text = [[*words, b"z"][i] for i in rng.integers(0, 4, 15)]
        longest = [max((n for n in range(1, e + 2) if tuple(text[e + 1 - n : e + 1]) in parts), default=0) for e in range(15)]
        found, matches = automaton.stream(text, 1)
        ends = {e: n for e, n, _ in matches}
        want = {e: n for e, n in enumerate(longest) if n and (e == 14 or longest[e + 1] != n + 1)}
        assert ends == want
        assert sorted(s for s, _ in found) == [i for i in range(14) if text[i : i + 2] == [b"a", b"b"]]
        for e, n, state in matches:
            part = text[e + 1 - n : e + 1]
            at = {k: {i + n - 1 for i in range(13 - n) if t[i : i + n] == part} for k, t in enumerate(templates)}
            assert automaton.places[state] == {k: ends for k, ends in at.items() if ends}


def best_chain(matches, gap):
    """Of all chains: most words, the shortest span, the first."""
    chains, grown = [], [[m] for m in matches]
    while grown:
        chains += grown
        grown = [[*c, m] for c in grown for m in matches if c[-1][0] + c[-1][2] <= m[0] <= c[-1][0] + c[-1][2] + gap and m[1] >= c[-1][1] + c[-1][2]]
    spans = [(sum(n for _, _, n in c), c[0][0], c[-1][0] + c[-1][2] - 1) for c in chains]
    return min(spans, key=lambda s: (-s[0], s[2] - s[1], s[1]), default=(0, 0, 0))


def test_chain_against_all_chains():
    rng = np.random.default_rng(2)
    for _ in range(300):
        matches = sorted((int(a), int(t), int(n)) for a, t, n in zip(rng.integers(0, 25, 8), rng.integers(0, 15, 8), rng.integers(1, 6, 8)))
        assert lic.chain(matches, 4) == best_chain(matches, 4)
    # a short match far behind does not hide a long one that ends nearer
    assert lic.chain([(0, 0, 300), (10, 50, 4), (305, 300, 4)]) == (304, 0, 308)


def test_labels_and_score_against_brute_force():
    rng = np.random.default_rng(3)
    words = ["a", "b", "c", "d"]
    some = lambda n: " ".join(words[i] for i in rng.integers(0, 4, n))
    for _ in range(40):
        templates = {x: [some(int(n)) for n in rng.integers(5, 9, 2)] for x in ("p", "q", "r")}
        flat = [(x, t.split()) for x, ts in templates.items() for t in ts]
        phrases = {"a b c d a": "base"}
        scanner = lic.Scanner(templates, phrases)
        for _ in range(5):
            text = " z ".join(some(int(n)) for n in rng.integers(2, 10, 3)).split()
            places = lambda part: [(k, i) for k, (_, t) in enumerate(flat) for i in range(len(t)) if t[i : i + len(part)] == part]  # noqa: B023, E731
            known = [t for _, t in flat] + [p.split() for p in phrases]
            stands = lambda part: any(t[i : i + len(part)] == part for t in known for i in range(len(t)))  # noqa: B023, E731
            longest = [max((n for n in range(1, e + 2) if stands(text[e + 1 - n : e + 1])), default=0) for e in range(len(text))]
            ends = [e for e, n in enumerate(longest) if n >= lic.LEAST_MATCH and (e + 1 == len(text) or longest[e + 1] != n + 1)]
            per = {}
            for e in ends:
                for k, i in places(text[e + 1 - longest[e] : e + 1]):
                    per.setdefault(k, []).append((e + 1 - longest[e], i, longest[e]))
            found = {k: best_chain(sorted(ms), lic.MOST_GAP) for k, ms in per.items()}
            base = {"base"} if any(text[i : i + 5] == "a b c d a".split() for i in range(len(text))) else set()
            share = {k: c[0] / len(flat[k][1]) for k, c in found.items()}
            long = {k: found[k] for k in found if share[k] >= lic.LEAST_SHARE}
            inside = lambda k: any(c[0] > long[k][0] and c[1] <= long[k][1] and long[k][2] <= c[2] for c in long.values())  # noqa: B023, E731
            labels = base | {flat[k][0] for k in long if not inside(k)}
            got = scanner.scan(" ".join(text).encode())
            assert got[4:7] == (",".join(base), ",".join(sorted(labels)), 1.0 if base else max(share.values(), default=0.0))


def test_licences_that_differ_in_a_word():
    label = lambda t: lic.Scanner().scan(t.encode())[5]
    gpl = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    nc = "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."
    by = nc.replace("-NonCommercial", "")
    assert label(gpl.format(2)) == "gpl-2" and label(gpl.format(3)) == "gpl-3"
    assert label(nc) == "cc-by-nc" and label(by) == "cc-by"
    assert label(nc + " Fish swim far below the old bridge. " + by) == "cc-by,cc-by-nc"
    assert label("The MIT License (MIT)") == "mit"


def test_labels_of_templates(spark):
    texts = {
        0: "This work is licensed under the GNU General Public License, version 3.",
        1: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above NEW copyright notice and this permission notice appear in all copies.",
        2: "We fish under the bridge and redistribute nothing.",
        3: "Licensed under CC BY-NC 4.0.",
    }
    rows = {r.doc_id: r for r in lic.scan_licenses(spark.createDataFrame([*texts.items()], "doc_id long, text string")).collect()}
    assert rows[0].labels == "gpl-3" and rows[0].score == 1.0 and rows[0].base_labels == ""
    assert "isc" in rows[1].labels and 0.8 < rows[1].score <= 1.0 and rows[1].spans[0].first_word == 0
    assert rows[2].labels == "" and rows[2].score < 0.8
    assert rows[3].base_labels == "cc-by-nc" and "cc-by-nc" in rows[3].labels


def test_odd_rows(docs_of, odd_texts):
    rows = lic.scan_licenses(docs_of(odd_texts)).collect()
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(odd_texts[r.doc_id]) and 0 <= r.score <= 1
    assert len(rows) == len(odd_texts) and lic.scan_licenses(docs_of(["a"]).limit(0)).count() == 0


def test_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in lic.scan_licenses(docs).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(text[r.doc_id])


@pytest.mark.parametrize(
    "text, labels",
    [
        ("// SPDX-License-Identifier: MIT", "mit"),
        ("# SPDX-License-Identifier: GPL-3.0-or-later", "gpl-3"),
        ("/* SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note */", "gpl-2"),
        ("SPDX-License-Identifier: CC-BY-NC-4.0", "cc-by-nc"),
        ("SPDX-License-Identifier: CC-BY-4.0", "cc-by"),
        ("SPDX-License-Identifier: BSD-2-Clause", "bsd"),
        ("SPDX-License-Identifier: of another kind", ""),
        ("GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007", "gpl-3"),
        ("GNU LESSER GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007", "lgpl-3"),
        ("GNU AFFERO GENERAL PUBLIC LICENSE\n Version 3, 19 November 2007", "agpl-3"),
        ("GNU GENERAL PUBLIC LICENSE\n Version 2, June 1991", "gpl-2"),
        ("the gnu general public license of june 2007", ""),
    ],
)
def test_headings_and_identifiers(text, labels):
    found = lic.Scanner().scan(text.encode())
    assert found[5] == labels
    assert (len(found[7]) == 1) == bool(labels)
