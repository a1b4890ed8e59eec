"""Licence scan with a generalised suffix automaton.

The automaton holds the words of all licence templates. Each text is streamed
through it once and leaves matching statistics: at every word, how long a
stretch of some template ends there. Phrases that the automaton knows whole are
found as suffixes of the current match. Long matches are chained, in order in
text and template, into template spans, whose covered share is the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from plantlens.llm.common import id_and_text, map_batches, text_bytes

#: Phrases and the labels they give.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Notices and sections of public licences, as words.
TEMPLATES = {
    "mit": [
        "the mit license mit",
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ],
    "apache-2": [
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "licensed under the apache license version 2 0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    ],
    "bsd-3": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ],
    "gpl": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"],
    "gpl-2": [
        "this work is licensed under the gnu general public license version 2",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    ],
    "gpl-3": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ],
    "lgpl-3": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license version 3"],
    "agpl-3": ["this work is licensed under the gnu affero general public license version 3"],
    "mpl-2": ["this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "this source code form is subject to the terms of the mozilla public license v 2 0"],
    "unlicense": [
        "this is free and unencumbered software released into the public domain",
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ],
    "cc-by": ["this work is licensed under a creative commons attribution 4 0 international license", "licensed under cc by 4 0"],
    "cc-by-sa": ["this work is licensed under a creative commons attribution sharealike 4 0 international license", "licensed under cc by sa 4 0"],
    "cc-by-nc": ["this work is licensed under a creative commons attribution noncommercial 4 0 international license", "licensed under cc by nc 4 0"],
    "cc-by-nd": ["this work is licensed under a creative commons attribution noderivatives 4 0 international license", "licensed under cc by nd 4 0"],
    "cc0": ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
}

#: Headings of whole licences, and the names of licences in SPDX tags, as words.
HEADINGS = {
    "apache-2": ["apache license version 2 0 january 2004"],
    "gpl-2": ["gnu general public license version 2 june 1991"],
    "gpl-3": ["gnu general public license version 3 29 june 2007"],
    "lgpl-2": ["gnu lesser general public license version 2 1 february 1999"],
    "lgpl-3": ["gnu lesser general public license version 3 29 june 2007"],
    "agpl-3": ["gnu affero general public license version 3 19 november 2007"],
    "mpl-2": ["mozilla public license version 2 0"],
}
SPDX = {
    "mit": "mit", "isc": "isc", "apache 2 0": "apache-2", "bsd 2 clause": "bsd", "bsd 3 clause": "bsd-3", "gpl 2 0": "gpl-2", "gpl 3 0": "gpl-3", "lgpl 2 1": "lgpl-2", "lgpl 3 0": "lgpl-3",
    "agpl 3 0": "agpl-3", "mpl 2 0": "mpl-2", "unlicense": "unlicense", "cc0 1 0": "cc0", "cc by 4 0": "cc-by", "cc by sa 4 0": "cc-by-sa", "cc by nc 4 0": "cc-by-nc", "cc by nd 4 0": "cc-by-nd",
}
for _label, _more in [*HEADINGS.items(), *((label, [f"spdx license identifier {name}"]) for name, label in SPDX.items())]:
    TEMPLATES[_label] = [*TEMPLATES.get(_label, []), *_more]

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LEAST_MATCH, MOST_GAP, LEAST_SHARE = 4, 12, 0.8


class SuffixAutomaton:
    """All stretches of words of several templates. For each state: next
    states, suffix link, greatest length, and the templates that hold it with
    the ends of all its places there."""

    def __init__(self, templates: Sequence[Sequence[bytes]], phrases: Sequence[Sequence[bytes]] = ()):
        self.words = {w: i for i, w in enumerate(dict.fromkeys(w for t in [*templates, *phrases] for w in t))}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.places: list[dict[int, set[int]]] = [{}]
        for k, template in enumerate([*templates, *phrases]):
            last = 0
            for end, word in enumerate(template):
                last = self._extend(last, self.words[word])
                if k < len(templates):
                    self.places[last].setdefault(k, set()).add(end)
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True)
        for s in order:
            if self.link[s] > 0:
                for k, ends in self.places[s].items():
                    self.places[self.link[s]].setdefault(k, set()).update(ends)
        own: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for p, phrase in enumerate(phrases):
            s = 0
            for word in phrase:
                s = self.next[s][self.words[word]]
            own[s].append((len(phrase), p))
        #: phrases that end wherever a state's stretch ends, if it is as long
        self.ending = own
        for s in reversed(order):
            if self.link[s] >= 0 and own[self.link[s]]:
                own[s] = own[s] + own[self.link[s]]

    def _new(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.places.append({})
        return len(self.next) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """A copy of q for the stretches of up to one word more than p's."""
        c = self._new(self.length[p] + 1)
        self.next[c], self.link[c] = dict(self.next[q]), self.link[q]
        self.link[q] = c
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, word: int) -> int:
        q = self.next[last].get(word)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        new, p = self._new(self.length[last] + 1), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def stream(self, words: Sequence[bytes], least: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """(start, phrase) of every phrase, and (end, length, state) of every
        match of at least ``least`` words that goes no further."""
        get, nxt, link, length, ending = self.words.get, self.next, self.link, self.length, self.ending
        found, matches = [], []
        state = n = 0
        for i, w in enumerate(words):
            k = get(w)
            if k is None:
                if n >= least:
                    matches.append((i - 1, n, state))
                state = n = 0
                continue
            to = nxt[state].get(k)
            if to is None:
                if n >= least:
                    matches.append((i - 1, n, state))
                while to is None and state > 0:
                    state = link[state]
                    n = length[state]
                    to = nxt[state].get(k)
                if to is None:
                    n = 0
                    continue
            state, n = to, n + 1
            if ending[state]:
                found += [(i - size + 1, p) for size, p in ending[state] if size <= n]
        if n >= least:
            matches.append((len(words) - 1, n, state))
        return found, matches


def chain(matches: Sequence[tuple[int, int, int]], gap: int = MOST_GAP) -> tuple[int, int, int]:
    """Most words of one template covered by matches in order, at most ``gap``
    words apart, and the text span of that chain: of several the shortest, then
    the first. matches: start in the text, start in the template, length; sorted
    by the first."""
    best = (0, 0, 0)
    live: list[tuple[int, int, int, int]] = []  # end in text, end in template, words, first word
    for at, t, n in matches:
        live = [k for k in live if at - k[0] <= gap]  # later matches start no earlier
        words, first = n, at
        for end, t_end, w, f in live:
            if at >= end and t >= t_end and (w + n, f) > (words, first):
                words, first = w + n, f
        live.append((at + n, t + n, words, first))
        best = max(best, (words, first, at + n - 1), key=lambda c: (c[0], c[1] - c[2], -c[1]))
    return best


class Scanner:
    def __init__(self, templates: Mapping[str, Sequence[str]] = TEMPLATES, phrases: Mapping[str, str] = PHRASES):
        cut = lambda s: s.encode().split()
        self.templates = [(label, cut(t)) for label, ts in templates.items() for t in ts]
        self.phrases = [*phrases.values()]
        self.automaton = SuffixAutomaton([t for _, t in self.templates], [cut(p) for p in phrases])

    def scan(self, text: bytes) -> tuple:
        words = WORD.findall(text.lower())
        found, matches = self.automaton.stream(words, LEAST_MATCH)
        base = {self.phrases[p] for _, p in found}
        labels, score, spans = set(base), 1.0 if base else 0.0, []
        per: dict[int, list[tuple[int, int, int]]] = {}
        for end, n, state in matches:
            for k, ends in self.automaton.places[state].items():
                per.setdefault(k, []).extend((end - n + 1, t_end - n + 1, n) for t_end in ends)
        long = []
        for k, ms in per.items():
            covered, first, last = chain(sorted(ms))
            share = covered / len(self.templates[k][1])
            score = max(score, share)
            if share >= LEAST_SHARE:
                long.append((k, covered, first, last, share))
        for k, covered, first, last, share in sorted(long):
            if not any(c > covered and f <= first and last <= z for _, c, f, z, _ in long):
                labels.add(self.templates[k][0])
                spans.append({"label": self.templates[k][0], "first_word": first, "last_word": last, "share": share})
        starts = [s for s, _ in found]
        return (
            len(words),
            len(found),
            min(starts, default=None),
            max(starts, default=None),
            ",".join(sorted(base)),
            ",".join(sorted(labels)),
            score,
            spans,
        )


SPANS = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("share", pa.float64())]))


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Mapping[str, Sequence[str]] = TEMPLATES, phrases: Mapping[str, str] = PHRASES) -> DataFrame:
    """Licences named or quoted in every whole text.

    Returns doc_id, n_words, n_base (places of phrases), first_word and
    last_word (their least and greatest start, else null), base_labels, labels,
    score (greatest covered share of a template; 1 where a phrase stands) and
    spans. A template has its best chain only, and none where another template
    covers more words of a span around it: licences that differ in a word are
    told apart. Null and empty texts have no words, empty labels and score 0.
    Repeated rows are scanned each; other columns are not read.
    """
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), SPANS]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        for batch in batches:
            rows = [scanner.scan(t) for t in text_bytes(batch.column(1))]
            cols = zip(*rows) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), k) for c, k in zip(cols, kinds)]], names=names)

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label string, first_word long, last_word long, share double>>"
    return map_batches(id_and_text(df, id_col, text_col), run, schema)
