"""Benchmark decontamination by q-gram lemma filtering.

If a passage of m characters stands in a text with at most k edits, the two
share at least m + 1 - q (k + 1) q-grams, all on diagonals that lie within k of
each other. Shared q-grams are therefore counted in overlapping bands of
diagonals; a band that meets the bound is a region to verify, by an alignment
kept to the band.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import filter_rows, keep_in_worker, map_batches, mix64, slices, written

Q, EDIT_SHARE = 8, 0.1
#: Characters of benchmark items that one pass over the documents looks for.
BLOCK_CHARS = 4_000_000
FILTER_BITS = 22
_U = np.uint64
_B = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def lower_each(text: str) -> str:
    """Lower case, but for code points whose lower case is longer (U+0130)."""
    longer = {c for c in set(text) if len(c.lower()) != 1}
    # in their place a letter, so that their neighbours' lower case is that of a word's middle
    low = "".join("I" if c in longer else c for c in text).lower()
    return "".join(c if c in longer else x for c, x in zip(text, low))


@cache
def classes() -> np.ndarray:
    """For each code point 1 if it is white space, 2 if it takes no room: format
    characters such as the zero-width space and the soft hyphen."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if chr(c).isspace():
            out[c] = 1
        elif unicodedata.category(chr(c)) == "Cf":
            out[c] = 2
    return out


def normalise(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points in lower case with runs of any white space as one space and
    without those that take no room, the row of each, and its place in the row's own text."""
    low = [x if len(x := t.lower()) == len(t) else lower_each(t) for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    kind = classes()[points]
    if (kind == 2).any():
        seen = kind != 2
        points, owner, place, kind = points[seen], owner[seen], place[seen], kind[seen]
    space = kind == 1
    keep = np.ones(len(points), bool)
    keep[1:] = ~(space[1:] & space[:-1] & (owner[1:] == owner[:-1]))
    return np.where(space, 32, points).astype(np.uint32)[keep], owner[keep], place[keep]


def qgrams(points: np.ndarray, owner: np.ndarray, q: int = Q) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the q-gram at each place, and which of them lie in one row."""
    k = max(0, len(points) - q + 1)
    h, n = points.astype(_U) + _U(1), 1
    parts: list[tuple[np.ndarray, int]] = [(h, 1)]
    while 2 * n <= q:
        h = h[:-n] * _U(pow(_B, n, 1 << 64)) + h[n:] if len(h) > n else np.zeros(0, _U)
        n *= 2
        parts.append((h, n))
    out, at = np.zeros(k, _U), 0
    for h, n in reversed(parts):
        while at + n <= q and k:
            out = out * _U(pow(_B, n, 1 << 64)) + h[at : at + k]
            at += n
    return mix64(out), owner[:k] == owner[q - 1 :][:k] if k else np.zeros(0, bool)


def as_text(points: np.ndarray) -> str:
    return points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


@dataclass
class Items:
    """Benchmark items and an index of their q-grams."""

    ids: list[int]
    texts: list[str]
    q: int = Q
    share: float = EDIT_SHARE

    def __post_init__(self):
        points, owner, _ = normalise(self.texts)
        bounds = np.searchsorted(owner, np.arange(len(self.texts) + 1))
        self.points = [points[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        m = np.diff(bounds)
        self.edits = np.maximum(0, np.minimum((self.share * m).astype(np.int64), m // self.q - 1))
        self.least = np.maximum(1, m + 1 - self.q * (self.edits + 1))
        h, inside = qgrams(points, owner, self.q)
        at = np.flatnonzero(inside)
        order = np.argsort(h[at], kind="stable")
        at = at[order]
        self.item, self.place = owner[at], at - bounds[owner[at]]
        self.keys, self.first, self.count = np.unique(h[at], return_index=True, return_counts=True)
        self.mask = np.zeros(1 << FILTER_BITS, bool)
        self.mask[(self.keys & _U((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
        # items of fewer than q characters have no q-gram: they are looked for as they are
        self.short: dict[int, dict[str, list[int]]] = {}
        for i, p in enumerate(self.points):
            if 0 < len(p) < self.q and (t := as_text(p).strip(" ")):
                self.short.setdefault(len(t), {}).setdefault(t, []).append(i)
        self.short_keys = {n: np.sort(qgrams(*normalise(["".join(ts)])[:2], n)[0][::n]) for n, ts in self.short.items()}

    def short_places(self, points: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, first and last place + 1 among all points) of the items of
        fewer than q characters, where no word goes on beyond them."""
        for n, keys in self.short_keys.items():
            h, inside = qgrams(points, owner, n)
            slot = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            for a in np.flatnonzero((keys[slot] == h) & inside).tolist():
                b, row = a + n, int(owner[a])
                t = as_text(points[a:b])
                before = a > 0 and owner[a - 1] == row and chr(points[a - 1]).isalnum() and t[0].isalnum()
                after = b < len(points) and owner[b] == row and chr(points[b]).isalnum() and t[-1].isalnum()
                if not before and not after:
                    for item in self.short[n].get(t, ()):
                        yield row, item, a, b

    def regions(self, points: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, first and last diagonal) of every band over the bound.
        A diagonal is a place among all points less a place in the item."""
        h, inside = qgrams(points, owner, self.q)
        at = np.flatnonzero(self.mask[(h & _U((1 << FILTER_BITS) - 1)).astype(np.int64)] & inside)
        slot = np.searchsorted(self.keys, h[at])
        slot[slot == len(self.keys)] = 0
        hit = self.keys[slot] == h[at] if len(self.keys) else np.zeros(len(at), bool)
        at, slot = at[hit], slot[hit]
        n = self.count[slot]
        posting = np.repeat(self.first[slot] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        item, row = self.item[posting], owner[np.repeat(at, n)]
        diagonal = np.repeat(at, n) - self.place[posting]
        width = self.edits[item] + 1
        base = len(points) + 1
        bands = []
        for shift in (0, 1):  # bands of 2 (k + 1) diagonals, at every k + 1
            band = (diagonal // width + shift) // 2 + base
            key = (row * len(self.ids) + item) * (3 * base) + band
            name, back, total = np.unique(key, return_index=True, return_counts=True)
            over = total >= self.least[item[back]]
            for i in back[over].tolist():
                w = int(width[i])
                b = (int(diagonal[i]) // w + shift) // 2
                bands.append((int(row[i]), int(item[i]), (2 * b - shift) * w, (2 * b - shift + 2) * w - 1))
        # bands that overlap are one region, up to half an item's length
        region: list[int] = []
        for r, i, low, high in sorted(bands):
            if region and region[:2] == [r, i] and low <= region[3] and high - region[2] <= len(self.points[i]) // 2:
                region[3] = max(region[3], high)
                continue
            if region:
                yield tuple(region)
            region = [r, i, low, high]
        if region:
            yield tuple(region)

    def align(self, item: int, text: np.ndarray, low: int, high: int) -> tuple[int, int, int] | None:
        """Fewest edits (start and end in ``text``) of the item against any part
        of ``text`` on diagonals ``low`` to ``high``, if within the budget."""
        p, k = self.points[item], int(self.edits[item])
        whole = text[max(0, low) :].tobytes().find(p.tobytes())
        if whole >= 0 and whole % 4 == 0 and whole // 4 + max(0, low) <= high:  # on one diagonal, without edits
            return 0, whole // 4 + max(0, low), whole // 4 + max(0, low) + len(p)
        low, high = low - k, high + k
        offsets = np.arange(low, high + 1)
        far = len(p) + len(text) + 1
        inside = (offsets >= 0) & (offsets <= len(text))
        cost = np.where(inside, 0, far)
        start = offsets.copy()
        step = np.arange(len(offsets))
        width = len(offsets)
        padded = np.zeros(width + len(p), np.int64)  # 0 is beside no character of the text
        a, b = max(0, low), min(len(text), low + len(padded))
        padded[a - low : max(a, b) - low] = text[a:b].astype(np.int64) + 1
        for i, c in enumerate(p.tolist()):
            beside = padded[i : i + width]
            across = cost + (beside != c + 1)  # one row down, same diagonal
            across[beside == 0] = far
            down = cost[1:] + 1
            fewer = down < across[:-1]
            across[:-1][fewer] = down[fewer]
            start[:-1][fewer] = start[1:][fewer]
            run = across - step
            least = np.minimum.accumulate(run)
            source = np.maximum.accumulate(np.where(run == least, step, 0))
            cost, start = least + step, start[source]
            if i & 15 == 15 and cost.min() > k:
                return None
        end = offsets + len(p)
        cost = np.where((end >= 0) & (end <= len(text)), cost, far)
        best = int(np.argmin(cost))
        return (int(cost[best]), int(start[best]), int(end[best])) if cost[best] <= k else None

    def matches(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(row, item id, start, end, edits) of all matches, places in code
        points of the row's own text; of those that overlap, the best."""
        points, owner, place = normalise(texts)
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for row, item, low, high in self.regions(points, owner):
            a, b = int(bounds[row]), int(bounds[row + 1])
            k, m = int(self.edits[item]), len(self.points[item])
            cut = max(0, low - k - a)
            text = points[a:b][cut : max(0, high + k + m - a)]
            got = self.align(item, text, low - a - cut, high - a - cut)
            if got:
                found.setdefault((row, item), []).append((got[0], got[1] + cut, got[2] + cut))
        for row, item, s, e in self.short_places(points, owner):
            found.setdefault((row, item), []).append((0, s - int(bounds[row]), e - int(bounds[row])))
        out = []
        for (row, item), ms in found.items():
            taken: list[tuple[int, int]] = []
            for edits, s, e in sorted(ms):
                if all(e <= x or s >= y for x, y in taken):
                    taken.append((s, e))
                    at = place[bounds[row] : bounds[row + 1]]
                    out.append((row, self.ids[item], int(at[s]), int(at[e - 1]) + 1, edits))
        return sorted(out)


def _index_of(ids: list[int], texts: list[str]) -> Callable[[], Items]:
    name = f"items {uuid.uuid4().hex}"
    return lambda: keep_in_worker(name, lambda: Items(ids, texts))


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, chars: int) -> Iterator[tuple[Callable[[], Items], bool]]:
    """For each block of items what makes their index, which tasks do, and
    whether it is the only one. The driver holds the texts of one block."""
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).filter(F.length("t") > 0)
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = -(-total // chars)
    for b in range(n):
        rows = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).distinct().collect()
        rows.sort(key=lambda r: (r.i is None, r.i, r.t))
        if rows:
            yield _index_of([r.i for r in rows], [r.t for r in rows]), n == 1


def find_leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", chars: int = BLOCK_CHARS) -> DataFrame:
    """Every place of a benchmark item in a text: doc_id, item_id, start_char,
    end_char (code points of the text) and edits.

    An item may differ by a tenth of its characters, less for items so short
    that the bound of the lemma would be lost; upper case and white space do
    not count. Items of fewer than Q characters are found without edits and where
    no word goes on beyond them; null and blank items are not looked for. Null and empty texts hold nothing; repeated rows give repeated
    matches. The benchmark is split by a hash of its items into blocks of about
    ``chars`` characters; each block is one pass over the documents, and where
    there are several its places are written before the next block is read.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = "doc_id long, item_id long, start_char long, end_char long, edits int"
    out = None
    for make, only in _blocks(benchmark, item_col, item_text_col, chars):

        def run(batches: Iterator[pa.RecordBatch], make=make) -> Iterator[pa.RecordBatch]:
            items = make()
            for batch in batches:
                for part in slices(batch):
                    rows = items.matches(part.column(1).to_pylist())
                    row, *cols = zip(*rows) if rows else [()] * 5
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=["doc_id", "item_id", "start_char", "end_char", "edits"])

        some = map_batches(docs, run, schema)
        some = some if only else written(some, "leaks")
        out = some if out is None else out.union(some)
    return out if out is not None else df.sparkSession.createDataFrame([], schema)


def drop_leaks(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows that hold no benchmark item, unchanged."""
    for make, only in _blocks(benchmark, item_col, item_text_col, chars):

        def clean(texts: list[str], make=make) -> np.ndarray:
            keep = np.ones(len(texts), bool)
            keep[[m[0] for m in make().matches(texts)]] = False
            return keep

        df = filter_rows(df, text_col, clean)
        df = df if only else written(df, "clean")
    return df
