"""Packing of documents into sequences of a fixed window, order kept.

The ids of consecutive documents are one line; a window is cut out of it at
the end of a document, of a sentence, or, where a sentence is long, inside of it.
Dynamic programming over the cuts finds the line's windows of least cost: the
padding of each, a cost for each sequence, and a penalty for each document that
a cut truncates. A sequence whose length is a power of two needs no padding.

The least cost up to a cut is ``f[j] = W - p[j] + min(f[i] + p[i])`` over the
cuts i at most a window back, which a monotone queue holds, or that of one of
the few cuts that lie a power of two back.

Documents go by doc_id to parts, each a line of its own, and a task packs
its line block by block, holding one block and the unfinished window.
"""

from __future__ import annotations

import os
from array import array
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.llm.bpe import printable_bytes
from plantlens.llm.common import byte_view, id_and_text, keep_in_worker, map_batches, parts_by_size, slices

WINDOW = 4096
END = 2
BLOCK_TOKENS = 1 << 20
#: Sentences longer than this may be cut at each multiple of it.
STRIDE = 64
#: Costs in tokens: of a sequence, and of a document cut at a sentence's end or inside a sentence.
SEQUENCE_COST, SENTENCE_COST, INSIDE_COST = 8, 4, 64
#: Long words, and pieces, that a worker keeps in each of two generations.
KEPT = 400_000
#: Distinct words that a worker keeps.
WORDS = 1 << 20
#: Longer words, in bytes, are kept one by one.
KEY = 16
BLOCK_WORDS = 1 << 17
#: Set in the last id of a piece that ends a sentence, and in the mark of a line's end.
_STOP = np.uint32(1 << 31)
_LINE = np.uint32(0xFFFFFFFF)


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of each Latin-1 character. _HARD are digits beyond
    ASCII and control characters."""
    kind, lower = np.full(256, _HARD, np.uint8), np.arange(256, dtype=np.uint8)
    for i in [*range(0x20, 0x7F), *range(0xA1, 0x100)]:
        c = chr(i)
        lower[i] = ord(c.lower())
        kind[i] = _LETTER if c.isalpha() else _SYMBOL if not c.isnumeric() else _DIGIT if c.isascii() else _HARD
    kind[[0x09, 0x0A, 0x0D, 0x20, 0x85, 0xA0]] = _SPACE
    return kind, lower


_SPACE, _LETTER, _DIGIT, _SYMBOL, _HARD = range(5)
_KIND, _LOWER = _classes()
_ENDS_SENTENCE = np.isin(np.arange(256), [ord(c) for c in ".!?"])
_SHORTENED = np.isin(np.arange(256), [ord(c) for c in "stmd"])
#: The first so many bytes of eight, as an integer of them.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_SHORTENED_BY_TWO = [b"re", b"ve", b"ll"]


class Kept(dict):
    """What ``make`` gives for a key. Two generations of at most ``limit`` keys are
    held: when the younger is full, the older goes."""

    def __init__(self, make: Callable[[Any], bytes], limit: int = KEPT):
        super().__init__()
        self.make, self.limit = make, limit
        self.older: dict[Any, bytes] = {}

    def __missing__(self, key: Any) -> bytes:
        ids = self.older.get(key)
        if ids is None:
            ids = self.make(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = ids
        return ids


class WordTable:
    """Ids of words of at most KEY bytes, so kept that many words are looked up
    at once: open addressing over one array. A row is a word's bytes, in two
    integers, and its place among the ids with their number (0: a free row)."""

    def __init__(self, limit: int = WORDS):
        self.limit, self.bits = limit, (2 * limit - 1).bit_length()
        self.start()

    def start(self) -> None:
        self.rows, self.count = np.zeros((1 << self.bits, 3), np.uint64), 0
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0

    def _first(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys[:, 0] ^ (keys[:, 1] * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        return ((mixed ^ mixed >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The last column of each key's row, or 0."""
        at = self._first(keys)
        found, left = np.zeros(len(keys), np.uint64), np.arange(len(keys))
        while len(left):
            rows, own = self.rows[at], keys if len(left) == len(keys) else keys[left]
            same = (rows[:, 0] == own[:, 0]) & (rows[:, 1] == own[:, 1])
            found[left[same]] = rows[same, 2]
            on = ~same & (rows[:, 2] != 0)
            left, at = left[on], at[on] + 1 & len(self.rows) - 1
        return found

    def add(self, keys: np.ndarray, words: list[bytes]) -> np.ndarray:
        """Adds distinct keys that are not there, with the ids of each; gives their last columns."""
        n = np.array([len(x) >> 2 for x in words], np.uint64)
        value = (np.uint64(self.used) + np.cumsum(n) - n) << np.uint64(8) | n
        used = self.used + int(n.sum())
        if used > len(self.ids):
            self.ids = np.append(self.ids[: self.used], np.empty(2 * used - self.used, np.uint32))
        self.ids[self.used : used] = np.frombuffer(b"".join(words), "<u4")
        self.used, self.count = used, self.count + len(words)
        at, left = self._first(keys), np.arange(len(keys))
        while len(left):
            free = self.rows[at, 2] == 0
            self.rows[at[free], 2] = value[left[free]]
            won = self.rows[at, 2] == value[left]
            self.rows[at[won], :2] = keys[left[won]]
            left, at = left[~won], at[~won] + 1 & len(self.rows) - 1
        return value


class WordIds:
    """Ids of texts, and where their sentences and lines end.

    Texts within Latin-1 are cut by array operations into the words of the
    tokenizer's pattern, a batch of texts at once; the library's model sees each
    distinct word about once. Other texts go one by one, by what stands
    between spaces, as no word of the pattern reaches over white space. Ids are
    kept as little-endian unsigned 32-bit integers; where such a piece ends a
    sentence, its last id carries _STOP, and a line's end is one mark."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.model = self.lib.model
        self.shown = {b: c for c, b in printable_bytes().items()}
        self.marks = {c: self._library(c) for c in ".,!?;:"}
        self.digits = {c: self._library(c) for c in "0123456789"}
        ends = [i for t, i in self.lib.get_vocab().items() if t.removesuffix("</w>")[-1:] in (".", "!", "?")]
        self.stopping = {np.uint32(i).tobytes(): (np.uint32(i) | _STOP).tobytes() for i in ends}
        self.table, self.words, self.pieces = WordTable(), Kept(self._word), Kept(self._piece)

    def _library(self, piece: str) -> bytes:
        return np.array(self.lib.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: bytes) -> bytes:
        """Of one word of the pattern, in lower case: the library's model alone."""
        shown = word.decode() if word.isascii() else word.decode("latin-1").translate(self.shown)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        if piece == "\n":
            return _LINE.tobytes()
        if (word := piece.lower()).isalpha() and max(word) < "ɐ":
            ids = self.words[word.encode()]
        elif piece and piece[-1] in self.marks and piece[:-1].isalpha():
            ids = self.pieces[piece[:-1]] + self.marks[piece[-1]]
        elif piece.isascii() and piece.isdigit():  # each digit is a word
            ids = b"".join([self.digits[c] for c in piece])
        else:
            ids = self._library(piece)
        last = self.stopping.get(ids[-4:])
        return ids if last is None else ids[:-4] + last

    def _by_pieces(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        ids = np.frombuffer(b"".join(map(self.pieces.__getitem__, text.replace("\n", " \n ").split(" "))), "<u4")
        stops = np.flatnonzero(ids & _STOP) + 1
        line = ids == _LINE
        if line.any():
            stops -= np.cumsum(line)[stops - 1]
            ids = ids[~line]
        return ids & ~_STOP, stops

    def _by_words(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of texts without _HARD characters and special tokens."""
        raw, at = byte_view(texts)
        raw = np.append(raw, np.uint8(0x20))
        kind, low = _KIND[raw], _LOWER[raw]
        lead = np.flatnonzero(raw >= 0xC2)
        point = (raw[lead] & 3) << 6 | raw[lead + 1] & 63
        low[lead], low[lead + 1] = raw[lead], _LOWER[point] & 63 | 128
        kind[lead] = kind[lead + 1] = _KIND[point]
        solid = kind != _SPACE
        begins = np.ones(len(raw), bool)
        np.not_equal(kind[1:], kind[:-1], out=begins[1:])
        begins |= kind == _DIGIT
        first = np.zeros(len(raw) + 2, bool)  # of a text
        first[at] = True
        begins |= first[: len(raw)]
        begins &= solid
        self._shorten(low, kind, begins, first)

        begin = np.flatnonzero(begins)
        end = np.flatnonzero(solid[:-1] & (begins[1:] | ~solid[1:])) + 1
        ids, ends = self._ids(low, begin, end)
        last = np.flatnonzero(_ENDS_SENTENCE[low[:-1]] & (~solid[1:] | first[1 : len(raw)]) | (low[:-1] == 0x0A))
        stops = ends[np.searchsorted(begin, last, "right")]
        row, stop_row = ends[np.searchsorted(begin, at)], np.searchsorted(last, at)
        for a, b, c, d in zip(row[:-1].tolist(), row[1:].tolist(), stop_row[:-1].tolist(), stop_row[1:].tolist()):
            yield ids[a:b], stops[c:d] - a

    def _ids(self, low: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words low[begin:end], and how many are before each word and in all."""
        raw, eight = low.tobytes(), np.lib.stride_tricks.sliding_window_view(np.append(low, np.zeros(KEY, np.uint8)), 8)
        step = min(BLOCK_WORDS, self.table.limit)
        blocks = [self._block(raw, eight, begin[i : i + step], end[i : i + step]) for i in range(0, len(begin), step)]
        ids, n = zip(*blocks) if blocks else ([np.empty(0, np.uint32)], [np.empty(0, np.int64)])
        return np.concatenate(ids), np.append(0, np.cumsum(np.concatenate(n)))

    def _block(self, raw: bytes, eight: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of so many words as the table can hold, and the number of each."""
        size = end - begin
        keys = np.empty((len(begin), 2), np.uint64)
        for k in (0, 1):
            keys[:, k] = eight[begin + 8 * k].view("<u8")[:, 0] & _MASKS[np.clip(size - 8 * k, 0, 8)]
        found, long = self.table.find(keys), size > KEY
        found[long] = 0
        if len(new := np.flatnonzero((found == 0) & ~long)):
            if self.table.count + len(new) > self.table.limit:
                self.table.start()
                new = np.flatnonzero(~long)
            new = new[np.lexsort((keys[new, 0], keys[new, 1]))]
            differs = np.append(True, (keys[new[1:]] != keys[new[:-1]]).any(axis=1))
            one = new[differs]
            ids = [self._word(raw[a:b]) for a, b in zip(begin[one].tolist(), end[one].tolist())]
            found[new] = self.table.add(keys[one], ids)[np.cumsum(differs) - 1]
        rare = np.flatnonzero(long)
        own = [self.words[raw[a:b]] for a, b in zip(begin[rare].tolist(), end[rare].tolist())]
        n = (found & np.uint64(255)).astype(np.int64)
        n[rare] = [len(x) >> 2 for x in own]
        place = np.repeat((found >> np.uint64(8)).astype(np.int64) - (np.cumsum(n) - n), n)
        place += np.arange(len(place))
        if not own:
            return self.table.ids[place], n
        of_rare = np.repeat(long, n)
        place[of_rare] = 0
        ids = self.table.ids[place]
        ids[of_rare] = np.frombuffer(b"".join(own), "<u4")
        return ids, n

    @staticmethod
    def _shorten(low: np.ndarray, kind: np.ndarray, begins: np.ndarray, first: np.ndarray) -> None:
        """Makes words of the pattern's 's, 't, 're, 've, 'm, 'll and 'd."""
        at = np.flatnonzero(low == 0x27)
        at = at[begins[at]]
        at = at[(kind[at + 1] == _LETTER) & ~first[at + 1]]
        one = at[_SHORTENED[low[at + 1]]]
        two = at[(kind[np.minimum(at + 2, len(low) - 1)] == _LETTER) & ~first[at + 2]]
        two = two[np.logical_or.reduce([(low[two + 1] == a) & (low[two + 2] == b) for a, b in _SHORTENED_BY_TWO])]
        begins[one + 1] = begins[two + 1] = False
        for behind in (one + 2, two + 3):
            begins[behind[kind[behind] == _LETTER]] = True

    def encode_all(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text its ids, and the places among them where sentences and lines end."""
        raw, at = byte_view(texts)
        hard = (raw > 0xC3) | ((raw < 0x80) & (_KIND[raw] == _HARD))
        lead = np.flatnonzero((raw == 0xC2) | (raw == 0xC3))
        hard[lead] = _KIND[(raw[lead] & 3) << 6 | raw[lead + 1] & 63] == _HARD
        special = np.flatnonzero(raw[:-1] == ord("<"))
        hard[special] |= raw[special + 1] == ord("|")
        plain = np.ones(len(texts), bool)
        plain[np.searchsorted(at, np.flatnonzero(hard), "right") - 1] = False
        by_words = self._by_words(texts.filter(pa.array(plain)) if not plain.all() else texts)
        for i, by in enumerate(plain.tolist()):
            ids, stops = next(by_words) if by else self._by_pieces(texts[i].as_py())
            stops = stops[(stops > 0) & (stops < len(ids))]
            yield ids, stops[np.append(True, stops[1:] != stops[:-1])] if len(stops) else stops

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return next(self.encode_all(pa.array([text], pa.string())))


def least_cost_cuts(at: np.ndarray, penalty: np.ndarray, window: int = WINDOW, sequence_cost: int = SEQUENCE_COST) -> np.ndarray:
    """Which of the places ``at`` (ascending from 0; the last is the line's end)
    begin or end a window in the line's cheapest division. Neighbours are at most
    a window apart. Of equal divisions the one with the longer last window wins."""
    n, p, pen = len(at), at.tolist(), penalty.tolist()
    hit_to, hit_from = [], []
    for k in range(window.bit_length()):
        if 1 << k <= window:
            i = np.searchsorted(at, at - (1 << k))
            j = np.flatnonzero((at >= 1 << k) & (at[np.minimum(i, n - 1)] == at - (1 << k)))
            hit_to.append(j)
            hit_from.append(i[j])
    to, source = np.concatenate(hit_to), np.concatenate(hit_from)
    order = np.argsort(to, kind="stable")
    source, first = source[order].tolist(), np.searchsorted(to[order], np.arange(n + 1)).tolist()
    cost, back = [0] * n, [0] * n
    sums, from_ = deque(), deque()  # of the queue's places: f + p, ascending, and the place
    last = 0
    for j in range(1, n):
        g = cost[j - 1] + p[j - 1]
        while sums and sums[-1] > g:
            sums.pop(), from_.pop()
        sums.append(g), from_.append(j - 1)
        oldest = p[j] - window
        while p[from_[0]] < oldest:
            sums.popleft(), from_.popleft()
        best, at_best = sums[0] - oldest, from_[0]
        upto = first[j + 1]
        while last < upto:
            i = source[last]
            last += 1
            if cost[i] < best:
                best, at_best = cost[i], i
        cost[j] = best + sequence_cost + pen[j]
        back[j] = at_best
    chosen = [n - 1]
    while chosen[-1]:
        chosen.append(back[chosen[-1]])
    return np.array(chosen[::-1], np.int64)


@dataclass
class Piece:
    """A document, or what is left of it behind a cut."""

    doc_id: int | None
    start: int
    ids: np.ndarray
    stops: np.ndarray
    doc_tokens: int


def places(held: list[Piece], final: bool, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the line of the held pieces may be cut, and the penalty there. The
    last window of the whole line may be cut anywhere."""
    size = np.array([len(x.ids) for x in held], np.int64)
    ends = np.cumsum(size)
    stops = np.concatenate([x.stops for x in held]) + np.repeat(ends - size, [len(x.stops) for x in held])
    at = np.concatenate([np.zeros(1, np.int64), stops, ends])
    fee = np.zeros(len(at), np.int64)
    fee[1 : len(stops) + 1] = SENTENCE_COST
    order = np.argsort(at, kind="stable")
    at, fee = at[order], fee[order]
    long = np.flatnonzero(np.diff(at) > STRIDE)
    inside = [np.arange(a + STRIDE, b, STRIDE) for a, b in zip(at[long].tolist(), at[long + 1].tolist())]
    if final:
        inside.append(np.arange(max(1, ends[-1] - window), ends[-1]))
    more = np.setdiff1d(np.concatenate(inside), at) if inside else np.zeros(0, np.int64)
    if len(more):
        at, fee = np.concatenate([at, more]), np.concatenate([fee, np.full(len(more), INSIDE_COST)])
        order = np.argsort(at, kind="stable")
        at, fee = at[order], fee[order]
    return at, fee


class Packer:
    """Packs the line of one part; ``rows`` gives pieces of finished windows."""

    def __init__(self, part: int, window: int):
        self.window, self.sequence = window, part << 33
        self.held: list[Piece] = []
        self.size = 0

    def add(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        self.held.append(piece)
        self.size += len(piece.ids)
        if self.size >= BLOCK_TOKENS:
            yield from self.rows(False)

    def rows(self, final: bool) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        at, fee = places(self.held, final, self.window)
        cuts = at[least_cost_cuts(at, fee, self.window)]
        if not final:
            cuts = cuts[:-1]  # the last window goes on with the next block
        length = np.array([len(x.ids) for x in self.held], np.int64)
        begin = np.cumsum(length) - length
        done = int(cuts[-1])
        line = np.concatenate([x.ids for x in self.held])
        bounds = np.unique(np.concatenate([cuts, begin[begin < done]]))
        a, b = bounds[:-1], bounds[1:]
        doc, seq = np.searchsorted(begin, a, "right") - 1, np.searchsorted(cuts, a, "right") - 1
        own = [self.held[i] for i in doc.tolist()]
        raw = line.astype("<u4").tobytes()
        if len(a):
            whole = pa.RecordBatch.from_arrays(
                [
                    pa.array([x.doc_id for x in own], pa.int64()),
                    pa.array([x.start for x in own] + a - begin[doc], pa.int64()),
                    pa.array(b - a),
                    pa.array([raw[4 * x : 4 * y] for x, y in zip(a.tolist(), b.tolist())], pa.binary()),
                    pa.array([x.doc_tokens for x in own], pa.int64()),
                    pa.array(self.sequence + seq),
                    pa.array(a - cuts[seq]),
                ],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )
            for i in range(0, len(a), 5_000):
                yield whole.slice(i, 5_000)
        self.sequence += len(cuts) - 1
        rest = []
        for x, base in zip(self.held, begin.tolist()):
            gone = min(max(done - base, 0), len(x.ids))
            if gone < len(x.ids):
                rest.append(Piece(x.doc_id, x.start + gone, x.ids[gone:].copy(), x.stops[x.stops > gone] - gone, x.doc_tokens))
        self.held, self.size = rest, sum(len(x.ids) for x in rest)


def pack_documents(df: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of a document in a sequence: doc_id, start (the
    document's ids before it), length, ids (little-endian unsigned 32-bit
    integers), doc_tokens (all ids of the document, ``end_id`` included),
    sequence_id, and offset in the sequence.

    Documents are encoded whole and end with ``end_id``; a null or empty text has
    that id alone. Every id lies in one piece. Documents follow each other by
    doc_id, those without one first, ties by a hash of their texts; repeated rows are packed each.
    sequence_ids are unique and ascend with the documents; between parts they
    leave gaps. An empty table gives no rows. Other columns are not read.
    ``window`` is a power of two."""
    if window < 1 or window & (window - 1):
        raise ValueError("window must be a power of two")
    docs = id_and_text(df, id_col, text_col)
    parts = parts_by_size(df)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = keep_in_worker(f"words of {tokenizer}", lambda: WordIds(tokenizer))
        packer, end = Packer(TaskContext.get().partitionId(), window), np.uint32(end_id)
        for batch in batches:
            for part in slices(batch):
                for doc_id, (ids, stops) in zip(part.column(0).to_pylist(), words.encode_all(part.column(1))):
                    yield from packer.add(Piece(doc_id, 0, np.append(ids, end), stops, len(ids) + 1))
        yield from packer.rows(True)

    lines = docs.withColumn("tie", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    return map_batches(lines, pack, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
