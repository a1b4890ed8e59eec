"""Byte-level BPE encoding and decoding.

A short word keeps its parts and the ranks of adjacent parts in two contiguous
arrays: the least rank is found by scanning, the boundary there is deleted and
the ranks of the two neighbours are read anew. A word of very many parts does
the same with a heap, as scanning would take quadratic time there.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from plantlens.llm.common import id_and_text, keep_in_worker, map_batches, slices

#: Fixed value: how byte-level BPE cuts a text into words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE_BEHIND_SPACE = re.compile(r"\s ")
SHORT = 192
CACHE = 150_000
_BITS, _NONE = 20, 1 << 62
_ID = (1 << _BITS) - 1


def printable_bytes() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level
    vocabulary file: itself where it is visible, else one from 256 upwards."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class BytePairs:
    """A vocabulary read from a tokenizer file (JSON of the tokenizers library)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, of = spec["model"]["vocab"], printable_bytes()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = token.encode() if token in self.special else bytes(of[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.byte_id = [vocab[c] for c, _ in sorted(of.items(), key=lambda x: x[1])]
        #: (left id, right id) to (rank, id of both), each pair in one integer
        self.pairs: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs[vocab[left] << _BITS | vocab[right]] = rank << _BITS | vocab[left + right]
        self.words = regex.compile(WORDS)

    def merge(self, word: bytes) -> list[int]:
        parts = [self.byte_id[b] for b in word]
        if len(parts) > SHORT:
            return self._merge_long(parts)
        get = self.pairs.get
        ranks = [get(a << _BITS | b, _NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            at = ranks.index(least)
            parts[at] = least & _ID
            del parts[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = get(parts[at] << _BITS | parts[at + 1], _NONE)
            if at:
                ranks[at - 1] = get(parts[at - 1] << _BITS | parts[at], _NONE)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        n, get = len(parts), self.pairs.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := get(parts[i] << _BITS | parts[i + 1], _NONE)) != _NONE]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j < 0 or get(parts[i] << _BITS | parts[j], _NONE) != rank:
                continue
            parts[i], parts[j], after[i] = rank & _ID, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := get(parts[a] << _BITS | parts[b], _NONE)) != _NONE:
                    heapq.heappush(heap, (r, a))
        return [p for p in parts if p >= 0]

    def encode_piece(self, piece: str) -> bytes:
        ids = [i for word in self.words.findall(piece) for i in self.merge(word.encode())]
        return np.array(ids, "<u4").tobytes()


def pieces(text: str) -> list[str]:
    """The text cut before every single space that no white space precedes, that space
    left out. No word of the pattern reaches over such a cut, so pieces are encoded one by one."""
    return text.split(" ") if not SPACE_BEHIND_SPACE.search(text) else regex.split(r"(?<!\s) (?! )", text)


class PieceCache(dict):
    """Ids of pieces that ``prefix`` precedes, as little-endian unsigned 32-bit
    integers. Two generations of at most ``limit`` pieces are held: when the
    younger is full, the older goes."""

    def __init__(self, encode, prefix: str, limit: int = CACHE):
        super().__init__()
        self.encode, self.prefix, self.limit = encode, prefix, limit
        self.older: dict[str, bytes] = {}
        self.bare = self if not prefix else PieceCache(encode, "", limit)
        self.marks = {c: encode(c) for c in ".,!?;:"}
        self.newline = encode("\n")

    def __missing__(self, piece: str) -> bytes:
        # neither a mark after a word nor a \n between two words is in one word
        # of the pattern with them
        if piece[-1:] in self.marks and piece[:-1].isalpha():
            return self[piece[:-1]] + self.marks[piece[-1]]
        if "\n" in piece:
            lines = piece.split("\n")
            if all(x and not x[0].isspace() and not x[-1].isspace() for x in lines):
                return self[lines[0]] + b"".join([self.newline + self.bare[x] for x in lines[1:]])
        ids = self.older.get(piece)
        if ids is None:
            ids = self.encode(self.prefix + piece)
        if len(piece) <= 64:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class PieceEncoder:
    """Encodes texts by pieces; ``encode_piece`` gives a piece's ids as bytes."""

    def __init__(self, encode_piece, special: dict[str, int], limit: int = CACHE):
        self.special = {s: np.array([i], "<u4").tobytes() for s, i in special.items()}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.cache = PieceCache(encode_piece, " ", limit)

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = pieces(text)
        of = self.cache
        return of.bare[first] + b"".join([of[p] for p in rest])

    def encode(self, text: str) -> bytes:
        if self.cut is None or not any(s in text for s in self.special):
            return self._plain(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self._plain(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])


class Encoder(PieceEncoder):
    def __init__(self, path: str):
        self.pairs = BytePairs(path)
        super().__init__(self.pairs.encode_piece, self.pairs.special)

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.pairs.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a stage that a Python worker runs in turn."""
    return keep_in_worker(f"pairs of {path}", lambda: Encoder(path))


def encode_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Encodes every whole text and decodes the ids again.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and, with ``ids``,
    token_ids. A null or empty text has no tokens. Repeated rows are encoded
    each; other columns of the table are not read. ``tokenizer`` must be
    readable on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["token_ids"] * ids
        for batch in batches:
            for part in slices(batch):
                counts, digests, texts, coded = [], [], [], []
                for text in part.column(1).to_pylist():
                    raw = enc.encode(text)
                    counts.append(len(raw) // 4)
                    digests.append(hashlib.sha256(raw).hexdigest())
                    texts.append(hashlib.sha256(enc.decode(np.frombuffer(raw, "<u4").tolist()).encode()).hexdigest())
                    if ids:
                        coded.append(raw)
                cols = [part.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())]
                if ids:
                    flat = pa.array(np.frombuffer(b"".join(coded), "<i4"))
                    cols.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), flat))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * ids
    return map_batches(id_and_text(df, id_col, text_col), run, schema)
