"""Token ids on disk, as ranks by frequency in a byte-aligned code.

The table of segments is the file format. A segment holds the ids of
consecutive documents: a table that gives the id of each rank (the most
frequent id of the segment has rank 0), the ranks themselves in one to four
bytes each, and apart from them control bytes, each with the lengths of four
ranks in two bits. Segments lie in ascending order of doc_id over the parts and
within each, and each can be read alone. Reading needs no loop over ids: the
256 control bytes are a numpy table of lengths.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plantlens.llm.bpe import PieceCache, PieceEncoder, printable_bytes
from plantlens.llm.common import id_and_text, keep_in_worker, map_batches, scratch_path, shuffle_partitions

END = 2
SEGMENT_TOKENS = 4_000_000
#: Bytes of the source, as Spark estimates them, in one part of the store.
PART_BYTES = 128 << 20
#: Greater estimates are of tables whose size Spark does not know.
UNKNOWN_BYTES = 1 << 50
#: Pieces that a Python worker keeps in each of two generations.
PIECES = 400_000
#: What stands for a space in a byte-level vocabulary.
SPACE_SHOWN = "\u0120"
OTHER_SPACE = re.compile(r"[^\S \n]")
#: A mark that no letter or digit precedes.
LOOSE_MARK = re.compile(r"[.,!?;:](?=[ \n])(?<![^\W_].)")
#: An apostrophe may begin a word of letters, so it is no such symbol.
LETTERS_THEN_SYMBOLS = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)")
SCHEMA = (
    "part int, segment int, n_tokens long, doc_ids binary, counts binary, "
    "rank_ids binary, control binary, data binary"
)
#: lengths in bytes of the four values of every control byte
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.int64) + 1


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    v = values.astype("<u4")
    more = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    for limit in (0xFF, 0xFFFF, 0xFFFFFF):
        more[: len(v)] += v > limit
    codes = more.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    width = 4 if len(v) and v.max() > 0xFFFF else 2
    used = np.arange(width, dtype=np.uint8) <= more[: len(v), None]
    return control.tobytes(), v.astype(f"<u{width}").view(np.uint8).reshape(-1, width)[used].tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    n = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:count]
    at = np.cumsum(n) - n
    raw = np.zeros(len(data) + 3, np.uint32)
    raw[: len(data)] = np.frombuffer(data, np.uint8)
    out = raw[at]
    for k in (1, 2, 3):
        longer = np.flatnonzero(n > k)
        out[longer] |= raw[at[longer] + k] << np.uint32(8 * k)
    return out


def encode_segment(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    order = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
    rank = np.zeros(len(counts), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    return order.astype("<u4").tobytes(), *pack(rank[ids])


def decode_segment(rank_ids: bytes, control: bytes, data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(rank_ids, "<u4")[unpack(control, data, count)] if count else np.zeros(0, np.uint32)


class LibraryCache(PieceCache):
    """Also holds pieces that no space precedes, behind a NUL: a mark, or a line's end and
    the word behind it."""

    def __missing__(self, piece: str) -> bytes:
        if piece[:1] != "\0":
            return super().__missing__(piece)
        ids = self.marks.get(piece[1:])
        if ids is None:
            ids = self.newline + self.bare[piece[2:]]
        if len(piece) <= 64:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class LibraryEncoder(PieceEncoder):
    """Encodes with the tokenizers library; pieces between single spaces are
    kept, so that the library sees each of them about once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.model = self.lib.model
        self.shown = {b: c for c, b in printable_bytes().items()}
        self.lib.no_truncation()
        self.lib.no_padding()
        super().__init__(self._ids, {t.content: i for i, t in self.lib.get_added_tokens_decoder().items()}, PIECES)
        self.cache = LibraryCache(self._ids, " ", PIECES)

    def _plain(self, text: str) -> bytes:
        """A mark behind a letter or digit and before white space is a word of the pattern, and
        so is a line's end between two others that are no white space. Both are set apart, so that words are
        looked up without them."""
        if not text:
            return b""
        if "\0" in text:
            return self._library(text)
        if any(s in text for s in ("  ", "\n\n", " \n", "\n ")) or OTHER_SPACE.search(text) or LOOSE_MARK.search(text):
            return super()._plain(text)
        for m in self.cache.marks:
            if m in text:
                text = text.replace(f"{m} ", f" \0{m} ").replace(f"{m}\n", f" \0{m}\n")
        first, *rest = text.replace("\n", " \0\n").split(" ")
        of = self.cache
        return b"".join([of.bare[first], *map(of.__getitem__, rest)])

    def _library(self, piece: str) -> bytes:
        return np.array(self.lib.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    def _ids(self, piece: str) -> bytes:
        word = piece.removeprefix(" ")
        if word.isalpha() and max(word) < "\u0250":  # one word of the pattern: the library's model alone
            shown = piece.replace(" ", SPACE_SHOWN) if piece.isascii() else piece.encode().decode("latin-1").translate(self.shown)
            return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        if behind := LETTERS_THEN_SYMBOLS.fullmatch(word):  # two words
            of = self.cache.bare if word == piece else self.cache
            return of[behind[1]] + self.cache.bare[behind[2]]
        return self._library(piece)


def library_encoder(path: str) -> LibraryEncoder:
    return keep_in_worker(f"library of {path}", lambda: LibraryEncoder(path))


def write_tokens(df: DataFrame, path: str, tokenizer: str, end_id: int = END, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text, appends ``end_id``, and writes the segments to
    ``path``. The parts grow in number with the table. A null text is empty and has the end id alone; rows of the same
    doc_id are ordered by text; rows without doc_id come first."""
    docs = id_and_text(df, id_col, text_col)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(shuffle_partitions(df.sparkSession), size // PART_BYTES if size < UNKNOWN_BYTES else 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, segment = library_encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        doc_ids: list[int | None] = []
        coded: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(coded), "<u4")
            counts = np.array([len(c) // 4 for c in coded], "<u8").tobytes()
            keys = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
            present = np.array([d is not None for d in doc_ids], np.uint8).tobytes()
            row = [part, segment, len(ids), keys + present, counts, *encode_segment(ids)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=[c.split()[0] for c in SCHEMA.split(", ")])

        for batch in batches:
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc_ids.append(d)
                coded.append(enc.encode(text) + end)
                held += len(coded[-1]) // 4
                if held >= SEGMENT_TOKENS:
                    yield flush()
                    segment, held = segment + 1, 0
                    doc_ids.clear()
                    coded.clear()
        if coded:
            yield flush()

    ordered = docs.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    map_batches(ordered, run, SCHEMA).write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and,
    with ``ids``, token_ids of every document in the files at ``path``.

    Starts are summed over the parts (a row each), then over each part's
    segments, then within a segment. A table without documents gives no rows."""
    store = spark.read.schema(SCHEMA).parquet(path)
    sizes = store.select("part", "segment", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = W.partitionBy("part").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        sizes.withColumn("in_part", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(F.broadcast(parts), "part")
        .select("part", "segment", (F.col("part_start") + F.col("in_part")).alias("start"))
    )
    placed = store.join(starts, ["part", "segment"]).select("start", "n_tokens", "doc_ids", "counts", "rank_ids", "control", "data")
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["token_ids"] * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, total, keys, counts, *coded in zip(*[c.to_pylist() for c in batch.columns]):
                values = decode_segment(*coded, total).astype("<u4")
                n = np.frombuffer(counts, "<u8").astype(np.int64)
                at = np.concatenate([[0], np.cumsum(n)])
                raw, d = values.tobytes(), np.frombuffer(keys[: 8 * len(n)], "<i8")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                gone = np.frombuffer(keys[8 * len(n) :], np.uint8) == 0
                cols = [pa.array(d, pa.int64(), mask=gone), pa.array(start + at[:-1]), pa.array(n), pa.array(crc, pa.int64())]
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.uint32()).cast(pa.int32())))
                whole = pa.RecordBatch.from_arrays(cols, names=names)
                for i in range(0, len(n), 10_000):
                    yield whole.slice(i, 10_000)

    return map_batches(placed, run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", token_ids array<int>" * ids)


def store_tokens(df: DataFrame, tokenizer: str, path: str | None = None, **more) -> DataFrame:
    """Writes the tokens of a table and reads them back."""
    path = path or scratch_path(df.sparkSession, "tokens")
    write_tokens(df, path, tokenizer, **more)
    return read_tokens(df.sparkSession, path)
