"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder that the cluster names in
    ``spark.checkpoint.dir``. Where that is unset, it is below the warehouse,
    or, if driver and executors are one process, in a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.split("[")[0] == "local":
        root = tempfile.mkdtemp(prefix="plantlens-")
        spark.conf.set("spark.checkpoint.dir", root)
    root = root or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/plantlens-{tag}-{uuid.uuid4().hex}"


class Scratch:
    """A table written once to the shared folder. It cuts the lineage and
    outlives executors; ``drop`` removes it when a later table replaces it."""

    def __init__(self, df: DataFrame, tag: str, codec: str = "zstd"):
        self.spark = df.sparkSession
        self.path = scratch_path(self.spark, tag)
        df.write.option("compression", codec).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    return Scratch(df, tag, codec).df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of a source, as Spark estimates them, in one part that is sorted or packed.
PART_BYTES = 128 << 20
#: Greater estimates are of tables whose size Spark does not know.
UNKNOWN_BYTES = 1 << 50


def parts_by_size(df: DataFrame) -> int:
    """A number of parts that grows with the table."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(shuffle_partitions(df.sparkSession), size // PART_BYTES if size < UNKNOWN_BYTES else 0)


def id_and_text(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the named columns, whatever else the table holds. A null text
    counts as empty."""
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        *[F.col(c) for c in more],
    )


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, and its row offsets
    into them (n + 1 values, the first 0)."""
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    raw, at = byte_view(column)
    whole = raw.tobytes()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        yield whole[a:b]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, vectorised (wraps modulo 2**64)."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


_powers = np.ones(1, _U64), np.ones(1, _U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = []
        for base in (_BASE, _BASE_INVERSE):
            p = np.ones(size, _U64)
            p[1:] = _U64(base & _MASK)
            np.multiply.accumulate(p, out=p)
            out.append(p)
        _powers = out[0], out[1]
    return _powers[0][:n], _powers[1][:n]


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges raw[start:end], from prefix sums of a
    polynomial; equal bytes give equal hashes anywhere in any text."""
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, _U64)
    np.cumsum((raw.astype(_U64) + _U64(1)) * up[:-1], out=sums[1:])
    return mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(_U64))


SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every run of non-space bytes, and the row it is in.
    A row's end also ends its last word."""
    solid = np.empty(len(raw) + 2, bool)
    solid[0] = solid[-1] = False
    solid[1:-1] = ~SPACE[raw]
    begins = solid[1:-1] & ~solid[:-2]
    ends = solid[1:-1] & ~solid[2:]
    cut = at[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    begins[cut[solid[1:-1][cut]]] = True
    before = cut - 1
    ends[before[solid[1:-1][before]]] = True
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


SLICE_BYTES = 1 << 18
#: Bytes of one Arrow batch that Spark hands to a Python worker.
BATCH_BYTES = 4 << 20
_kept: dict[str, Any] = {}


def keep_in_worker(name: str, make: Callable[[], Any]) -> Any:
    """One object for all tasks of a stage that a Python worker runs in turn;
    it goes when the worker gets a task of another stage."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def _give_back() -> None:
    """Memory that is free again goes back to the machine, since the worker
    lives on and shares an executor with the next stage."""
    global _powers
    _powers = np.ones(1, _U64), np.ones(1, _U64)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # absent where the C library is not GNU's
    if trim is not None:
        trim(0)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: Any) -> DataFrame:
    """mapInArrow with batches of at most BATCH_BYTES, so that a worker never
    holds thousands of whole texts, and with little left in it after a task."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stage = TaskContext.get().stageId()
        if _kept.get("stage") != stage:
            _kept.clear()
            _kept["stage"] = stage
            _give_back()
        try:
            yield from run(batches)
        finally:
            _give_back()

    return df.mapInArrow(task, schema)


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES, column: int = 1) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text in a column, so that
    the arrays made of a part stay small."""
    _, at = byte_view(batch.column(column))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def filter_rows(df: DataFrame, text_col: str, keep: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """The rows for whose texts ``keep`` gives true, unchanged. Null texts are
    given as empty."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column=at):
                yield part.filter(pa.array(keep([t or "" for t in part.column(at).to_pylist()]), pa.bool_()))

    return map_batches(df, run, df.schema)
