"""Quality rules: counts of a text, and lines that many documents of a host share.

Every line is normalised and hashed. A line is boilerplate where the distinct
documents of its host that hold it are over a limit; such lines are removed, and
a document that loses most of its words so is depleted and rejected. Copies
of one text count as one document, since they say nothing about a line.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import byte_view, lower_ascii, map_batches, mix64, slices, span_hashes, word_spans, written

LEAST_WORDS = 50
#: a line is over the limit in more than LEAST_DOCUMENTS documents of its host
#: and more than SHARE of the host's documents
LEAST_DOCUMENTS, SHARE = 20, 0.08
#: a document is depleted if over this share of its words stands in such lines
MOST_REMOVED = 0.5
_U = np.uint64
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def text_counts(texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The counts of each text, and of its lines that hold a word: a hash, the
    number of words, and their offsets by text."""
    raw, at = byte_view(texts)
    n = len(at) - 1
    start, end, row = word_spans(raw, at)
    h = span_hashes(raw, start, end)
    words = np.bincount(row, minlength=n)

    def per_row(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return sums[at[1:]] - sums[at[:-1]]

    inside = np.zeros(len(raw) + 1, np.int32)
    np.add.at(inside, start, 1)
    np.add.at(inside, end, -1)
    in_word = np.cumsum(inside[:-1]) > 0
    counts = {"n_words": words, "word_chars": per_row(in_word & ((raw & 0xC0) != 0x80)), "n_symbols": per_row(_SYMBOL[raw])}

    # words in windows of three that stand twice or more in the text
    k = max(0, len(h) - 2)
    same_row = row[:k] == row[2:][:k]
    tri = np.flatnonzero(same_row)
    value = mix64(mix64(mix64(h[tri]) * _U(3) + h[tri + 1]) * _U(5) + h[tri + 2])
    again = repeats(row[tri], value)[0]
    marked = np.zeros(len(h), bool)
    for d in range(3):
        marked[tri[again] + d] = True
    counts["n_repeat_words"] = np.bincount(row[marked], minlength=n)

    # lines: runs of words without \n between them
    breaks = np.concatenate([[0], np.cumsum(raw == 10)])
    line = breaks[start] if len(start) else np.zeros(0, np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (line[1:] != line[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    line_row = row[first]
    last = np.append(first[1:], len(start)) - 1
    # equal lines are equal in every character, white space included
    newline = np.flatnonzero(raw == 10)
    left = np.searchsorted(newline, start[first]) - 1 if len(first) else first
    from_ = np.where(left >= 0, newline[np.maximum(left, 0)] + 1, 0) if len(newline) else np.zeros(len(first), np.int64)
    from_ = np.maximum(from_, at[line_row])
    right = np.searchsorted(newline, end[last]) if len(first) else first
    to = np.where(right < len(newline), newline[np.minimum(right, max(0, len(newline) - 1))], len(raw)) if len(newline) else np.full(len(first), len(raw))
    to = np.minimum(to, at[line_row + 1])
    later = repeats(line_row, span_hashes(raw, from_, to))[1]
    counts["n_dup_lines"] = np.bincount(line_row[later], minlength=n)

    # normalised: ASCII letters in lower case, white space runs as one break
    low = span_hashes(lower_ascii(raw), start, end)
    ends = np.cumsum(mix64(low + (np.arange(len(low)) - np.repeat(first, np.diff(np.append(first, len(low))))).astype(_U) * _U(0x9E3779B97F4A7C15)))
    sums = np.concatenate([np.zeros(1, _U), ends])
    hashes = mix64(sums[last + 1] - sums[first]).view(np.int64) if len(first) else np.zeros(0, np.int64)
    return counts, hashes, (last - first + 1).astype(np.int64), np.searchsorted(line_row, np.arange(n + 1))


def repeats(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each place: does its value stand elsewhere in its group; earlier?"""
    order = np.lexsort((value, group))
    v, g = value[order], group[order]
    same = (v[1:] == v[:-1]) & (g[1:] == g[:-1])
    any_, later = np.zeros(len(v), bool), np.zeros(len(v), bool)
    any_[order[1:][same]] = True
    any_[order[:-1][same]] = True
    later[order[1:][same]] = True
    return any_, later


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SPACES = " \t\n\v\f\r"


def _documents(df: DataFrame, text_col: str, host_col: str) -> DataFrame:
    return df.select(
        F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def line_sets(df: DataFrame, text_col: str, host_col: str) -> DataFrame:
    """host, a name of the whole text, and its distinct normalised lines."""
    docs = _documents(df, text_col, host_col).withColumn("content", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                _, hashes, _, at = text_counts(part.column(1))
                owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
                order = np.lexsort((hashes, owner))
                o, h = owner[order], hashes[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
                offsets = np.searchsorted(o[new], np.arange(len(at)))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(h[new]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), lists], names=["host", "content", "lines"])

    return map_batches(docs, run, "host string, content long, lines array<long>")


def _over_limit(once: DataFrame, least: int, share: float) -> DataFrame:
    """host, line and docs of the lines over the limit in distinct line sets."""
    # each line beside a row for the document itself, so that one pass counts both
    counted = once.select("host", F.explode(F.concat(F.array(F.lit(None).cast("long")), "lines")).alias("line"))
    counts = written(counted.groupBy("host", "line").agg(F.count("*").alias("docs")).filter((F.col("docs") > least) | F.col("line").isNull()), "lines")
    sizes = counts.filter("line is null").select("host", F.col("docs").alias("host_docs"))
    return counts.filter("line is not null").join(sizes, "host").filter(F.col("docs") > F.col("host_docs") * F.lit(share)).select("host", "line", "docs")


def frequent_lines(df: DataFrame, least: int = LEAST_DOCUMENTS, share: float = SHARE, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """host, line (its hash) and docs of every line over the limit. Rows of a
    host with the same text count once. Null counts as the host of no name."""
    return _over_limit(line_sets(df, text_col, host_col).dropDuplicates(["host", "content"]), least, share)


@dataclass
class Verdict:
    counts: dict[str, np.ndarray]
    failed: np.ndarray
    removed: np.ndarray
    depleted: np.ndarray
    #: for each text with a removed line, which of its lines that hold a word go
    drop: dict[int, np.ndarray]

    @property
    def kept(self) -> np.ndarray:
        return ~self.failed & ~self.depleted


def verdict(texts: pa.Array, often: list[list[int] | None], most_removed: float) -> Verdict:
    counts, hashes, words, at = text_counts(texts)
    removed, drop = np.zeros(len(texts), np.int64), {}
    for i, lines in enumerate(often):
        if lines:
            gone = np.isin(hashes[at[i] : at[i + 1]], np.array(lines, np.int64))
            if gone.any():
                removed[i], drop[i] = words[at[i] : at[i + 1]][gone].sum(), gone
    n = counts["n_words"]
    failed = (n < LEAST_WORDS) | (100 * counts["n_repeat_words"] > 50 * n)
    return Verdict(counts, failed, removed, removed > most_removed * n, drop)


def without_lines(text: str, drop: np.ndarray) -> str:
    flags = iter(drop.tolist())
    return "\n".join([x for x in text.split("\n") if not x.strip(SPACES) or not next(flags)])


FREQUENT, HOST, CONTENT = "frequent_lines_of_text", "frequent_lines_host", "frequent_lines_content"


def _free(name: str, df: DataFrame) -> str:
    """The name, longer if the rows have a column of it, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def _with_frequent(df: DataFrame, text_col: str, host_col: str, least: int, share: float) -> DataFrame:
    """Each row with those of its own lines that are over the limit of its
    host, so no list is longer than a text, whatever the limits are."""
    once = written(line_sets(df, text_col, host_col).dropDuplicates(["host", "content"]), "line-sets")
    often = _over_limit(once, least, share).select("host", "line")
    lines = once.select("host", "content", F.explode("lines").alias("line"))
    own_host, own_content = _free(HOST, df), _free(CONTENT, df)
    held = lines.join(often, ["host", "line"]).groupBy(F.col("host").alias(own_host), F.col("content").alias(own_content)).agg(F.collect_list("line").alias(_free(FREQUENT, df)))
    host, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (host_col, text_col))
    return df.join(written(held, "often"), (host == F.col(own_host)) & (F.xxhash64(text) == F.col(own_content)), "left").drop(own_host, own_content)


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", least: int = LEAST_DOCUMENTS, share: float = SHARE, most_removed: float = MOST_REMOVED) -> DataFrame:
    """The verdict of every row.

    Returns doc_id, the counts of text_counts, base_failed (fewer than 50
    words, or over half of them in repeated windows), removed_words (in lines
    over the limit), depleted (these are over ``most_removed`` of its words)
    and kept. Null and empty texts have no words and fail. Repeated rows are judged each, and alike.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(host_col).alias("source"))
    docs = _with_frequent(docs, "text", "source", least, share).drop("source")
    names = ["doc_id", *COUNTS, "base_failed", "removed_words", "depleted", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                v = verdict(part.column(1), part.column(2).to_pylist(), most_removed)
                cols = [*[v.counts[c].astype(np.int64) for c in COUNTS], v.failed, v.removed, v.depleted, v.kept]
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, cols)], names=names)

    return map_batches(docs, run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, removed_words long, depleted boolean, kept boolean")


def keep_good(df: DataFrame, text_col: str = "text", host_col: str = "source", length_col: str = "n_chars", least: int = LEAST_DOCUMENTS, share: float = SHARE, most_removed: float = MOST_REMOVED) -> DataFrame:
    """The rows that are kept, with their boilerplate lines removed and, if the
    table has it, their length in code points renewed. The columns stay."""
    rows = _with_frequent(df, text_col, host_col, least, share)
    names = df.columns
    at, length = names.index(text_col), names.index(length_col) if length_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column=at):
                texts = part.column(at)
                v = verdict(texts.fill_null("") if texts.null_count else texts, part.column(part.num_columns - 1).to_pylist(), most_removed)
                cols = list(part.columns[:-1])
                if v.drop:
                    new = texts.to_pylist()
                    sizes = cols[length].to_pylist() if length is not None else []
                    for i, gone in v.drop.items():
                        new[i] = without_lines(new[i], gone)
                        if length is not None:
                            sizes[i] = len(new[i])
                    cols[at] = pa.array(new, texts.type)
                    if length is not None:
                        cols[length] = pa.array(sizes, cols[length].type)
                yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(v.kept))

    return map_batches(rows, run, df.schema)
