"""Exact histogram of encoded lengths.

Documents are counted by their length in tokens; sums over all greater lengths
then answer totals, quantiles and truncated totals for every context limit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plantlens.llm.common import id_and_text, map_batches
from plantlens.llm.token_store import library_encoder

BLOCK = 1024


def document_lengths(df: DataFrame, tokenizer: str, group_cols: Sequence[str] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the group columns and n_tokens of every row; null and empty texts
    have 0. Repeated rows are counted each; an empty table gives no rows. Other
    columns are not read, whatever their names."""
    docs = id_and_text(df, id_col, text_col, *group_cols)
    names = ["doc_id", *group_cols, "n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = library_encoder(tokenizer)
        for batch in batches:
            n = [len(enc.encode(t)) // 4 for t in batch.column(1).to_pylist()]
            kept = [batch.column(i) for i in range(batch.num_columns) if i != 1]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n, pa.int64())], names=names)

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds.get(c, 'bigint')}" for c in names)
    return map_batches(docs, run, schema)


def length_histogram(lengths: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """One row per group and length that occurs.

    n_docs and n_docs_tokens are of that length; docs_longer and tokens_longer
    of the greater ones; tokens_total of the whole group; truncated_total is
    what is left if every document is cut at this length; quantile is the share
    of documents of at most this length. A null group is a group of its own; an
    empty table gives no rows.

    Sums run within blocks of lengths and over the blocks' totals, so that no
    window holds more than a block of lengths, or the blocks of one group.
    """
    g = list(group_cols)
    hist = (
        lengths.groupBy(*g, "n_tokens")
        .agg(F.count("*").alias("n_docs"))
        .withColumn("tokens", F.col("n_docs") * F.col("n_tokens"))
        .withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    )
    later = W.partitionBy(*g).orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    group = W.partitionBy(*g)
    blocks = (
        hist.groupBy(*g, "block")
        .agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
        .withColumn("later_docs", F.coalesce(F.sum("bd").over(later), F.lit(0)))
        .withColumn("later_tokens", F.coalesce(F.sum("bt").over(later), F.lit(0)))
        .withColumn("docs_total", F.sum("bd").over(group))
        .withColumn("tokens_total", F.sum("bt").over(group))
        .drop("bd", "bt")
    )
    inner = W.partitionBy(*g, "block").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, -1)
    hist = hist.withColumn("in_docs", F.coalesce(F.sum("n_docs").over(inner), F.lit(0))).withColumn(
        "in_tokens", F.coalesce(F.sum("tokens").over(inner), F.lit(0))
    )
    h, b = hist.alias("h"), blocks.alias("b")
    joined = h.join(b, [F.col(f"h.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*g, "block"]])
    longer = F.col("later_docs") + F.col("in_docs")
    return joined.select(
        *[F.col(f"h.{c}").alias(c) for c in g],
        "n_tokens",
        "n_docs",
        F.col("tokens").alias("n_docs_tokens"),
        longer.alias("docs_longer"),
        (F.col("later_tokens") + F.col("in_tokens")).alias("tokens_longer"),
        "tokens_total",
        (F.col("tokens_total") - F.col("later_tokens") - F.col("in_tokens") + F.col("n_tokens") * longer).alias("truncated_total"),
        ((F.col("docs_total") - longer) / F.col("docs_total")).alias("quantile"),
    )


def quantiles(histogram: DataFrame, shares: Sequence[float], group_cols: Sequence[str] = ()) -> DataFrame:
    """The least length that at least each share of the documents keeps within."""
    asked = F.explode(F.array(*[F.lit(float(x)) for x in shares]))
    return (
        histogram.withColumn("share", asked)
        .filter(F.col("quantile") >= F.col("share"))
        .groupBy(*group_cols, "share")
        .agg(F.min("n_tokens").alias("n_tokens"))
    )


def truncated_totals(histogram: DataFrame, limits: Sequence[int], group_cols: Sequence[str] = ()) -> DataFrame:
    """Tokens left in each group if documents are cut at each context limit."""
    asked = F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits]))
    fits = F.col("n_tokens") <= F.col("context_limit")
    return (
        histogram.withColumn("context_limit", asked)
        .groupBy(*group_cols, "context_limit")
        .agg(
            F.sum(F.when(fits, F.col("n_docs_tokens")).otherwise(F.col("context_limit") * F.col("n_docs"))).alias("tokens"),
            F.sum(F.when(fits, 0).otherwise(F.col("n_docs"))).alias("docs_cut"),
        )
    )
