"""Data-quality rules, all in one pass over the events.

A row's violations are an array of its own; exploding it gives one row for each
violation. Only the rule of unique keys needs a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plantlens import policy as P
from plantlens.functions.scalar import ratio
from plantlens.operators.spc import first_row
from plantlens.sources.tables import scratch_path


def compiled(rules: Iterable[P.Rule]) -> list[tuple[str, Column]]:
    """The name and the predicate of each rule that a row breaks. Blank is white space
    of any kind. The rule of unique keys reads the mark of ``with_duplicates``."""

    def broken(r: P.Rule) -> Column:
        c = F.col(r.column)
        if r.kind == "required":
            return c.isNull() | ~c.cast("string").rlike(r"(?U)\S")
        if r.kind == "unique":
            return F.col("is_duplicate")
        if r.kind == "allowed":
            return c.isNotNull() & ~c.isin(*(r.allowed or []))
        if r.kind == "range":
            outside = [] if r.low is None else [c < r.low]
            outside += [] if r.high is None else [c > r.high]
            return reduce(or_, outside, F.lit(False))
        return (F.col(r.when_column) == r.when_value) & (c.isNotNull() if r.kind == "absent_when" else c.isNull())

    return [(r.rule, F.coalesce(broken(r), F.lit(False))) for r in rules]


def with_duplicates(events: DataFrame, key: str = "event_id") -> DataFrame:
    """Marks every row of a repeated key; null keys are equal to each other.
    Rows without a key are counted in one aggregate and lie anywhere in the
    window's shuffle, so that they are no hot key."""
    none = F.col(key).isNull()
    spot = F.when(none, F.pmod(F.xxhash64(*events.columns), F.lit(1024)))
    without = events.agg((F.count_if(none) > 1).alias("_repeated"))
    both = events.join(F.broadcast(without), F.lit(True))  # one row
    again = F.count("*").over(W.partitionBy(key, spot)) > 1
    return both.withColumn("is_duplicate", F.when(none, F.col("_repeated")).otherwise(again)).drop("_repeated")


def violations(events: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    hits = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules]))
    return events.select("event_id", F.explode(hits).alias("rule"))


def _marked(events: DataFrame, policy: P.Policy) -> DataFrame:
    keys = {r.column for r in policy.of_kind("unique")}
    if len(keys) > 1:
        raise ValueError("one key can be unique")
    return with_duplicates(events, *keys) if keys else events


def all_violations(events: DataFrame, policy: P.Policy = P.BUILT_IN) -> DataFrame:
    """event_id and rule, a row for each rule that a row breaks."""
    return violations(_marked(events, policy), compiled(policy.rules))


def by_rule(found: DataFrame) -> DataFrame:
    return found.groupBy("rule").agg(F.count("*").alias("violations"))


def judged_keys(events: DataFrame, policy: P.Policy = P.BUILT_IN, key: str = "event_id") -> DataFrame:
    """One row a key, from one scan and one shuffle: its first row in the order of
    ``dedupe_first`` (r), its number of rows (n), and for each rule the number of
    its rows that break it (hits). A null key is a key like others."""
    own = [r for r in policy.rules if r.kind != "unique"]
    hit = compiled(own)
    rows = events.withColumns({f"_hit{i}": c.cast("long") for i, (_, c) in enumerate(hit)})
    per = rows.groupBy(key).agg(first_row(events, key).alias("r"), F.count("*").alias("n"), *[F.sum(f"_hit{i}").alias(f"_hit{i}") for i in range(len(hit))])
    repeated = F.when(F.col("n") > 1, F.col("n")).otherwise(0)
    own_hits = {name: F.col(f"_hit{i}") for i, (name, _) in enumerate(hit)}
    hits = F.array(*[F.struct(F.lit(r.rule).alias("rule"), own_hits.get(r.rule, repeated).alias("n")) for r in policy.rules])
    return per.select(key, "r", "n", hits.alias("hits"))


def score_of(keys: DataFrame) -> DataFrame:
    """n_rows, offending, dq_score, clean_rows and violations of judged keys: one row."""
    hits = F.aggregate("hits", F.lit(0).cast("long"), lambda t, h: t + h["n"])
    per = keys.select("n", hits.alias("hits"), F.col("event_id").isNotNull().alias("known"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    one = per.agg(total("n").alias("n_rows"), total(((F.col("hits") > 0) & F.col("known")).cast("long")).alias("offending"), F.count("*").alias("clean_rows"), total("hits").alias("violations"))
    return one.withColumn("dq_score", F.round(1 - ratio(F.col("offending"), F.col("n_rows")), 4))


def score(events: DataFrame, policy: P.Policy = P.BUILT_IN) -> DataFrame:
    """rows, offending ids and 1 - offending / rows; null without rows."""
    return score_of(judged_keys(events, policy)).select("n_rows", "offending", "dq_score")


def rule_counts(keys: DataFrame) -> DataFrame:
    """rule and violations, from judged keys."""
    each = keys.select(F.explode("hits").alias("h")).groupBy("h.rule").agg(F.sum("h.n").alias("violations"))
    return each.filter("violations > 0")


def clean_rows(keys: DataFrame, columns: Sequence[str], key: str = "event_id") -> DataFrame:
    """The first row of each key."""
    return keys.select(*[F.col(key) if c == key else F.col(f"r.{c}") for c in columns])


def violation_rows(keys: DataFrame) -> DataFrame:
    """event_id and rule, a row for each rule that a row breaks, from judged keys."""
    each = keys.select("event_id", F.explode("hits").alias("h")).filter("h.n > 0")
    return each.select("event_id", F.col("h.rule").alias("rule"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("h.n")))).drop("col")


def validate(events: DataFrame, policy: P.Policy = P.BUILT_IN, keys_path: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The clean rows (only repeated ids are dropped), violations and report. The
    events are scanned and shuffled once, into the table of judged keys at
    ``keys_path`` (a scratch path where none is given), which the three results read."""
    path = keys_path or scratch_path(events.sparkSession, "judged")
    keys = judged_keys(events, policy)
    keys.write.mode("overwrite").parquet(path)
    keys = events.sparkSession.read.schema(keys.schema).parquet(path)
    return clean_rows(keys, events.columns), violation_rows(keys), score_of(keys)
