"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import Scratch


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) of every node but the roots; root is the least node that
    can be reached. Large-star and small-star steps alternate until nothing
    changes; each step is an aggregate and a join, so a node of very many links
    is no group that a task must hold. Links of a node to itself or with a null
    end are left out."""
    start = links.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b"), (F.col(u) != F.col(v)).alias("two"))
    held = Scratch(start.filter("two").select("a", "b").distinct(), "links")
    mark = _fingerprint(held.df)
    while mark[0]:
        e = held.df
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        near = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(near, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = Scratch(small.union(near.select("a", "m")).distinct(), "links")
        held.drop()
        held, before, mark = new, mark, _fingerprint(new.df)
        if mark == before:
            break
    return held.df.select(F.col("a").alias("node"), F.col("b").alias("root"))
