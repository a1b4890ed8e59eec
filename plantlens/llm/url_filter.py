"""URL filters: rules for hosts and paths, and verdicts from the link graph.

Hosts are nodes; an edge is a link of a page to another host, or that from a
host to the domain above it. Trust spreads along the edges as personalised
PageRank from hosts with pages that a rule allows; distrust spreads against them
from hosts with pages that a rule blocks. A host whose distrust outweighs its
trust is blocked wherever no rule decides. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import UPPER, Scratch, written

DAMPING, ROUNDS, BLOCK_SHARE = 0.85, 8, 0.5  # ROUNDS: those of the SQL twin
#: Ranks are done when a round changes them by less than this in all. What is
#: left to change is then below damping / (1 - damping) times as much.
TOLERANCE = 1e-10
#: Rules up to this number are part of each row's expression; more are joined.
INLINE = 64


class Rule(NamedTuple):
    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rule(action: str, text: str) -> Rule:
    host, slash, path = text.partition("/")
    return Rule(action, host, slash + path)


#: The rules of the production query.
RULES = [rule("block", "com/en/"), rule("allow", "example.com/en/7"), rule("allow", "net/de/"), rule("block", "example.net/de/8"), rule("block", "org/es/")]


def lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    return lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def with_rule(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Adds rule and action of the longest rule that fits (columns host, path);
    of equally long ones block, then the first in order."""
    order = sorted(set(rules), key=lambda r: (len(r.text), r.action == "block", r.text))
    if len(order) <= INLINE:
        fits = [
            F.when(((F.col("host") == r.host) | F.endswith("host", F.lit(f".{r.host}"))) & F.startswith("path", F.lit(r.path)), F.struct(F.lit(r.text).alias("rule"), F.lit(r.action).alias("action")))
            for r in reversed(order)
        ]
        none = F.lit(None).cast("struct<rule:string,action:string>")
        return pages.withColumn("fit", F.coalesce(*fits, none)).select(*pages.columns, "fit.rule", "fit.action")
    listed = pages.sparkSession.createDataFrame([(i, *r, r.text) for i, r in enumerate(order)], "place int, action string, rule_host string, rule_path string, rule string")
    pairs = pages.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hits = pairs.withColumn("rule_host", F.explode(above)).join(listed, "rule_host").filter(F.startswith("path", F.col("rule_path")))
    best = hits.groupBy("host", "path").agg(F.max(F.struct("place", "rule", "action")).alias("fit"))
    return pages.join(best, ["host", "path"], "left").select(*pages.columns, "fit.rule", "fit.action")


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst and weight (columns host, html). Links count once a page."""
    links = F.regexp_extract_all("html", F.lit(r"""(?i)href\s*=\s*["']?\s*(?:[a-z]+:)?//([^/"'?#>\s]+)"""), F.lit(1))
    linked = pages.select("host", F.explode(F.array_distinct(F.transform(links, lower))).alias("dst"))
    linked = linked.filter("host <> '' and host <> dst").groupBy(F.col("host").alias("src"), "dst").agg(F.count("*").cast("double").alias("weight"))
    known = pages.select("host").union(linked.select("dst")).filter("host <> ''").distinct()
    labels = F.split("host", r"\.")
    above = F.array_join(F.slice(labels, F.lit(2), F.size(labels)), ".")
    up = known.filter(F.size(labels) >= 3).select(F.col("host").alias("src"), above.alias("dst"), F.lit(1.0).alias("weight"))
    return linked.union(up).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def host_ranks(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """host, trust and distrust, to a summed change below ``tolerance``. seeds:
    host, kind (trust or distrust) and weight. What a host without edges would
    pass on is lost, so every round changes the ranks by at most ``damping``
    times what the one before did: for 1e-10 there are about 140 at most."""
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight").union(edges.select(F.lit("distrust"), "dst", "src", "weight"))
    out = both.groupBy("kind", "src").agg(F.sum("weight").alias("out"))
    steps = written(both.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("weight") / F.col("out")).alias("part")), "steps")
    totals = seeds.groupBy("kind").agg(F.sum("weight").alias("total"))
    start = written(seeds.join(totals, "kind").select("kind", "host", (F.col("weight") / F.col("total")).alias("rank")), "seeds")
    none = F.lit(0.0)
    home = start.select("kind", "host", (F.col("rank") * F.lit(1 - damping)).alias("rank"), none.alias("was"))
    held, change = Scratch(start, "ranks"), 1.0
    while change >= tolerance:
        now = held.df
        moved = now.join(steps, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("part") * F.lit(damping)).alias("rank"), none.alias("was"))
        every = home.union(moved).union(now.select("kind", "host", none, "rank"))
        new = Scratch(every.groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("was").alias("was")), "ranks")
        held.drop()
        held, change = new, new.df.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0] or 0.0
    return held.df.groupBy("host").agg(*[F.sum(F.when(F.col("kind") == k, F.col("rank")).otherwise(0.0)).alias(k) for k in ("trust", "distrust")])


def judge_urls(df: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", tolerance: float = TOLERANCE, share: float = BLOCK_SHARE) -> DataFrame:
    """The verdict on every url: page_id, host, path, rule (the longest that
    fits, else null), verdict (allow or block), trust and distrust of the host.

    Without a rule, a host is blocked if over ``share`` of its trust and
    distrust is distrust; a host that neither reaches is allowed. A url that is
    null or has no :// has empty host and path and is allowed. Repeated rows
    are judged each. An empty table gives no rows.
    """
    read = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    pages = read.select("page_id", "html", *[c.alias(n) for c, n in zip(host_and_path(F.col("url")), ("host", "path"))])
    ruled = with_rule(pages.drop("html"), rules)
    kind = F.when(F.col("action") == "allow", "trust").otherwise("distrust")
    seeds = ruled.filter("rule is not null and host <> ''").groupBy(kind.alias("kind"), "host").agg(F.count("*").cast("double").alias("weight"))
    edges = written(host_edges(pages), "edges")
    ranks = host_ranks(edges, seeds, tolerance)
    total = F.col("trust") + F.col("distrust")
    blocked = F.coalesce(F.col("distrust") > F.lit(share) * total, F.lit(False))
    return ruled.join(ranks, "host", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("action", F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
