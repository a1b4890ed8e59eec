"""The trie of conversation prefixes, by composable fingerprints.

A turn's fingerprint is two 64-bit hashes of its role and text. That of a
sequence of turns is the product ``x -> x * B + turn`` of its turns in both lanes,
modulo 2**64. Products compose, so a conversation that is made of the head of
another one and of its own suffix gets the fingerprints of all its prefixes from
two products; no text of it is ever put together.

Conversations of any length are ordered by a range sort; tasks multiply within
their parts, and the product of a conversation that goes on in the next part is
carried over by one row a part.

A node of the trie is a group of equal fingerprints at one depth. Each of its
members also stores the hashes of its last turn, which the group checks to be
equal; as B has an inverse, equal products with equal last turns come from equal
shorter products, so no two different sequences of turns share a node unseen. Turns
that share hashes are compared by the texts that they refer to.

Sums over subtrees take no walk over the trie: a conversation owns the nodes whose
smallest member it is, which are all those below a certain depth of its path, and
what it owns lies in the subtree of every node that it is a member of.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plantlens.llm.common import Scratch, map_batches, parts_by_size, powers

HEADS = 3
#: Depths of one owner, or ids of one node, that a group holds together.
BLOCK = 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()
WORD = r"[^\x20\x09-\x0D]+"
_U64 = np.uint64


def base_powers(e: np.ndarray) -> np.ndarray:
    """The hash base to each power, from two tables for exponents below 2**32."""
    low = powers(1 << 16)[0]
    step = _U64(pow(int(low[1]), 1 << 16, 1 << 64))
    high = np.ones(int(e.max(initial=0) >> 16) + 1, _U64)
    high[1:] = step
    np.multiply.accumulate(high, out=high)
    return low[e & 0xFFFF] * high[e >> 16]


def unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(_U64)


def read_turns(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, turn, role and the two hashes of every turn. Turns without a
    conversation are left out."""
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return rows.filter("conv is not null").withColumns({c: F.xxhash64(F.lit(i), "role", "text") for i, c in enumerate("ab")})


def check_texts(turns: DataFrame, compact: DataFrame) -> None:
    """Raises if two different turns share both hashes. Only texts whose hashes
    occur twice are read for it."""
    twice = compact.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    said = F.struct("role", "text")
    texts = turns.join(twice, ["a", "b"]).groupBy("a", "b").agg(F.min(said).alias("x"), F.max(said).alias("y"))
    if not texts.filter(F.col("x") != F.col("y")).isEmpty():
        raise ValueError("two different turns have the same hashes")


def number_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place and product of each turn within the part that a task reads in order."""
    part, conv, k, q, held = TaskContext.get().partitionId(), None, 0, [_U64(0), _U64(0)], None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        own = batch.column(0).to_numpy()
        fresh = np.concatenate([[own[0] != conv], own[1:] != own[:-1]])
        start = np.maximum.accumulate(np.where(fresh, np.arange(n), -1))  # -1: the run came with the last batch
        at = np.arange(n) - np.maximum(start, 0) + 1
        up, down = powers(n + 1)
        goes_on = start < 0
        products = []
        for lane in range(2):
            sums = np.concatenate([[_U64(0)], np.cumsum(unsigned(batch.column(1 + lane)) * down[:n])])
            h = up[:n] * (sums[1:] - sums[np.maximum(start, 0)])
            h[goes_on] += q[lane] * up[at[goes_on]]
            products.append(h)
        at[goes_on] += k
        conv, k, q = own[-1], int(at[-1]), [h[-1] for h in products]
        out = pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, part), pa.int32()), *batch.columns, pa.array(at), *[pa.array(h.view(np.int64)) for h in products]], names=["part", *batch.schema.names, "k", "qa", "qb"]
        )
        if held is not None:
            yield held.append_column("last", pa.array(np.zeros(held.num_rows, bool)))
        held = out
    if held is not None:
        yield held.append_column("last", pa.array(np.arange(held.num_rows) == held.num_rows - 1))


def carried(ordered: DataFrame) -> dict[int, tuple[int, int, int, int]]:
    """For each part the conversation that the parts before it end with, its
    turns there and their product. One row a part is read for it."""
    base, mask = int(powers(2)[0][1]), (1 << 64) - 1
    tails = sorted(ordered.filter("last").select("part", "conv", "k", "qa", "qb").collect())
    out, tail = {}, None
    for part, conv, k, qa, qb in tails:
        if tail is not None:
            out[part] = tail
            if tail[0] == conv:
                up = pow(base, k, 1 << 64)
                k, qa, qb = tail[1] + k, (tail[2] * up + qa) & mask, (tail[3] * up + qb) & mask
        tail = conv, k, qa & mask, qb & mask
    return out


def ordered_turns(compact: DataFrame, parts: int) -> DataFrame:
    """conv, a, b, words, k (its place in the conversation, from 1), qa and qb
    (the product of the conversation's turns up to it)."""
    order = ["conv", "turn", "role", "a", "b"]
    sorted_rows = compact.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv", "a", "b", "words")
    first = Scratch(map_batches(sorted_rows, number_turns, "part int, conv long, a long, b long, words int, k long, qa long, qb long, last boolean"), "runs")
    before = carried(first.df)

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, conv, *same, k, qa, qb, _ = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            k, q = k.copy(), [qa.copy().view(_U64), qb.copy().view(_U64)]
            for p in np.unique(part).tolist():
                if p in before:
                    tail = before[p]
                    rows = np.flatnonzero((part == p) & (conv == tail[0]))
                    up = base_powers(k[rows])
                    for lane in range(2):
                        q[lane][rows] += _U64(tail[2 + lane]) * up
                    k[rows] += tail[1]
            yield pa.RecordBatch.from_arrays([batch.column(1), *batch.columns[2:5], pa.array(k), *[pa.array(h.view(np.int64)) for h in q]], names=["conv", "a", "b", "words", "k", "qa", "qb"])

    whole = Scratch(map_batches(first.df, go_on, "conv long, a long, b long, words int, k long, qa long, qb long"), "turns")
    first.drop()
    return whole.df


def head_plans(turns: DataFrame, head: Column, base: Column) -> DataFrame:
    """One row a conversation: its own number of turns, the turns of its head
    (of the conversation ``base``), and what its own products take to go on
    from that head."""
    whole = F.struct("a", "b", "words", "qa", "qb")
    heads = turns.groupBy("conv").agg(F.max("k").alias("own"), *[F.max(F.when(F.col("k") == i, whole)).alias(f"h{i}") for i in range(1, HEADS + 1)])
    heads = heads.withColumn("head", F.array_compact(F.array(*[f"h{i}" for i in range(1, HEADS + 1)]))).select("conv", "own", "head")
    bases = heads.select(F.col("conv").alias("base"), F.col("head").alias("base_head"))
    none = F.expr(f"cast(array() as {dict(heads.dtypes)['head']})")
    plans = heads.withColumns({"h": head, "base": base}).join(bases, "base", "left")
    plans = plans.withColumn("base_head", F.slice(F.coalesce("base_head", none), 1, F.col("h")))
    return plans.select(
        "conv", "h", F.size("base_head").cast("long").alias("hb"), "base_head",
        (F.size("base_head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("len"),
        *[F.when(F.size("base_head") > 0, F.try_element_at("base_head", F.size("base_head"))[q]).otherwise(0).alias(f"new_{q}") for q in ("qa", "qb")],
        *[F.when(F.least("h", "own") > 0, F.try_element_at("head", F.least("h", "own").cast("int"))[q]).otherwise(0).alias(f"old_{q}") for q in ("qa", "qb")],
    )


def rebuilt_turns(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """conv, depth, fa, fb (of the prefix of that depth), a, b and words of its
    last turn, len of the whole conversation."""
    heads = plans.select("conv", "len", F.posexplode("base_head").alias("i", "t"))
    heads = heads.select("conv", (F.col("i") + 1).cast("long").alias("depth"), F.col("t.qa").alias("fa"), F.col("t.qb").alias("fb"), "t.a", "t.b", "t.words", "len")
    own = turns.join(plans.drop("base_head"), "conv").filter("k > h")
    own = own.select("conv", (F.col("k") - F.col("h") + F.col("hb")).alias("depth"), "qa", "qb", "a", "b", "words", "len", (F.col("k") - F.col("h")).alias("e"), "new_qa", "new_qb", "old_qa", "old_qb")

    names = heads.columns

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            up = base_powers(batch.column(8).to_numpy())
            f = [unsigned(batch.column(2 + i)) + (unsigned(batch.column(9 + i)) - unsigned(batch.column(11 + i))) * up for i in range(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(x.view(np.int64)) for x in f], *batch.columns[4:8]], names=names)

    kinds = ", ".join(f"{c} {t}" for c, t in heads.dtypes)
    return heads.unionByName(map_batches(own, compose, kinds))


def ends_digests(ends: DataFrame) -> DataFrame:
    """owner, depth and the digest of the ascending ids of the conversations that
    end there. Ids are joined in blocks of BLOCK; a digest takes them one
    after another, so a node's blocks stream through one task, which holds none."""
    ids = F.array_join(F.array_sort(F.collect_list("conv")), ",")
    blocks = ends.groupBy("owner", "depth", F.floor(F.col("conv") / BLOCK).alias("block")).agg(ids.alias("ids"))
    blocks = blocks.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "block").select("owner", "depth", "ids")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None

        def rows(found: list[tuple[int, int, str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.string()))], names=["owner", "depth", "ends_sha256"])

        for batch in batches:
            found = []
            for owner, depth, ids in zip(*[c.to_pylist() for c in batch.columns]):
                if (owner, depth) == node:
                    sha.update(b"," + ids.encode())
                    continue
                if node is not None:
                    found.append((*node, sha.hexdigest()))
                node, sha = (owner, depth), hashlib.sha256(ids.encode())
            if found:
                yield rows(found)
        if node is not None:
            yield rows([(*node, sha.hexdigest())])

    return map_batches(blocks, digest, "owner long, depth long, ends_sha256 string")


def prefix_trie(
    df: DataFrame, head: Column, base: Column, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """The nodes of the trie of rebuilt conversations.

    ``head`` and ``base`` are expressions over ``conv``: each conversation is the
    first ``head`` turns (0 to 3) of the conversation ``base``, all if it has
    fewer and none if it is absent, and its own turns after its first ``head``.
    Turns go by number, those without one first, ties by role and the hashes of
    role and text. Null roles and texts are empty; rows without a conversation are left out;
    repeated rows are turns of their own. A table without conversations gives no
    rows. Other columns are not read.

    Per node: conv_id (its smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens (over its subtree, the words of each node's
    last turn once for every member but one) and ends_sha256 (of the ascending ids
    of the conversations that end there).
    """
    turns = read_turns(df, conv_col, turn_col, role_col, text_col)
    compact = Scratch(turns.select("conv", "turn", "role", "a", "b", F.regexp_count("text", F.lit(WORD)).alias("words")), "hashes")
    check_texts(turns, compact.df)
    own = ordered_turns(compact.df, parts_by_size(df))
    plans = Scratch(head_plans(own, head, base), "plans").df
    rows = Scratch(rebuilt_turns(own, plans), "prefixes")
    compact.drop()

    same = (F.min("a") == F.max("a")) & (F.min("b") == F.max("b"))
    groups = rows.df.groupBy("depth", "fa", "fb").agg(
        F.when(same, F.min("conv")).otherwise(F.raise_error(F.lit("two prefixes have the same fingerprint"))).alias("owner"),
        F.count("*").alias("n"),
        F.max("words").cast("long").alias("node_words"),
        F.sum((F.col("depth") == F.col("len")).cast("long")).alias("ends"),
    )
    joined = Scratch(rows.df.select("conv", "depth", "fa", "fb", "len").join(groups, ["depth", "fa", "fb"]).drop("fa", "fb"), "members")
    rows.drop()
    members = joined.df

    least = F.broadcast(plans.agg(F.min("conv").alias("root_owner")))  # one row
    mine = F.col("owner") == F.col("conv")
    saved = (F.col("n") - 1) * F.col("node_words")
    leaf = mine & (F.col("depth") == F.col("len")) & (F.col("n") == F.col("ends"))
    paths = (
        members.groupBy("conv")
        .agg(
            F.max(F.when(~mine, F.struct("depth", "owner"))).alias("fork"),
            F.sum(F.when(mine, saved).otherwise(0)).alias("path_saved"),
            F.max(leaf.cast("long")).alias("path_leaf"),
        )
        .crossJoin(least)
        .select(
            "conv", "path_saved", "path_leaf",
            F.coalesce("fork.depth", F.when(F.col("conv") == F.col("root_owner"), -1).otherwise(0)).alias("fork_depth"),
            F.coalesce("fork.owner", "root_owner").alias("fork_owner"),
        )
    )
    child = (F.col("fork_depth") <= F.col("depth")) & (F.col("depth") < F.col("len"))
    of_owner = lambda c: F.max(F.when(mine, F.col(c))).alias(c)
    nodes = Scratch(
        members.join(paths, "conv")
        .groupBy("owner", "depth")
        .agg(
            F.max("n").alias("n_convs"), F.max("ends").alias("ends"), F.max(saved).alias("saved"), F.sum(child.cast("long")).alias("n_children"),
            F.sum("path_leaf").alias("n_leaves"), F.sum("path_saved").alias("below"), of_owner("fork_depth"), of_owner("fork_owner"),
        ),
        "nodes",
    ).df
    joined_ends = ends_digests(members.filter("depth = len").select("owner", "depth", "conv"))

    nodes = nodes.withColumn("block", F.floor(F.col("depth") / BLOCK))
    before = lambda *keys, by: F.coalesce(F.sum("saved").over(W.partitionBy(*keys).orderBy(by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = nodes.groupBy("owner", "block").agg(F.sum("saved").alias("saved")).withColumn("block_before", before("owner", by="block")).drop("saved")
    placed = nodes.withColumn("before", before("owner", "block", by="depth")).join(blocks, ["owner", "block"]).join(joined_ends, ["owner", "depth"], "left")
    inner = placed.select(
        F.col("owner").alias("conv_id"),
        "depth",
        F.when(F.col("depth") - 1 > F.col("fork_depth"), F.col("owner")).otherwise(F.col("fork_owner")).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        (F.col("below") - F.col("before") - F.col("block_before")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )

    turnless = ends_digests(plans.filter("len = 0").join(least).select(F.col("root_owner").alias("owner"), F.lit(0).cast("long").alias("depth"), "conv"))
    below = nodes.agg(
        F.sum((F.col("depth") == 1).cast("long")).alias("n_children"),
        F.sum((F.col("n_convs") == F.col("ends")).cast("long")).alias("n_leaves"),
        F.sum("saved").alias("saved"),
    )
    root = (
        plans.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"))
        .filter("n_convs > 0")
        .crossJoin(F.broadcast(below))
        .join(F.broadcast(turnless.select("ends_sha256")), how="left")  # one row at the most
    )
    root = root.select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
    return root.unionByName(inner)
