"""The prefix trie against one built turn by turn."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from plantlens.llm import prefix_trie, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows):
    """All nodes of the trie, by walking every rebuilt conversation."""
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out, total, leaves, children = {}, defaultdict(int), defaultdict(int), defaultdict(int)
    for path in sorted(members, key=len, reverse=True):
        if path:
            children[path[:-1]] += 1
            total[path] += (len(members[path]) - 1) * len(WORD.findall(path[-1][1]))
        leaves[path] += not children[path]
        if path:
            total[path[:-1]] += total[path]
            leaves[path[:-1]] += leaves[path]
        ends = sorted(c for c in members[path] if len(built[c]) == len(path))
        sha = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        parent = min(members[path[:-1]]) if path else None
        out[min(members[path]), len(path)] = (parent, len(members[path]), children[path], leaves[path], total[path], sha)
    return out


def run(df):
    head = F.crc32(F.col("conv").cast("string")) % 4
    return prefix_trie.prefix_trie(df, head, F.col("conv") - F.col("conv") % 20)


def compare(df, rows):
    got = run(df).collect()
    assert len({(r.conv_id, r.depth) for r in got}) == len(got)
    assert {(r.conv_id, r.depth): tuple(r)[2:] for r in got} == plain(rows)


SCHEMA = "conv_id long, turn long, role string, text string, conv long, a long, depth long, owner string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, 8, 9, "x") for r in rows], SCHEMA)


def shared(n, step, longest):
    """Conversations that share beginnings of all lengths with others."""
    return [(c, t, "user" if t % 2 else "assistant", f"turn {t} of {c * step % (1 + (t * 7) % 5)}  now") for c in range(n) for t in range(c % longest + 1)]


def test_shared_beginnings(spark):
    rows = shared(90, 3, 11)
    compare(frame(spark, rows), rows)


def test_copies_nulls_and_absent_bases(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(100, 140) for t in range(4)]
    rows += [(7, None, None, None), (7, 0, "user", ""), (7, 1, None, "b c"), (None, 1, "user", "gone"), (None, None, None, None)]
    rows += [(c, 0, "user", "lone") for c in (41, 42, 43, 44, 45)]  # no conversation 40
    rows += [(60, 0, "user", "a"), (61, 0, "user", "b"), (62, 1, "x", "y"), (62, 1, "x", "y"), (62, 2, "x", "y")]
    compare(frame(spark, rows), rows)


def test_only_turnless_conversations(spark):
    lone = [c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 > 0]
    rows = [(c, 0, "user", "x") for c in lone]
    compare(frame(spark, rows), rows)


def test_empty_table(spark):
    assert run(frame(spark, shared(2, 1, 2)).limit(0)).count() == 0


def test_long_conversations_over_many_parts(spark, monkeypatch):
    """A conversation with a third of all rows lies in many parts; blocks are small."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    rows = shared(40, 1, 9) + [(c, t, "user", f"long {t}") for c in (1000, 1001, 1002) for t in range(400 + c % 3)]
    compare(frame(spark, rows).repartition(5), rows)


def test_powers_and_carried_products(spark):
    assert prefix_trie.base_powers(prefix_trie.np.array([0, 1, 65_536, 200_001])).tolist() == [pow(int(prefix_trie.powers(2)[0][1]), e, 1 << 64) for e in (0, 1, 65_536, 200_001)]


def test_query_over_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op13_prefix_trie(spark, sf_dir).collect()
    assert {(r.conv_id, r.depth): tuple(r)[2:] for r in got} == plain(rows)


def test_equal_hashes_of_different_texts_are_refused(spark):
    turns = spark.createDataFrame([("user", "a", 1, 2), ("user", "b", 1, 2)], "role string, text string, a long, b long")
    with pytest.raises(ValueError):
        prefix_trie.check_texts(turns, turns.select("a", "b"))
