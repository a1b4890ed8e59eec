"""Repair of the structure of conversations.

The turns of a conversation are to have the roles ``(s?(ua)+)?``: perhaps a system
turn, then user and assistant by turns, or nothing at all. Turns are kept,
given another role, deleted or inserted, at a cost each. The cheapest edits, and of
equally cheap ones those whose initials are least in ASCII, are found by a
depth-first branch and bound over (turns read, role of the last one kept).

Faults are found row by row before anything is shuffled. A conversation's search
needs two letters a turn, so hashes and not texts are sorted for it; the texts are
sorted once, to apply the edits in one pass that holds none of them.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import map_batches

SPACES = " \t\n\x0b\x0c\r"
RETAIN, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
LEGAL = {"su", "ua", "au"}
#: What the last turn kept is: nothing yet, s, u or a; and what an inserted or rerolled turn then becomes.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = ("", "system", "user", "assistant")
ORDER = ("conv", "turn", "role", "a", "b")


def steps(role: str, fault: str, state: int) -> list[tuple[str, int, int]]:
    """The edits of the next turn: initial, cost and new state, in ASCII order."""
    found = [("D", DELETE, state)]
    if fault not in "bd":
        extra = TRUNCATED if fault == "t" else 0
        to = NEXT[state]
        if role == "s" and state == NOTHING:
            found.append(("K", RETAIN + extra, SYSTEM))
        if role == "sua"[to - 1]:
            found.append(("K", RETAIN + extra, to))
        else:
            found.append(("R", REROLE + extra, to))
    return found


def suffix_bounds(roles: str, faults: str) -> array:
    """For each number of turns read and each state, the least cost of the rest,
    audits left aside."""
    n = len(roles)
    bound = array("l", bytes(array("l").itemsize * 4 * (n + 1)))
    bound[4 * n + SYSTEM], bound[4 * n + USER] = 2 * INSERT, INSERT
    known: dict[tuple[str, str], list[list[tuple[str, int, int]]]] = {}
    for i in range(n - 1, -1, -1):
        kind = roles[i], faults[i]
        if kind not in known:
            known[kind] = [steps(*kind, q) for q in range(4)]
        after = 4 * (i + 1)
        own = [min([cost + bound[after + to] for _, cost, to in known[kind][q]]) for q in range(4)]
        for q in range(4):
            once, twice = NEXT[q], NEXT[NEXT[q]]
            bound[4 * i + q] = min(own[q], INSERT + own[once], 2 * INSERT + own[twice])
    return bound


def cheapest_edits(roles: str, faults: str) -> tuple[int, str]:
    """Cost and audit of the best repair. ``roles`` and ``faults`` have a letter a
    turn: s, u, a or - and b(lank), d(uplicate), t(runcated) or n(one).

    The incumbent starts at the root's bound, without an audit. A prefix is left
    where its cost and the bound of the rest exceed the incumbent's, or where they
    equal it once an audit is known: children are taken by bound, then letter, so
    later audits of that cost are greater. For the same reason the
    first of the prefixes that reach a node at a cost dominates the others. The search
    ends, with the optimum proved, when the stack is empty."""
    n, bound = len(roles), suffix_bounds(roles, faults)
    best_cost, best_audit = bound[NOTHING], None
    reached: dict[int, int] = {}  # node: least cost of a prefix that led there
    path = bytearray()
    stack: list[tuple[int, int, int, int]] = [(0, 0, 0, NOTHING)]  # length before, letter, cost, node
    while stack:
        depth, letter, cost, node = stack.pop()
        del path[max(depth - 1, 0) :]
        if letter:
            path.append(letter)
        total = cost + bound[node]
        if total > best_cost or (best_audit is not None and total == best_cost) or reached.get(node, cost + 1) <= cost:
            continue
        reached[node] = cost
        i, state = divmod(node, 4)
        if i == n and state in (NOTHING, ASSISTANT):
            best_cost, best_audit = cost, path.decode()
            continue
        found = [("I", INSERT, 4 * i + NEXT[state])]
        if i < n:
            found += [(x, c, 4 * (i + 1) + to) for x, c, to in steps(roles[i], faults[i], state)]
        found = [(cost + c + bound[to], x, c, to) for x, c, to in found if cost + c + bound[to] <= best_cost]
        for _, x, c, to in sorted(found, reverse=True):
            stack.append((depth + 1, ord(x), cost + c, to))
    return best_cost, best_audit or ""


def damage_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Damages turns by a checksum of conversation and number: one in twenty each is
    dropped, emptied, stripped of full stops, repeated beside itself, or given
    to the user. Nulls count as one space."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = df.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        shown(role_col).alias("role"),
        shown(text_col).alias("text"),
        (F.crc32(F.concat(shown(conv_col), F.lit(":"), shown(turn_col))) % 20).alias("kind"),
    )
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.filter("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def read_turns(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    rows = df.select(
        F.col(conv_col).cast("long").alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    return rows.withColumns({c: F.xxhash64(F.lit(i), "role", "text") for i, c in enumerate("ab")})


def with_faults(turns: DataFrame) -> DataFrame:
    """conv, turn, role, a, b, letter (of the role) and fault: b, t or n, or d
    where the same role and text have a lower turn number in the conversation."""
    end = F.rtrim("text", F.lit(SPACES))
    fault = F.when(end == "", "b").when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "t").otherwise("n")
    first = F.left("role", F.lit(1))
    rows = turns.select(*ORDER, F.when(first.isin("s", "u", "a"), first).otherwise("-").alias("letter"), fault.alias("own"))
    number = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    seen = rows.filter("own <> 'b'").groupBy("conv", "a", "b").agg(F.count("*").alias("n"), F.min(number).alias("first")).filter("n > 1")
    r, s = rows.alias("r"), seen.alias("s")
    both = r.join(s, F.col("r.conv").eqNullSafe(F.col("s.conv")) & (F.col("r.a") == F.col("s.a")) & (F.col("r.b") == F.col("s.b")), "left")
    late = (F.col("own") != "b") & F.coalesce(F.struct(F.col("r.turn").isNotNull().alias("known"), "r.turn") > F.col("s.first"), F.lit(False))
    return both.select(*[F.col(f"r.{c}").alias(c) for c in ORDER], "letter", F.when(late, "d").otherwise(F.col("own")).alias("fault"))


def plan_repairs(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a conversation: conv_id, gaps (numbers missing between the least and
    the greatest), blank, duplicate and truncated (turns by their first fault),
    illegal (neighbours whose roles may not follow each other), cost and audit (the
    initials of Keep, Rerole, Delete and Insert in order).

    Turns go by number, those without one first, ties by role and the hashes of role
    and text, so that equal turns are neighbours and the later one is the duplicate. Null
    roles and texts are empty. Turns without a conversation are one conversation of their
    own, of conv_id null. An empty table gives no rows; other columns are not read.
    A task holds two letters for each turn of the conversation at hand, and none of its texts."""
    rows = with_faults(read_turns(df, conv_col, turn_col, role_col, text_col))
    ordered = rows.repartition("conv").sortWithinPartitions(*ORDER).drop("role")
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    kinds = [*[pa.int64()] * 7, pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, begun, last = None, False, None
        roles, faults = bytearray(), bytearray()
        numbers: list[int] = []  # distinct turns, least, greatest

        def plan() -> tuple:
            r, f = roles.decode(), faults.decode()
            cost, audit = cheapest_edits(r, f)
            illegal = sum(x + y not in LEGAL for x, y in pairwise(r))
            gaps = numbers[2] - numbers[1] + 1 - numbers[0] if numbers else 0
            return conv, gaps, f.count("b"), f.count("d"), f.count("t"), illegal, cost, audit

        def rows_of(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=names)

        for batch in batches:
            found = []
            for own, turn, a, b, letter, fault in zip(*[c.to_pylist() for c in batch.columns]):
                if not begun or own != conv:
                    if begun:
                        found.append(plan())
                    conv, begun, last = own, True, None
                    roles.clear(), faults.clear(), numbers.clear()
                if turn is not None:
                    if not numbers:
                        numbers[:] = 1, turn, turn
                    elif turn != numbers[2]:
                        numbers[0] += 1
                        numbers[2] = turn
                if fault != "b" and last == (turn, a, b):
                    fault = "d"
                last = turn, a, b
                roles += letter.encode()
                faults += fault.encode()
            if found:
                yield rows_of(found)
        if begun:
            yield rows_of([plan()])

    return map_batches(ordered, run, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def repaired_turns(
    df: DataFrame, plans: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """The turns of the repaired conversations: conv_id, place (from 0), edit (K, R or
    I), role and text, in order within a conversation. A conversation of which nothing
    is left has no rows. ``plans`` is the result of ``plan_repairs`` on the same table."""
    turns = read_turns(df, conv_col, turn_col, role_col, text_col).select(*ORDER, "text", F.lit(1).alias("is_turn"))
    audits = plans.select(F.col("conv_id").alias("conv"), F.col("audit").alias("text"), F.lit(0).alias("is_turn"))
    ordered = turns.unionByName(audits, allowMissingColumns=True).repartition("conv").sortWithinPartitions("conv", "is_turn", *ORDER[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, state, place = None, "", 0, NOTHING, 0

        def inserted(found: list[tuple]) -> None:
            nonlocal at, state, place
            while at < len(audit) and audit[at] == "I":
                state = NEXT[state]
                found.append((conv, place, "I", ROLES[state], ""))
                at, place = at + 1, place + 1

        def rows_of(found: list[tuple]) -> pa.RecordBatch:
            kinds = pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=["conv_id", "place", "edit", "role", "text"])

        for batch in batches:
            found: list[tuple] = []
            for own, role, text, is_turn in zip(*[c.to_pylist() for c in batch.columns]):
                if not is_turn:
                    inserted(found)  # behind the last turn of the conversation before
                    conv, audit, at, state, place = own, text, 0, NOTHING, 0
                    continue
                inserted(found)
                edit, at = audit[at], at + 1
                if edit == "D":
                    continue
                if edit == "K" and state == NOTHING and role[:1] == "s":
                    state = SYSTEM
                else:
                    state = NEXT[state]
                found.append((conv, place, edit, ROLES[state] if edit == "R" else role, text))
                place += 1
            if found:
                yield rows_of(found)
        found = []
        inserted(found)
        if found:
            yield rows_of(found)

    ordered = ordered.select("conv", "role", "text", "is_turn")
    return map_batches(ordered, run, "conv_id long, place long, edit string, role string, text string")


def conversation_digests(repaired: DataFrame) -> DataFrame:
    """conv_id and the digest of the ``role:text`` lines of each conversation, from
    rows that stand in order, as those of ``repaired_turns`` do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha = None, None

        def rows_of(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), (pa.int64(), pa.string()))], names=["conv_id", "repaired_sha256"])

        for batch in batches:
            found = []
            for own, place, role, text in zip(*[c.to_pylist() for c in batch.columns]):
                line = f"{role}:{text}".encode()
                if place:
                    sha.update(b"\n" + line)
                    continue
                if sha is not None:
                    found.append((conv, sha.hexdigest()))
                conv, sha = own, hashlib.sha256(line)
            if found:
                yield rows_of(found)
        if sha is not None:
            yield rows_of([(conv, sha.hexdigest())])

    return map_batches(repaired.select("conv_id", "place", "role", "text"), run, "conv_id long, repaired_sha256 string")
