"""Repairs against all edits of short conversations, and the query against a
plain walk over every conversation."""

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from plantlens.llm import queries, repair

SOUND = re.compile(r"(s?(ua)+)?")


def all_edits(roles, faults):
    """The cheapest audit by trying every edit of every turn and up to two
    inserted turns in each place."""
    best = None
    slots = [["", "I", "II"]] * (len(roles) + 1)
    kinds = [["D"] if f in "bd" else ["D", "K", "Ru", "Ra"] for f in faults]
    for inner in itertools.product(*kinds):
        for outer in itertools.product(*slots):
            letters, cost, options = [], 0, [""]
            for i in range(len(roles) + 1):
                for _ in outer[i]:
                    letters.append("I")
                    cost += 3
                    options = [x + y for x in options for y in "ua"]
                if i < len(roles):
                    letters.append(inner[i][0])
                    cost += {"D": 4, "K": 0, "R": 3}[inner[i][0]] + (3 if faults[i] == "t" and inner[i] != "D" else 0)
                    if inner[i] != "D":
                        options = [x + (roles[i] if inner[i] == "K" else inner[i][1]) for x in options]
            if any(SOUND.fullmatch(x) for x in options):
                best = min(best or (cost, "".join(letters)), (cost, "".join(letters)))
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("sua-"), st.sampled_from("nnntbd")), max_size=3))
def test_against_all_edits(turns):
    roles, faults = "".join(r for r, _ in turns), "".join(f for _, f in turns)
    assert repair.cheapest_edits(roles, faults) == all_edits(roles, faults)


def by_tables(roles, faults):
    """Best (cost, audit) of every state after every turn, kept in full."""
    none = (10**9, "")
    table = {"": (0, "")}
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}

    def inserts(t):
        for _ in range(3):
            for q, (c, x) in list(t.items()):
                t[follow[q]] = min(t.get(follow[q], none), (c + 3, x + "I"))
        return t

    for r, f in zip(roles, faults):
        new = {}
        for q, (c, x) in inserts(table).items():
            options = [("D", 4, q)]
            if f not in "bd":
                more = 3 if f == "t" else 0
                options += [("K", more, r)] if r == follow[q] or (r == "s" and q == "") else []
                options += [("R", 3 + more, follow[q])]
            for e, k, to in options:
                new[to] = min(new.get(to, none), (c + k, x + e))
        table = new
    table = inserts(table)
    return min(table.get("", none), table.get("a", none))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suaua-"), st.sampled_from("nnnntbd")), max_size=40))
def test_against_tables(turns):
    roles, faults = "".join(r for r, _ in turns), "".join(f for _, f in turns)
    assert repair.cheapest_edits(roles, faults) == by_tables(roles, faults)


def test_long_conversation():
    roles = "suau" * 20_000
    cost, audit = repair.cheapest_edits(roles, "n" * len(roles))
    assert cost > 0 and len(audit) >= len(roles)


def plain(rows):
    """What the query returns, conversation by conversation."""
    blank = lambda v: " " if v is None else v
    damaged, ids = defaultdict(list), set()
    for c, t, role, text in rows:
        ids.add(c)
        role, text = blank(role), blank(text)
        kind = zlib.crc32(f"{blank(c)}:{blank(t)}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        damaged[c] += [(t, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for c in ids:
        turns = sorted(damaged[c], key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        seen, faults = set(), ""
        for t, role, text in turns:
            inner = re.findall(r"[^\x20\x09-\x0D]", text)
            faults += "b" if not inner else "d" if (role, text) in seen else "n" if inner[-1] in ".!?" else "t"
            seen.add((role, text))
        roles = "".join(r[:1] if r[:1] in ("s", "u", "a") else "-" for _, r, _ in turns)
        numbers = [t for t, *_ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(roles[i : i + 2] not in ("su", "ua", "au") for i in range(len(roles) - 1))
        cost, audit = by_tables(roles, faults)
        lines, left, last = [], list(turns), ""
        for e in audit:
            _, role, text = left.pop(0) if e != "I" else (None, "", "")
            if e == "D":
                continue
            if not (e == "K" and role[:1] == "s"):
                last = "a" if last == "u" else "u"
            if e != "K":
                role = {"u": "user", "a": "assistant"}[last]
            lines.append(f"{role}:{text}")
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[c] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, sha)
    return out


def compare(spark, rows, tmp_path):
    schema = "conv_id long, turn long, role string, text string, conv long, a string, audit string, kind string"
    spark.createDataFrame([(*r, 1, "x", "y", "z") for r in rows], schema).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op11_conversation_repair(spark, str(tmp_path)).collect()
    assert len(got) == len({r.conv_id for r in got})
    assert {r.conv_id: tuple(r)[1:] for r in got} == plain(rows)


def test_odd_turns(spark, tmp_path):
    names = ["system", "user", "assistant", "tool", "", None]
    texts = ["A stop.", "no stop", "Twice.", "Twice.", "", None, " \t", "Why?  ", "漢字。", "x" * 50_000 + "!"]
    rows = [(c, t, names[(c * 7 + t * t) % 6], texts[(c + 3 * t) % 10]) for c in range(60) for t in range(c % 9)]
    rows += [(1000, t, ["user", "assistant"][t % 2], f"turn {t}.") for t in range(500) if t % 17]
    rows += [(None, 3, "user", "Lost?"), (None, None, None, None), (None, 9, "assistant", "Here."), (61, None, "user", "x."), (61, None, "user", "x."), (62, 5, "user", "y."), (62, 5, "user", "y.")]
    rows += [(c, 0, "user", "One.") for c in range(2000, 2060)]
    compare(spark, rows, tmp_path)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op11_conversation_repair(spark, str(tmp_path)).count() == 0


def test_query_over_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op11_conversation_repair(spark, sf_dir).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == plain(rows)


def test_repaired_roles_are_sound(spark, sf_dir):
    damaged = repair.damage_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    turns = repair.repaired_turns(damaged, repair.plan_repairs(damaged)).collect()
    roles = defaultdict(str)
    for r in sorted(turns, key=lambda r: (r.conv_id, r.place)):
        roles[r.conv_id] += r.role[0]
    assert roles and all(SOUND.fullmatch(x) for x in roles.values())
