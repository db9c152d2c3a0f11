"""Conversation repair against a plain search, and odd inputs."""

import hashlib
import random
import re
import time
import zlib

import pytest

from trialframe.llm import repair as P
from trialframe.llm.queries import oracle_sql, queries

EMPTY = hashlib.sha256(b"").hexdigest()


def plain_edits(rows):
    """Cheapest (cost, letters, lines) of rows (role, text, fault): a search that keeps the best of each state."""
    expects, after = "uuau", {"s": 1, "u": 2, "a": 3}
    word = {"u": "user", "a": "assistant"}

    def inserted(best):
        for _ in range(4):
            for state, (cost, letters, lines) in list(best.items()):
                e = expects[state]
                new = (cost + 5, letters + "I", [*lines, f"{word[e]}:"])
                if after[e] not in best or new[:2] < best[after[e]][:2]:
                    best[after[e]] = new
        return best

    best = {0: (0, "", [])}
    for role, text, fault in rows:
        found = {}
        for state, (cost, letters, lines) in inserted(best).items():
            more, e = 5 * (fault == "truncated"), expects[state]
            moves = [(2, "D", state, [])]
            if fault not in ("blank", "duplicate"):
                if role[:1] == e or (role[:1] == "s" and state == 0):
                    moves.append((more, "K", after[role[:1]], [f"{role}:{text}"]))
                moves.append((1 + more, "R", after[e], [f"{word[e]}:{text}"]))
            for c, letter, to, line in moves:
                new = (cost + c, letters + letter, lines + line)
                if to not in found or new[:2] < found[to][:2]:
                    found[to] = new
        best = found
    best = inserted(best)
    return min((best[s] for s in (0, 3) if s in best), key=lambda x: x[:2])


def plain_repair(rows):
    """The contract's row for one conversation's rows (turn, role, text) in order."""
    seen, marked = set(), []
    counts = {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        marked.append((role, text, fault))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, letters, lines = plain_edits(marked)
    return (gaps, *counts.values(), illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def damaged(rows):
    """The contract's damage to rows (conv_id, turn, role, text), by conversation and in order."""
    out = {}
    shown = lambda x: " " if x is None else str(x)
    for conv_id, turn, role, text in rows:
        role, text = shown(role), shown(text)
        kept = out.setdefault(conv_id, [])
        fault = zlib.crc32(f"{shown(conv_id)}:{shown(turn)}".encode()) % 20
        role = "user" if fault == 4 else role
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        kept += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    digest = lambda x: hashlib.sha256(x.encode()).digest()
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r[2]))) for c, x in out.items()}


def rows_of(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def test_audits_equal_plain_search():
    names = ("system", "user", "assistant", "tool")
    draw = random.Random(3)
    for _ in range(4000):
        rows = [(names[draw.choice((0, 1, 1, 2, 2, 3))], "x", draw.choice((None, None, "truncated", "blank"))) for _ in range(draw.randrange(13))]
        symbols = bytes(P.MUST_DELETE if f == "blank" else P.row_symbol(r[:1], f == "truncated") for r, _, f in rows)
        assert P.audit(symbols) == plain_edits(rows)[:2]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql_and_plain_version(spark, compare, sf):
    path = f"/root/testdata/{sf}"
    got, expected = compare(queries()["op12_conversation_repair"], oracle_sql()["op12_conversation_repair"], path)
    assert got == expected
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = rows_of(queries()["op12_conversation_repair"](spark, path))
    assert found == {c: plain_repair(x) for c, x in damaged(rows).items()}


def test_random_and_odd_conversations(spark):
    draw = random.Random(11)
    texts = ["Yes.", "No", "", " ", "What?", "é! ", "a.\n", None, "Yes.", "x" * 50_000]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "ua"]
    rows = []
    for conv_id in [None, *range(80)]:
        for _ in range(draw.randrange(1, 14)):
            rows.append((conv_id, draw.choice((None, *range(9))), draw.choice(roles[:3] * 3 + roles), draw.choice(texts), "n"))
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n string")
    found = rows_of(P.repair_conversations(P.damaged_turns(conversations)))
    assert found == {c: plain_repair(x) for c, x in damaged([r[:4] for r in rows]).items()}
    lines = {}
    for r in sorted(P.repaired_turns(P.damaged_turns(conversations)).collect(), key=lambda r: (str(r.conv_id), r.place)):
        lines.setdefault(r.conv_id, []).append(r)
    for conv_id, row in found.items():
        mine = lines.get(conv_id, [])
        assert "".join(r.edit for r in mine) == row[6] and [r.place for r in mine] == list(range(len(mine)))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in mine if r.edit != "D").encode()).hexdigest() == row[7]


def test_all_rows_dropped_and_empty_table(spark):
    turn = next(i for i in range(1000) if zlib.crc32(f"7:{i}".encode()) % 20 == 0)
    conversations = spark.createDataFrame([(7, turn, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert rows_of(P.repair_conversations(P.damaged_turns(conversations))) == {7: (0, 0, 0, 0, 0, 0, "", EMPTY)}
    assert P.repair_conversations(P.damaged_turns(conversations.limit(0))).count() == 0


def test_one_long_conversation_with_a_row_that_repeats(spark):
    """Most rows are one row; their copies are one row with a count, and are deleted."""
    rows = spark.range(30_000).selectExpr("5L as conv_id", "if(id < 20000, 0L, id) as turn", "if(id < 20000 or id % 2 = 0, 'user', 'assistant') as role", "if(id < 20000, 'Again.', concat('Row ', id, '.')) as text", "1L as n")
    ((row),) = rows_of(P.repair_conversations(rows)).values()
    assert row[2] == 19_999 and row[6].count("D") >= 19_999 and len(row[6]) - row[6].count("I") == 30_000


def test_time_is_linear():
    def took(n):
        symbols = bytes(random.Random(1).choices(range(1, 10), k=n))
        P.tables().expanded.cache_clear()
        began = time.process_time()
        P.audit(symbols)
        return time.process_time() - began

    took(1000)
    assert took(200_000) < 16 * max(took(25_000), 0.05)
