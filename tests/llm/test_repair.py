"""Conversation repair against a plain uniform-cost search over whole conversations."""

import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import pytest

from susceptra.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """rows (turn, role, text) in order, their first faults -> cost, audit, repaired text."""
    seen, faults = set(), []
    for _, role, text in rows:
        stripped = text.strip(SPACE)
        faults.append("blank" if not stripped else "duplicate" if (role, text) in seen else "" if stripped[-1] in ".!?" else "truncated")
        seen.add((role, text))
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    queue, done = [(0, "", 0, "", "")], set()
    while queue:
        cost, audit, i, state, said = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return faults, cost, audit, said[1:]
        new = after[state]
        name = {"u": "user", "a": "assistant"}[new]
        heapq.heappush(queue, (cost + 5, audit + "I", i, new, f"{said}\n{name}:"))
        if i < len(rows):
            heapq.heappush(queue, (cost + 2, audit + "D", i + 1, state, said))
            if faults[i] in ("", "truncated"):
                more, (_, role, text) = 5 * bool(faults[i]), rows[i]
                if role[:1] == new or role[:1] == "s" and state == "":
                    heapq.heappush(queue, (cost + more, audit + "K", i + 1, role[:1], f"{said}\n{role}:{text}"))
                heapq.heappush(queue, (cost + more + 1, audit + "R", i + 1, new, f"{said}\n{name}:{text}"))
    raise AssertionError("no path")


def plain(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        own = by[conv]
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if fault:
            text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
            own += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        faults, cost, audit, said = cheapest(own)
        turns = {r[0] for r in own} - {None}
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:], strict=False)]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *map(faults.count, ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(said.encode()).hexdigest())
    return out


def made(seed, sizes):
    rng = random.Random(seed)
    roles = ("user", "assistant", "system", "user", "assistant", "tool", "", None)
    texts = ("Hi.", "Yes!", "no", "  ", "\n", "", None, "ok then", "What? ", "Cut off.")
    return [(c, rng.choice((None, *range(n))), rng.choice(roles), rng.choice((*texts, f"line {rng.random()}."))) for c, n in sizes for _ in range(n)]


def checked(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = repair.repair_conversations(df.selectExpr("*", *[f"{v} as {k}" for k, v in more.items()]))
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == plain(rows)


def test_edges(spark):
    rows = made(1, [(None, 6), *[(c, c % 9) for c in range(120)]])
    checked(spark, rows + rows[:80], fault="1", place="'x'", audit="7", edit="null")


def test_runs_of_a_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT_BITS", 3)
    checked(spark, made(2, [(1, 700), (2, 3), (3, 60)]))


def test_long_conversation_and_text(spark):
    checked(spark, [*made(3, [(1, 9000)]), (2, 0, "user", "long " * 200_000 + "."), (2, 1, "assistant", "Yes.")])


def test_all_rows_dropped_and_no_rows(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = repair.repair_conversations(spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)).first()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair.repair_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_widest_turns(spark):
    convs = [c for c in range(200) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 > 4 for t in (-(2**63), 2**63 - 1))]
    got = repair.repair_conversations(spark.createDataFrame([(convs[0], -(2**63), "user", "Hi."), (convs[0], 2**63 - 1, "assistant", "Yes.")], SCHEMA)).first()
    assert got.gaps is None and got.cost == 0 and got.audit == "KK"


@pytest.mark.parametrize(("codes", "audit"), [("", ""), ("ua", "KK"), ("s", "D"), ("su", "RR"), ("sua", "KKK"), ("aua", "DKK"), ("uu", "KR"), ("xua", "DKK"), ("Ua", "DD"), ("uaU", "KKD")])
def test_audits(codes, audit):
    done, state = repair.walk(codes, repair.GOAL, 0)
    assert "".join(done) + repair.ENDING[state] == audit
