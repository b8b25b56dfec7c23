"""Conversation structure repair: the cheapest edits that make the roles of a conversation `(s?(ua)+)?`.

A conversation is a path through nodes (rows behind us, state), where the state is what was said last: nothing, system,
user or assistant. Arcs keep (0), rerole (1), delete (2) or insert (5) a row; a truncated row that stays costs 5 more. Such
small integers are what Dial's bucket queue is for: distances to the goal are found bucket by bucket without a heap, and
then the walk takes, of the arcs that lose no distance, always the one with the least initial, which gives the
least of the cheapest audits.

A conversation may be very long, so it is never held whole. Rows get a place by a range sort, and runs of up to
SEGMENT rows are worked on apart: Dial's queue gives each run's costs from every state to every state, those are combined
from the end to give each run the distances behind it, and each run is then walked from every state, so that runs combined
from the start tell which walk is the true one. What is gathered for a conversation is twenty-odd numbers for each run. An audit
is one string, so there are under 2 ** 31 rows and half a million runs. Only SHA-256 has to see all lines in order: the last pass
streams them, sorted, and holds no more than an Arrow batch and the audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from susceptra.llm.text import hex_digest
from susceptra.storage import bounded_batches, materialise

SEGMENT_BITS = 12
SEGMENT = 1 << SEGMENT_BITS
DELETE, INSERT, REROLE, UNFINISHED = 2, 5, 1, 5
FAR = 1 << 40
#: States: nothing yet, after system, after user, after assistant; what may be put next; and what is missing at the end.
NEXT, ENDING = (2, 2, 3, 2), ("", "II", "I", "")
BEFORE = ((), (), (0, 1, 3), (2,))
GOAL = tuple(len(x) * INSERT for x in ENDING)
#: A row's letter: its role's initial (o: another), a capital if truncated; w, x, y, z for s, u, a, o that must go.
CODES = {"s": (1, 0, False), "u": (2, 0, False), "a": (3, 0, False), "o": (0, 0, False), "S": (1, UNFINISHED, False), "U": (2, UNFINISHED, False), "A": (3, UNFINISHED, False), "O": (0, UNFINISHED, False), "w": (1, 0, True), "x": (2, 0, True), "y": (3, 0, True), "z": (0, 0, True)}
_SPACES = " \t\n\x0b\x0c\r"
#: What the functions on batches below return.
RUN_COSTS = "struct<costs array<long>, illegal long>"
BEHIND = "struct<cost long, illegal long, goals array<array<long>>>"
EXITS = "array<int>"
ENTRIES = "array<int>"
EDITS = "array<string>"


def distances(codes: str, goal: tuple[int, ...]) -> list[int]:
    """Least cost from node 4 * row + state to the end of the run, where state q still costs goal[q]; Dial's queue, backwards."""
    n = len(codes)
    h = [FAR] * (4 * n + 4)
    known = [g for g in goal if g < FAR]
    # all keys waiting are within the goal's spread and the largest arc, so that many buckets serve as a ring
    ring = max(known) - min(known) + REROLE + UNFINISHED + 1
    buckets: list[list[int]] = [[] for _ in range(ring)]
    waiting, now = 0, min(known)

    def reach(node: int, d: int) -> int:
        if d < h[node]:
            h[node] = d
            buckets[d % ring].append(node)
            return 1
        return 0

    for q, g in enumerate(goal):
        waiting += reach(4 * n + q, g) if g < FAR else 0
    while waiting:
        bucket = buckets[now % ring]
        while bucket:
            node = bucket.pop()
            waiting -= 1
            if h[node] != now:
                continue
            i, q = divmod(node, 4)
            if i < n:  # what is put in at the run's end belongs to the next run
                for p in BEFORE[q]:
                    waiting += reach(4 * i + p, now + INSERT)
            if i:
                role, more, must_go = CODES[codes[i - 1]]
                waiting += reach(node - 4, now + DELETE)
                if not must_go:
                    for p in BEFORE[q]:
                        waiting += reach(4 * i - 4 + p, now + more + (REROLE if role != q else 0))
                    if q == 1 and role == 1:
                        waiting += reach(4 * i - 4, now + more)
        now += 1
    return h


@lru_cache(4096)
def transfer(codes: str) -> tuple[int, ...]:
    """Least cost through the run from state p to state q, at 4 * p + q."""
    columns = [distances(codes, tuple(0 if q == t else FAR for q in range(4)))[:4] for t in range(4)]
    return tuple(min(columns[q][p], FAR) for p in range(4) for q in range(4))


@lru_cache(4096)
def walk(codes: str, goal: tuple[int, ...], state: int) -> tuple[tuple[str, ...], int]:
    """From this state along arcs without loss: what is done at each row (insertions before it, then its own), and the last state."""
    h, i, done, inserted = distances(codes, goal), 0, [], ""
    while i < len(codes):
        left, (role, more, must_go), ahead = h[4 * i + state], CODES[codes[i]], NEXT[state]
        stays = None if must_go else 1 if role == 1 and state == 0 else ahead if role == ahead else None
        if h[4 * i + 4 + state] + DELETE == left:
            label, after = "D", state
        elif h[4 * i + ahead] + INSERT == left:
            inserted, state = inserted + "I", ahead
            continue
        elif stays is not None and h[4 * i + 4 + stays] + more == left:
            label, after = "K", stays
        else:
            label, after = "R", ahead
        done.append(inserted + label)
        i, state, inserted = i + 1, after, ""
    return tuple(done), state


def _illegal(before: str, after: str) -> bool:
    return (CODES[before][0], CODES[after][0]) not in ((1, 2), (2, 3), (3, 2))


def run_costs(codes: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"costs": [list(transfer(c)) for c in codes], "illegal": [sum(map(_illegal, c, c[1:])) for c in codes]})


def behind(costs: pd.Series, ends: pd.Series) -> pd.DataFrame:
    """Costs of a conversation's runs in order -> its own cost and, for each run, what is left behind it."""
    rows = []
    for runs, edge in zip(costs, ends, strict=True):
        goal, goals = GOAL, []
        for m in reversed(runs):
            goals.append(list(goal))
            goal = tuple(min(min(int(m[4 * p + q]) + goal[q] for q in range(4)), FAR) for p in range(4))
        rows.append((goal[0], sum(_illegal(a[1], b[0]) for a, b in zip(edge[:-1], edge[1:], strict=True)), goals[::-1]))
    return pd.DataFrame(rows, columns=["cost", "illegal", "goals"])


def exits(codes: pd.Series, goals: pd.Series) -> pd.Series:
    return pd.Series([[walk(c, tuple(map(int, g)), p)[1] if g[p] < FAR or p == 0 else 0 for p in range(4)] for c, g in zip(codes, goals, strict=True)])


def entries(exits: pd.Series) -> pd.Series:
    """Exits of a conversation's runs in order -> the state in which each is entered."""
    rows = []
    for runs in exits:
        state, found = 0, []
        for e in runs:
            found.append(state)
            state = int(e[state])
        rows.append(found)
    return pd.Series(rows)


def edits(codes: pd.Series, goals: pd.Series, state: pd.Series) -> pd.Series:
    return pd.Series([list(walk(c, tuple(map(int, g)), int(p))[0]) for c, g, p in zip(codes, goals, state, strict=True)])


def damaged(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) with faults by checksum of `conv_id:turn`, modulo 20: 0 drops the row, 1 empties its text,
    2 takes `[.!?]` out of it, 3 repeats it (copies 2), 4 makes its role user. Nulls are one space, but conv_id and turn stay."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), fault.alias("fault")).filter("fault <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("fault") == 3, 2).otherwise(1).cast("long").alias("copies"))


def _same(left: DataFrame, right: DataFrame, keys: tuple[str, ...], how: str = "left") -> DataFrame:
    """Join on keys, null equal to null; the left side's keys stay."""
    renamed = right.select(*[F.col(c).alias(f"{c}_r") if c in keys else F.col(c) for c in right.columns])
    on = [left[k].eqNullSafe(renamed[f"{k}_r"]) for k in keys]
    return left.join(renamed, on, how).drop(*[f"{k}_r" for k in keys])


def _code(role: Column, goes: Column, unfinished: Column) -> Column:
    first = F.substring(role, 1, 1)
    at = F.when(first == "s", 1).when(first == "u", 2).when(first == "a", 3).otherwise(4)
    return F.substring(F.when(goes, "wxyz").when(unfinished, "SUAO").otherwise("suao"), at, F.lit(1))


def placed_rows(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, copies) -> one row for equal ones, without text: its digest, fault, code and place.

    Places rise with (conv_id, turn, role, digest), nulls first. A range sort gives them, so the rows of a long conversation
    are dealt over many tasks; equal rows were added up before.
    """
    stripped = F.rtrim(F.col("text"), F.lit(_SPACES))
    last = F.substring(stripped, -1, 1)
    state = F.when(stripped == "", 1).when(last.isin(".", "!", "?"), 0).otherwise(3)
    slim = rows.select("conv_id", "turn", "role", F.unhex(hex_digest(F.col("text"))).alias("digest"), state.alias("fault"), "copies")
    slim = slim.groupBy("conv_id", "turn", "role", "digest", "fault").agg(F.sum("copies").alias("copies"))
    slim = materialise(slim, "turns")
    said = slim.groupBy("conv_id", "role", "digest").agg(F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("unnumbered"))
    both = _same(slim, said, ("conv_id", "role", "digest"))
    again = F.col("turn").isNotNull() & (F.col("unnumbered") | (F.col("turn") > F.col("first")))
    fault = F.when((F.col("fault") != 1) & again, 2).otherwise(F.col("fault"))
    both = both.select("conv_id", "turn", "role", "digest", "copies", fault.alias("fault"))
    both = both.withColumn("code", _code(F.col("role"), F.col("fault").isin(1, 2), F.col("fault") == 3))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "digest")]
    ranged = materialise(both, "faults").repartitionByRange(*order).sortWithinPartitions(*order)
    return materialise(ranged.withColumn("place", F.monotonically_increasing_id()), "places")


def repaired(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text, copies), not null but for conv_id and turn -> conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit and repaired_sha256 of every conversation with rows.

    Rows are taken by turn, nulls first; rows of equal turn by role and digest. Of equal rows all but the first are duplicates,
    as is a row whose role and text were seen at an earlier turn. gaps beyond a long are null.
    """
    bounded_batches(turns.sparkSession)
    placed = placed_rows(turns)
    more = F.col("copies") - 1
    total = lambda x: F.sum(x).cast("long")
    faults = placed.groupBy("conv_id").agg(
        F.expr("try_subtract(try_add(try_subtract(max(turn), min(turn)), 1L), count(DISTINCT turn))").alias("spread"), F.count("turn").alias("numbered"),
        total(F.when(F.col("fault") == 1, F.col("copies")).otherwise(0)).alias("blank"),
        total(F.when(F.col("fault") == 2, F.col("copies")).when(F.col("fault") == 1, 0).otherwise(more)).alias("duplicate"),
        total(F.when(F.col("fault") == 3, 1).otherwise(0)).alias("truncated"), total(more).alias("more"))
    row = F.struct("place", "code")
    runs = placed.groupBy("conv_id", F.shiftright("place", SEGMENT_BITS).alias("block")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    runs = runs.select("conv_id", F.col("rows")[0]["place"].alias("run"), F.col("rows")["place"].alias("places"), F.concat_ws("", F.col("rows")["code"]).alias("codes"))
    runs = materialise(runs, "runs")
    crossed = runs.select("conv_id", "run", F.pandas_udf(run_costs, RUN_COSTS)("codes").alias("c"), F.concat(F.substring("codes", 1, 1), F.substring("codes", -1, 1)).alias("edge"))
    crossed = crossed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("run", F.col("c.costs").alias("costs"), "edge"))).alias("r"), F.sum("c.illegal").alias("illegal"))
    crossed = materialise(crossed.select("conv_id", "illegal", F.col("r")["run"].alias("runs"), F.pandas_udf(behind, BEHIND)(F.col("r")["costs"], F.col("r")["edge"]).alias("b")), "costs")
    goals = crossed.select(F.explode(F.arrays_zip(F.col("runs").alias("run"), F.col("b.goals").alias("goal"))).alias("g")).select("g.run", "g.goal")
    ahead = materialise(runs.join(goals, "run"), "goals")
    left = ahead.select("conv_id", "run", F.pandas_udf(exits, EXITS)("codes", "goal").alias("exits")).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("run", "exits"))).alias("r"))
    left = left.select(F.explode(F.arrays_zip(F.col("r")["run"].alias("run"), F.pandas_udf(entries, ENTRIES)(F.col("r")["exits"]).alias("state"))).alias("e")).select("e.run", "e.state")
    done = ahead.join(left, "run").select("places", F.pandas_udf(edits, EDITS)("codes", "goal", "state").alias("edits"))
    done = done.select(F.explode(F.arrays_zip(F.col("places").alias("place"), F.col("edits").alias("edit"))).alias("e")).select("e.place", "e.edit")
    keys = ("conv_id", "turn", "role", "digest")
    texts = turns.select("conv_id", "turn", "role", F.unhex(hex_digest(F.col("text"))).alias("digest"), "text").groupBy(*keys).agg(F.first("text").alias("text"))
    lines = _same(placed.select(*keys, "copies", "place").join(done, "place"), texts, keys).select("conv_id", "place", "copies", "edit", "role", "text")
    read = lines.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    schema = lines.select("conv_id").schema.add("audit", "string").add("repaired_sha256", "string")
    audits = read.mapInArrow(read_in_order, schema)
    found = _same(_same(faults, crossed.select("conv_id", F.col("b.cost").alias("cost"), (F.col("illegal") + F.col("b.illegal")).alias("illegal")), ("conv_id",)), audits, ("conv_id",))
    return found.select(
        "conv_id", F.when(F.col("numbered") == 0, 0).otherwise(F.col("spread")).cast("long").alias("gaps"), "blank", "duplicate", "truncated",
        (F.col("illegal") + F.col("more")).alias("illegal"), (F.col("cost") + DELETE * F.col("more")).alias("cost"), "audit", "repaired_sha256")


def read_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole conversations in order -> audit and digest of each; lines are hashed as they come."""
    names = {2: b"user", 3: b"assistant"}
    key, begun, audit, sha, state, first = None, False, [], hashlib.sha256(), 0, True

    def say(role: bytes, text: bytes) -> None:
        nonlocal first
        sha.update(b"" if first else b"\n")
        first = False
        sha.update(role + b":" + text)

    def insert(n: int) -> None:
        nonlocal state
        for _ in range(n):
            state = NEXT[state]
            say(names[state], b"")

    def close() -> tuple:
        audit.append(ENDING[state])
        insert(len(ENDING[state]))
        return key, "".join(audit), sha.hexdigest()

    for b in batches:
        ended = []
        for conv, copies, edit, role, text in zip(*(b.column(c) for c in ("conv_id", "copies", "edit", "role", "text")), strict=True):
            if not begun or conv.as_py() != key:
                if begun:
                    ended.append(close())
                key, begun, audit, sha, state, first = conv.as_py(), True, [], hashlib.sha256(), 0, True
            done = edit.as_py()
            insert(len(done) - 1)
            if done[-1] == "R":
                state = NEXT[state]
                say(names[state], text.as_py().encode())
            elif done[-1] == "K":
                state = 1 if state == 0 and role.as_py()[0] == "s" else NEXT[state]
                say(role.as_py().encode(), text.as_py().encode())
            audit.append(done + "D" * (copies.as_py() - 1))
        yield _closed(b.column("conv_id").type, ended)
        kind = b.column("conv_id").type
    if begun:
        yield _closed(kind, [close()])


def _closed(kind: pa.DataType, ended: list[tuple]) -> pa.RecordBatch:
    conv, audit, digest = zip(*ended, strict=True) if ended else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(conv, kind), pa.array(audit, pa.string()), pa.array(digest, pa.string())], ["conv_id", "audit", "repaired_sha256"])


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """The report of `repaired` on the damaged rows of conversations, one row for every conv_id it has.

    A null conv_id is a conversation of its own. Null turns come first and count in no gap; a null role or text is one space, so
    such a text is blank. Conversations whose rows all went have zeros, an empty audit and the empty text's digest. Repeated
    rows are damaged alike and count as repeats; other columns are not read; an empty table gives no rows.
    """
    known = conversations.select("conv_id").distinct()
    found = repaired(damaged(conversations.select("conv_id", "turn", "role", "text")))
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    absent = F.col("audit").isNull()
    return _same(known, found, ("conv_id",)).select(
        "conv_id", *[F.when(absent, 0).otherwise(F.col(c)).cast("long").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
