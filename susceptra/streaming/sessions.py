"""Sequence sessions as a stream: each step must be the next of its schedule and extend what was seen, as carried state says."""

from __future__ import annotations

import hashlib
from collections import namedtuple
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from susceptra.operators.sketch import kmer_sets
from susceptra.operators.validate import FINE_GRID, GRID

STEPS = "session string, seq long, species string, percent int, fine boolean, observed string, completed string"
ANSWERS = "session string, seq long, percent int, reason string, bases long, chain string, jaccard double, ratio double"
#: Sessions are dealt into so many groups. A group's sessions are one value of the state: a micro-batch asks for it once for
#: each group, not once for each session. The number is part of a checkpoint.
GROUPS = 4096
#: When the group's timer is due, and its sessions, as an Arrow stream of _SESSIONS.
STATE = "wake long, sessions binary"
#: A session: what was accepted last; due: the milliseconds at which it is given up.
_SESSIONS = pa.schema([("session", pa.string()), ("species", pa.string()), ("percent", pa.int32()), ("fine", pa.bool_()), ("bases", pa.int64()), ("sha256", pa.string()), ("chain", pa.string()), ("guess", pa.string()), ("guess_fits", pa.bool_()), ("seq", pa.int64()), ("due", pa.int64())])
#: Bases take two bits of a byte.
_PACKING = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1))
_STEP = namedtuple("_STEP", "seq species percent fine observed guess guess_fits")
_ANSWERS = [x.split()[0] for x in ANSWERS.split(", ")]
#: Stand for null in columns of numbers.
NO_SEQ, NO_PERCENT = -(1 << 63), -(1 << 31)
#: A session may start here.
STARTS = (20, 100)


def group_of(session: Column) -> Column:
    return F.pmod(F.xxhash64(session), F.lit(GROUPS))


def _packed(sessions: dict[str | None, dict]) -> bytes:
    rows = [{"session": k, **s} for k, s in sessions.items()]
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, _SESSIONS, options=_PACKING) as writer:
        writer.write_batch(pa.RecordBatch.from_pylist(rows, schema=_SESSIONS))
    return out.getvalue().to_pybytes()


def _unpacked(held: bytes) -> dict[str | None, dict]:
    return {s.pop("session"): s for s in pa.ipc.open_stream(held).read_all().to_pylist()}


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def likenesses(pairs: list[tuple[str, str | None]]) -> list[tuple[float, float]]:
    """ML12 of each (new, guess): Jaccard similarity of the k-mer sketches of what is new and of what was guessed for it, and their length ratio."""
    met = [(i, new, guess[: len(new)]) for i, (new, guess) in enumerate(pairs) if guess is not None and new]
    sets, found = kmer_sets([x for _, new, guess in met for x in (new, guess)], 19, 11), [(-1.0, 0.0)] * len(pairs)
    for (i, new, guess), a, b in zip(met, sets[::2], sets[1::2], strict=True):
        found[i] = len(a & b) / max(1, len(a | b)), len(guess) / len(new)
    return found


def refusal(step, old: dict | None) -> str | None:
    """Why a step does not follow the state, or None."""
    grid = FINE_GRID if step.fine else GRID
    if step.percent not in grid:
        return "percentage_not_scheduled"
    if old is None:
        return None if step.percent in STARTS else "session_starts_elsewhere"
    if old["species"] != step.species:
        return "species_changed"
    if old["fine"] != step.fine:
        return "schedule_changed"
    if len(step.observed) < old["bases"] or digest(step.observed[: old["bases"]]) != old["sha256"]:
        return "prefix_changed"
    if old["percent"] == 100 or step.percent != grid[grid.index(old["percent"]) + 1]:
        return "not_the_next_step"
    if len(step.observed) == old["bases"]:
        return "no_more_sequence"
    return None if old["guess_fits"] else "prediction_changed"


class Schedule(StatefulProcessor):
    """One value a group of sessions; of each, what was accepted last, and a chain of digests over all accepted steps.

    The state holds the last prediction's tail, never the sequences seen: their length and digest are enough to know them
    again. With idle_ms, a session without an accepted step for so long is given up: its state goes and a row says so. A
    group has one timer, for the first of its sessions that is due. A group's steps of a micro-batch are held at once.
    """

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle, self.group = handle, handle.getValueState("group", STATE)

    def _get(self) -> tuple[int | None, dict[str | None, dict]]:
        held = self.group.get()
        return (None, {}) if held is None else (held[0], _unpacked(held[1]))

    def _put(self, wake: int | None, sessions: dict[str | None, dict]) -> None:
        """Keep the sessions, with the timer at the first that is due; wake is when it was due so far."""
        first = min((s["due"] for s in sessions.values() if s["due"] is not None), default=None)
        if first != wake:
            if wake is not None:
                self.handle.deleteTimer(wake)
            if first is not None:
                self.handle.registerTimer(first)
        if sessions:
            self.group.update((first, _packed(sessions)))
        else:
            self.group.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        plain = lambda x: x if isinstance(x, str) else None
        came: dict[str | None, list[_STEP]] = {}
        for part in rows:
            for session, seq, species, percent, fine, observed, guess, guess_fits in zip(*(part[c].tolist() for c in ("session", *_STEP._fields)), strict=True):
                came.setdefault(plain(session), []).append(_STEP(seq, plain(species), percent, fine, observed, plain(guess), guess_fits))
        wake, sessions = self._get()
        due = None if self.idle_ms is None else timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
        answers, grown, moved = [], [], False
        for session, steps in came.items():
            old = sessions.get(session)
            before = old
            # a session has at most as many steps as its schedule, and their repeats
            for step in sorted(steps, key=lambda r: (r.seq == NO_SEQ, r.seq, r.percent == NO_PERCENT, r.percent)):
                reason = refusal(step, old)
                grown.append(("", None))
                if reason is None:
                    bases = old["bases"] if old else 0
                    grown[-1] = step.observed[bases:], old["guess"] if old else None
                    own = digest(step.observed)
                    old = {"species": step.species, "percent": step.percent, "fine": step.fine, "bases": len(step.observed), "sha256": own, "chain": digest((old["chain"] if old else "") + own),
                           "guess": step.guess, "guess_fits": step.guess_fits, "seq": step.seq, "due": due}
                answers.append((session, step.seq, step.percent, reason, old["bases"] if old else 0, old["chain"] if old else ""))
            if old is not before:
                sessions[session], moved = old, True
        if moved:
            self._put(wake, sessions)
        yield from _frames([(*a, *like) for a, like in zip(answers, likenesses(grown), strict=True)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        _, sessions = self._get()
        late = [k for k, s in sessions.items() if s["due"] is not None and s["due"] <= expiredTimerInfo.getExpiryTimeInMs()]
        gone = [(k, sessions.pop(k)) for k in late]
        # the timer that called is gone
        self._put(None, sessions)
        yield from _frames([(k, s["seq"], s["percent"], "session_given_up", s["bases"], s["chain"], -1.0, 0.0) for k, s in gone])

    def close(self) -> None:
        pass


def _frames(answers: list[tuple]) -> Iterator[pd.DataFrame]:
    """Rows of ANSWERS as one frame; none for no rows."""
    if answers:
        yield pd.DataFrame({n: pd.Series(c, dtype=object) for n, c in zip(_ANSWERS, zip(*answers, strict=True), strict=True)})


def answered(steps: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """2.12 session schedule: a stream (or table) of STEPS -> ANSWERS; reason is null for accepted steps, and only those move the state.

    Null sequences count as empty and a null schedule as the coarse one. Steps of a session are taken by seq within a
    micro-batch, and in the order of micro-batches.
    """
    observed = F.coalesce("observed", F.lit(""))
    plain = steps.select(group_of(F.col("session")).alias("group"), "session", F.coalesce("seq", F.lit(NO_SEQ)).alias("seq"), "species", F.coalesce("percent", F.lit(NO_PERCENT)).alias("percent"), F.coalesce("fine", F.lit(False)).alias("fine"), observed.alias("observed"),
        # only the tail of what was predicted is asked for again, so no more is shuffled
        F.substring("completed", F.length(observed) + 1, F.length("completed")).alias("guess"), F.coalesce(F.startswith("completed", observed), F.lit(True)).alias("guess_fits"))
    told = plain.groupBy("group").transformWithStateInPandas(Schedule(idle_ms), ANSWERS, "Append", "None" if idle_ms is None else "ProcessingTime")
    null = lambda c, value: F.nullif(F.col(c), F.lit(value)).alias(c)
    return told.select("session", null("seq", NO_SEQ), null("percent", NO_PERCENT), *_ANSWERS[3:])
