"""The life of jobs as a stream: queued, running, then done or failed; what a restart interrupts has failed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

EVENTS = "job_id string, at timestamp, kind string, sample_id string, payload string"
#: A change of a job, numbered by step; or a refused event (step and status null, error says why).
CHANGES = "job_id string, step long, at timestamp, status string, sample_id string, error string, report string, created_at timestamp"
#: Jobs are dealt into so many groups by their ids. A group's jobs are one value of the state: a micro-batch asks for it once
#: for each group, not once for each job. The number is part of a checkpoint.
BUCKETS = 4096
#: When the group's timer is due, and its jobs, as an Arrow stream of _JOBS.
STATE = "wake long, jobs binary"
#: CHANGES with times in microseconds, as the processor takes and gives them; NO_TIME stands for null.
_TOLD = CHANGES.replace("timestamp", "long")
_EARLIER = ["job_id", "step", "status", "sample_id", "error", "report", "created_at"]
NO_TIME = -(1 << 63)
# The states and the text of an interruption.
QUEUED, RUNNING, DONE, FAILED = "queued", "running", "done", "failed"
INTERRUPTED = "Interrupted by an API restart before it finished. Upload the genome again."
TIMED_OUT = "No event before the job's deadline."
_ORDER = {"create": 0, "run": 1}
_AFTER = {"run": RUNNING, "finish": DONE, "fail": FAILED}


#: A job; told: whether its state was given out; due: the milliseconds at which a timer tells it or lets it fail.
_JOBS = pa.schema([("job_id", pa.string()), ("step", pa.int64()), ("status", pa.string()), ("sample_id", pa.string()), ("error", pa.string()), ("report", pa.string()), ("created_at", pa.int64()), ("told", pa.bool_()), ("due", pa.int64())])


def _packed(jobs: dict[str | None, tuple]) -> bytes:
    columns = zip(*((k, *j) for k, j in jobs.items()), strict=True)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, _JOBS) as writer:
        writer.write_batch(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _JOBS.types, strict=True)], schema=_JOBS))
    return out.getvalue().to_pybytes()


def _unpacked(held: bytes) -> dict[str | None, tuple]:
    rows = zip(*(c.to_pylist() for c in pa.ipc.open_stream(held).read_all().columns), strict=True)
    return {r[0]: r[1:] for r in rows}


class Lifecycle(StatefulProcessor):
    """One value a group of jobs. Jobs of an earlier run come as initial state; the unfinished ones have failed, and a timer
    that is due at once tells so, unless an event of the job comes first.

    With deadline_ms, a job that stays unfinished for so long without an event fails as well. A group has one timer, for the
    first of its jobs that is due.
    """

    def __init__(self, deadline_ms: int | None = None):
        self.deadline_ms = deadline_ms

    def init(self, handle) -> None:
        self.handle, self.group = handle, handle.getValueState("group", STATE)

    def _get(self) -> tuple[int | None, dict[str | None, tuple]]:
        held = self.group.get()
        return (None, {}) if held is None else (held[0], _unpacked(held[1]))

    def _put(self, wake: int | None, jobs: dict[str | None, tuple]) -> None:
        """Keep the jobs, with the timer at the first that is due; wake is when it was due so far."""
        first = min((j[7] for j in jobs.values() if j[7] is not None), default=None)
        if first != wake:
            if wake is not None:
                self.handle.deleteTimer(wake)
            if first is not None:
                self.handle.registerTimer(first)
        self.group.update((first, _packed(jobs)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        wake, jobs = self._get()
        now, changes = timerValues.getCurrentProcessingTimeInMs(), []
        events: dict[str | None, list[tuple]] = {}
        for part in rows:
            for job_id, *event in zip(*(part[c].tolist() for c in ("job_id", "at", "kind", "sample_id", "payload")), strict=True):
                events.setdefault(job_id, []).append(event)
        for job_id, own in events.items():
            job = jobs.get(job_id)
            if job and not job[6]:
                job = (*job[:6], True, None)
                changes.append((job_id, now * 1000, *job[:6]))
            # creation before anything else, and an end after it, at equal times
            for at, kind, sample_id, payload in sorted(own, key=lambda e: (e[0], _ORDER.get(e[1], 2), e[1])) if len(own) > 1 else own:
                known = job is not None
                refused = ("job_exists" if known else None) if kind == "create" else "unknown_job" if not known else None if kind in _AFTER else "unknown_event"
                if refused:
                    changes.append((job_id, at, None, None, None, refused, None, NO_TIME))
                    continue
                if kind == "create":
                    job = (1, QUEUED, sample_id, None, None, at, True, None)
                else:
                    status = _AFTER[kind]
                    job = (job[0] + 1, status, job[2], payload if status == FAILED else None, payload if status == DONE else job[4], job[5], True, None)
                changes.append((job_id, at, *job[:6]))
            if job:
                late = self.deadline_ms is not None and job[1] in (QUEUED, RUNNING)
                jobs[job_id] = (*job[:7], now + self.deadline_ms if late else None)
        if jobs:
            self._put(wake, jobs)
        yield from _frames(changes)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        wake, jobs = self._get()
        now = timerValues.getCurrentProcessingTimeInMs()
        for job_id, step, status, sample_id, error, report, created_at in zip(*(initialState[c].tolist() for c in _EARLIER), strict=True):
            unfinished = status in (QUEUED, RUNNING)
            status, error = (FAILED, INTERRUPTED) if unfinished else (status, error)
            jobs[job_id] = (step + unfinished, status, sample_id, error, report, created_at, not unfinished, now if unfinished else None)
        self._put(wake, jobs)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        _, jobs = self._get()
        now, changes = timerValues.getCurrentProcessingTimeInMs(), []
        for job_id, (step, status, sample_id, error, report, created_at, told, due) in jobs.items():
            if due is None or due > expiredTimerInfo.getExpiryTimeInMs():
                continue
            if told:
                step, status, error = step + 1, FAILED, TIMED_OUT
            jobs[job_id] = (step, status, sample_id, error, report, created_at, True, None)
            changes.append((job_id, now * 1000, *jobs[job_id][:6]))
        # the timer that called is gone
        self._put(None, jobs)
        yield from _frames(changes)

    def close(self) -> None:
        pass


def _frames(changes: list[tuple]) -> Iterator[pd.DataFrame]:
    """Rows (job_id, at, step, status, ...) as one frame of _TOLD; none for no rows."""
    if changes:
        yield pd.DataFrame({n: pd.Series(c, dtype=object) for n, c in zip(("job_id", "at", *_EARLIER[1:]), zip(*changes, strict=True), strict=True)})[[c.split()[0] for c in _TOLD.split(", ")]]


def changes(events: DataFrame, earlier: DataFrame | None = None, deadline_ms: int | None = None) -> DataFrame:
    """2.12 job lifecycle: a stream of EVENTS (kind create, run, finish or fail) -> CHANGES.

    run, finish and fail overwrite whatever status a known job has; an event of an unknown job changes nothing and gives a
    row that says so, as does a second create. `earlier` is the job table of the run before (CHANGES, one row a job): its
    unfinished jobs fail as interrupted in the first micro-batch. Jobs of the same checkpoint live on through a restart.
    """
    group = F.pmod(F.xxhash64("job_id"), F.lit(BUCKETS)).alias("group")
    micros = lambda c: F.coalesce(F.unix_micros(c), F.lit(NO_TIME)).alias(c)
    start = None if earlier is None else earlier.select(group, *_EARLIER[:-1], micros("created_at")).groupBy("group")
    rows = events.select(group, "job_id", micros("at"), "kind", "sample_id", "payload").groupBy("group")
    told = rows.transformWithStateInPandas(Lifecycle(deadline_ms), _TOLD, "Update", "ProcessingTime", initialState=start)
    time = lambda c: F.timestamp_micros(F.nullif(F.col(c), F.lit(NO_TIME))).alias(c)
    return told.select("job_id", "step", time("at"), "status", "sample_id", "error", "report", time("created_at"))


def job_table(changes: DataFrame) -> DataFrame:
    """The last change of each job; refused events are none."""
    columns = [c for c in changes.columns if c != "job_id"]
    return changes.filter("step IS NOT NULL").groupBy("job_id").agg(*[F.max_by(c, "step").alias(c) for c in columns])
