"""Stateful streams over several micro-batches and a restart, against plain replays."""

import hashlib
import random

import pytest

from susceptra.operators.relational import resolve_duplicates
from susceptra.sources import sinks
from susceptra.streaming import jobs, merging, sessions
from susceptra.streaming.runs import file_stream, state_in_rocksdb, take_available


def packed_sketch(seq, k=19, bits=11):
    """Restated with Python integers: two bits a base, the smaller strand, splitmix64's finaliser."""
    mask, out = (1 << 64) - 1, set()
    for i in range(len(seq) - k + 1):
        w = seq[i : i + k]
        if set(w) <= set("ACGT"):
            number = lambda s: sum("ACGT".index(c) << 2 * (k - 1 - j) for j, c in enumerate(s))
            h = min(number(w), number(w[::-1].translate(str.maketrans("ACGT", "TGCA"))))
            h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & mask
            h = (h ^ h >> 27) * 0x94D049BB133111EB & mask
            h ^= h >> 31
            if h & (1 << bits) - 1 == 0:
                out.add(h)
    return out


@pytest.mark.parametrize(("k", "bits"), [(19, 4), (5, 2), (31, 3)])
def test_sketch_is_packed_in_two_bits(k, bits):
    from susceptra.operators.sketch import kmer_hashes

    seq = "".join(random.Random(k).choices("ACGTN", (9, 9, 9, 9, 1), k=3000))
    assert set(kmer_hashes(seq, k, bits).tolist()) == packed_sketch(seq, k, bits)


def replay(steps):
    """A session's steps in order, by plain Python on whole sequences."""
    grids = {False: [20, 30, 40, 50, 60, 70, 80, 90, 100], True: [20, 30, 40, 50, 60, 70, 80, 90, 95, 98, 100]}
    last, chain, out = None, "", []
    for session, seq, species, percent, fine, observed, completed in steps:
        grid = grids[bool(fine)]
        if percent not in grid:
            reason = "percentage_not_scheduled"
        elif last is None:
            reason = None if percent in (20, 100) else "session_starts_elsewhere"
        elif last[0] != species:
            reason = "species_changed"
        elif last[1] != bool(fine):
            reason = "schedule_changed"
        elif not observed.startswith(last[3]):
            reason = "prefix_changed"
        elif last[2] == 100 or percent != grid[grid.index(last[2]) + 1]:
            reason = "not_the_next_step"
        elif len(observed) == len(last[3]):
            reason = "no_more_sequence"
        elif last[4] is not None and last[4][: len(last[3])] != last[3]:
            reason = "prediction_changed"
        else:
            reason = None
        like = (-1.0, 0.0)
        if reason is None:
            if last and last[4] is not None:
                new = observed[len(last[3]) :]
                guess = last[4][len(last[3]) :][: len(new)]
                a, b = packed_sketch(new), packed_sketch(guess)
                like = (len(a & b) / max(1, len(a | b)), len(guess) / len(new))
            last = (species, bool(fine), percent, observed, completed)
            chain = hashlib.sha256((chain + hashlib.sha256(observed.encode()).hexdigest()).encode()).hexdigest()
        out.append((session, seq, percent, reason, len(last[3]) if last else 0, chain, *like))
    return out


def made_sessions(n):
    rng, rows = random.Random(3), []
    for i in range(n):
        dna = "".join(rng.choices("ACGT", k=rng.choice((0, 60, 9000))))
        for seq, percent in enumerate([20, 20, 30, 40, 40, 50, 60, 70, 70, 80, 90, 95, 98, 100, 100]):
            kind = rng.randrange(14)
            cut = dna[: len(dna) * percent // 100]
            observed = {0: cut[::-1], 1: cut[: len(cut) // 2]}.get(kind, cut)
            completed = (None, dna, "X" + dna if rng.random() < 0.1 else dna[: len(cut)] + dna[len(cut) :][::-1])[i % 3]
            rows.append((f"s{i}", seq, "y" if kind == 2 else "x", percent + (5 if kind == 3 else 0), i % 2 == 1 if kind != 4 else i % 2 == 0, observed, completed))
    return rows


def test_sessions_with_a_restart(spark, tmp_path):
    rows, place = made_sessions(12), f"file://{tmp_path}"
    put = lambda part: spark.createDataFrame([r for r in rows if part(r[1])], sessions.STEPS).repartition(2, "session").write.mode("append").parquet(f"{place}/in")
    run = lambda: take_available(sessions.answered(file_stream(spark, f"{place}/in", sessions.STEPS)), f"{place}/checkpoint", f"{place}/out")
    put(lambda seq: seq < 4)
    put(lambda seq: 4 <= seq < 9)
    run()
    put(lambda seq: seq >= 9)
    run()
    got = sorted(tuple(r) for r in spark.read.parquet(f"{place}/out").collect())
    want = sorted(x for i in range(12) for x in replay([r for r in rows if r[0] == f"s{i}"]))
    assert got == want
    assert {r[3] for r in want} >= {None, "prefix_changed", "species_changed", "not_the_next_step", "schedule_changed", "no_more_sequence"}


def test_idle_sessions_are_given_up(spark, tmp_path):
    place = f"file://{tmp_path}"
    run = lambda: take_available(sessions.answered(file_stream(spark, f"{place}/in", sessions.STEPS), idle_ms=1), f"{place}/checkpoint", f"{place}/out")
    for name, percent in (("a", 20), ("b", 20), ("a", 30)):
        spark.createDataFrame([(name, 1, "x", percent, None, "A" * percent, None)], sessions.STEPS).coalesce(1).write.mode("append").parquet(f"{place}/in")
        run()
    got = spark.read.parquet(f"{place}/out").collect()
    assert {(r.session, r.percent) for r in got if r.reason == "session_given_up"} >= {("a", 20)}
    assert [r.reason for r in got if r.session == "a" and r.percent == 30] == ["session_starts_elsewhere"]


def test_sessions_share_values_of_the_state(spark, tmp_path, monkeypatch):
    """Twelve sessions in three groups: as many values in the state as groups, and answers as if each were alone."""
    monkeypatch.setattr(sessions, "GROUPS", 3)
    rows, place = made_sessions(12), f"file://{tmp_path}"
    for half in (0, 1):
        part = [r for r in rows if (r[1] >= 7) == half]
        spark.createDataFrame(part, sessions.STEPS).repartition(2, "session").write.mode("append").parquet(f"{place}/in")
        take_available(sessions.answered(file_stream(spark, f"{place}/in", sessions.STEPS, 2)), f"{place}/checkpoint", f"{place}/out")
    got = sorted(tuple(r) for r in spark.read.parquet(f"{place}/out").collect())
    assert got == sorted(x for i in range(12) for x in replay([r for r in rows if r[0] == f"s{i}"]))
    with state_in_rocksdb(spark):
        assert 1 <= spark.read.format("statestore").option("stateVarName", "group").load(f"{place}/checkpoint").count() <= 3


def test_idle_sessions_of_one_group_are_given_up_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sessions, "GROUPS", 1)
    place = f"file://{tmp_path}"
    for name, percent in (("a", 20), ("b", 20), ("b", 30), ("a", 30)):
        spark.createDataFrame([(name, 1, "x", percent, None, "A" * percent, None)], sessions.STEPS).coalesce(1).write.mode("append").parquet(f"{place}/in")
        take_available(sessions.answered(file_stream(spark, f"{place}/in", sessions.STEPS), idle_ms=1), f"{place}/checkpoint", f"{place}/out")
    got = spark.read.parquet(f"{place}/out").collect()
    # a is given up while b goes on, and b after its next step
    assert sorted((r.session, r.percent) for r in got if r.reason == "session_given_up") == [("a", 20), ("b", 30)]
    assert [r.reason for r in got if r.session == "a" and r.percent == 30] == ["session_starts_elsewhere"]


def test_sketches_of_many_texts_are_those_of_each():
    from susceptra.operators.sketch import kmer_hashes, kmer_sets

    rng = random.Random(8)
    texts = ["".join(rng.choices("ACGTN\u00e9", (9, 9, 9, 9, 1, 1), k=rng.choice((0, 3, 18, 19, 20, 500, 40_000)))) for _ in range(60)]
    for k, bits in ((19, 2), (5, 0)):
        assert kmer_sets(texts, k, bits) == [set(kmer_hashes(t, k, bits).tolist()) for t in texts]
    assert kmer_sets([]) == []


READINGS = "genome_id string, drug string, at long, lower double, upper double, sir string, raw string, retracted boolean"


def test_late_readings_in_any_order(spark, tmp_path):
    rng, rows = random.Random(9), []
    for at in range(400):
        step = 2.0 ** rng.randrange(-2, 4)
        lower, upper, sign = rng.choice(((step / 2, step, "="), (0.0, step, "<="), (step, float("inf"), ">")))
        rows.append((f"g{at % 60}", "d", at, lower, upper, rng.choice(("S", "R", "I", None)), f"{sign}{step}", False))
    retracted = [(*r[:7], True) for r in rows if r[2] % 9 == 0 or r[0] == "g7"]
    sent = rows + retracted + rng.sample(rows, 120)
    rng.shuffle(sent)
    place = f"file://{tmp_path}"
    for part in range(4):
        spark.createDataFrame(sent[part::4], READINGS).coalesce(1).write.mode("append").parquet(f"{place}/in")
        if part % 2:
            merging.follow(file_stream(spark, f"{place}/in", READINGS), ["genome_id", "drug"], f"{place}/table", f"{place}/checkpoint")
    gone = {r[2] for r in retracted}
    batch = resolve_duplicates(spark.createDataFrame([r for r in rows if r[2] not in gone], READINGS).withColumnRenamed("at", "ord"), ["genome_id", "drug"])
    columns = ["genome_id", "drug", "lower", "upper", "sir", "raw", "n", "reason"]
    got = sorted(map(repr, merging.labels(spark, f"{place}/table").select(columns).collect()))
    assert got == sorted(map(repr, batch.select(columns).collect())) and len(got) == 59
    assert sinks.current(spark, f"{place}/table").count() == 60


def test_readings_of_a_group_are_few_values_of_the_state():
    """A frame of rows asks for a chunk of the state once and tells it once, however many readings and keys it has."""
    import pandas as pd

    held, calls = {}, []

    class Handle:
        def getMapState(self, *_):  # noqa: N802
            return self

        def getValue(self, key):  # noqa: N802
            calls.append(key)
            return held.get(key)

        def updateValue(self, key, value):  # noqa: N802
            calls.append(key)
            held[key] = value

        def iterator(self):
            return iter(held.items())

    merger = merging.Merger()
    merger.init(Handle())
    frame = pd.DataFrame({"key": [f"k{i % 100}" for i in range(2000)], "at": range(2000), "lower": 1.0, "upper": 2.0, "sir": None, "raw": "=2", "retracted": False})
    got = pd.concat(merger.handleInputRows((0,), iter([frame]), None))
    assert (len(got), set(got.n), set(got.raw)) == (100, {20}, {"=2"}) and len(calls) == 2 * merging.CHUNKS
    got = pd.concat(merger.handleInputRows((0,), iter([frame.head(1).assign(retracted=True)]), None))
    assert [(r.key, r.n) for r in got.itertuples()] == [("k0", 19)]


def test_upsert_survives_a_crash_and_a_repeat(spark, tmp_path):
    place = f"file://{tmp_path}/t"
    row = lambda *r: spark.createDataFrame([r], "id long, v long")
    assert sinks.current(spark, place) is None
    sinks.upsert(spark, place, row(1, 1), ["id"], "v", token="a")
    sinks.upsert(spark, place, row(1, 9), ["id"], "v", token="a")
    row(7, 7).write.parquet(f"{place}/state-999999999-dead")  # a writer died before its commit
    sinks.upsert(spark, place, row(2, 2), ["id"], "v", token="b")
    assert sorted(map(tuple, sinks.current(spark, place).collect())) == [(1, 1), (2, 2)]


def events(spark, *rows):
    return spark.createDataFrame(rows, "job_id string, at string, kind string, sample_id string, payload string").selectExpr("job_id", "CAST(at AS TIMESTAMP) AS at", "kind", "sample_id", "payload")


def ran(spark, place, frames, earlier=None, **more):
    """The changes after the frames came one after the other, the stream ending and starting anew in between."""
    for f in frames:
        f.coalesce(1).write.mode("append").parquet(f"{place}/in")
        parts: list = []
        stream = jobs.changes(file_stream(spark, f"{place}/in", jobs.EVENTS), earlier, **more)
        take_available(stream, f"{place}/checkpoint", mode="update", each=lambda batch, n: batch.write.mode("append").parquet(f"{place}/out"))
        del parts
    return spark.read.schema(jobs.CHANGES).parquet(f"{place}/out")


def test_job_transitions(spark, tmp_path):
    place = f"file://{tmp_path}"
    first = events(spark, ("a", "2020-01-01", "create", "A", None), ("a", "2020-01-02", "run", None, None), ("b", "2020-01-01", "create", "B", None), ("b", "2020-01-01", "fail", None, "broken"),
                   ("c", "2020-01-01", "create", "C", None), ("c", "2020-01-01", "create", "C2", None), ("x", "2020-01-01", "run", None, None), ("c", "2020-01-03", "pause", None, None))
    then = events(spark, ("a", "2020-01-03", "finish", None, "{}"), ("x", "2020-01-04", "finish", None, "{}"))
    got = ran(spark, place, [first, then])
    table = {r.job_id: r for r in jobs.job_table(got).collect()}
    assert {k: (r.status, r.sample_id, r.error, r.report, r.step) for k, r in table.items()} == {"a": ("done", "A", None, "{}", 3), "b": ("failed", "B", "broken", None, 2), "c": ("queued", "C", None, None, 1)}
    assert table["a"].created_at < table["a"]["at"]
    assert sorted(r.error for r in got.filter("step is null").collect()) == ["job_exists", "unknown_event", "unknown_job", "unknown_job"]

    again = f"{place}/again"
    earlier = jobs.job_table(got)
    after = ran(spark, again, [events(spark, ("d", "2020-02-01", "create", "D", None))], earlier)
    table = {r.job_id: (r.status, r.error) for r in jobs.job_table(after).collect()}
    assert table == {"c": ("failed", jobs.INTERRUPTED), "d": ("queued", None)}


def test_job_deadline(spark, tmp_path):
    got = ran(spark, f"file://{tmp_path}", [events(spark, (x, "2020-01-01", "create", "A", None)) for x in "ab"], deadline_ms=1)
    assert ("a", "failed", jobs.TIMED_OUT) in {(r.job_id, r.status, r.error) for r in jobs.job_table(got).collect()}


def test_a_group_of_jobs_is_one_value_of_the_state():
    """However many jobs of a group a micro-batch touches, the state is asked once and told once."""
    import pandas as pd

    calls = []

    class Handle:
        value = None

        def getValueState(self, *_):  # noqa: N802
            return self

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

        def registerTimer(self, _):  # noqa: N802
            calls.append("timer")

        def getCurrentProcessingTimeInMs(self):  # noqa: N802
            return 5

    handle, life = Handle(), jobs.Lifecycle(deadline_ms=10)
    life.init(handle)
    frame = lambda at, kind: pd.DataFrame({"job_id": [f"j{i}" for i in range(1000)], "at": at, "kind": kind, "sample_id": "s", "payload": None})
    made = pd.concat(life.handleInputRows((0,), iter([frame(1, "create")]), handle))
    ran_ = pd.concat(life.handleInputRows((0,), iter([frame(2, "run")]), handle))
    assert (len(made), set(made.status), len(ran_), set(ran_.status), set(ran_.step)) == (1000, {"queued"}, 1000, {"running"}, {2})
    assert calls == ["get", "timer", "update", "get", "update"]


def test_releases_are_named_last(spark, tmp_path):
    root = f"file://{tmp_path}/r"
    one = spark.createDataFrame([(1, "a")], "id int, s string")
    assert sinks.latest(spark, root) is None
    with pytest.raises(ValueError, match="pilot"):
        sinks.release({"t": one}, root, "v0", pilot=True)
    sinks.release({"t": one}, root, "v1")
    sinks.release({"t": one.unionByName(one), "u": one}, root, "v2")
    assert sinks.latest(spark, root) == "v2" and {k: v.count() for k, v in sinks.pull(spark, root).items()} == {"t": 2, "u": 1}
    assert sinks.pull(spark, root, "v1")["t"].count() == 1
    one.limit(0).write.mode("overwrite").parquet(f"{root}/v2/u")
    with pytest.raises(ValueError, match="u"):
        sinks.pull(spark, root)
    stage = sinks.write_stage(one, f"{root}/stage")
    assert stage.count() == 1
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_stage(one, f"{root}/stage")
