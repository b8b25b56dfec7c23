"""Stateful streams over tables that are dealt out in drops, with a restart in the middle; SQL replays or batches the same."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from susceptra.plans import bridge as B
from susceptra.plans.bridge import table
from susceptra.plans.catalogue import FINITE, finite, query
from susceptra.storage import materialise, shared_dir
from susceptra.streaming import jobs, merging, sessions
from susceptra.streaming.runs import file_stream, take_available
from susceptra.streaming.windows import tumbling_counts

LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"
GRIDS = "CASE WHEN {fine} THEN [20, 30, 40, 50, 60, 70, 80, 90, 95, 98, 100] ELSE [20, 30, 40, 50, 60, 70, 80, 90, 100] END"


def place(spark) -> str:
    return f"{shared_dir(spark)}/susceptra/stream-{uuid.uuid4().hex}"


def dna(text: Column) -> Column:
    """The letters of a text as bases: long sequences that every engine derives alike."""
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), LETTERS, BASES)


DNA_SQL = f"translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{LETTERS}', '{BASES}')"


def file_count(spark) -> int:
    """Files of a delivery, an even number: each is written by one task, so that as many as there are cores keep all busy."""
    return max(4, spark.sparkContext.defaultParallelism // 2 * 2)


def drop(rows: DataFrame, path: str, key: str, files: int = 4) -> None:
    """One more delivery: files that each hold all of a key's rows."""
    rows.repartition(files, key).write.mode("append").parquet(path)


def session_steps(docs: DataFrame) -> DataFrame:
    """Two tries at each step of every document's session (doc_id, dna); many of the first ones are wrong in one of seven ways."""
    fine = F.col("doc_id") % 2 == 1
    ints = lambda xs: F.array(*map(F.lit, xs))
    tries = docs.withColumn("grid", F.when(fine, ints((*range(20, 100, 10), 95, 98, 100))).otherwise(ints((*range(20, 100, 10), 100))))
    tries = tries.select("*", F.posexplode("grid").alias("j", "p")).withColumn("t", F.explode(ints((0, 1)))).withColumn("k", F.when(F.col("t") == 0, (F.col("doc_id") * 7 + F.col("j") * 3) % 11))
    before = F.col("grid")[F.greatest(F.col("j") - 1, F.lit(0))]
    share = lambda p: F.substring("dna", F.lit(1), F.expr(f"CAST(length(dna) * {p} DIV 100 AS INT)"))
    tries = tries.withColumn("before", before).withColumn("part", F.when(F.col("k") == 5, share("before")).otherwise(share("p")))
    k = F.col("k")
    observed = F.when(k == 2, F.concat(F.lit("N"), F.substring("part", F.lit(2), F.length("part")))).otherwise(F.col("part"))
    rest = F.expr("substring(dna, length(part) + 1, length(dna))")
    completed = F.when(F.col("doc_id") % 3 == 1, F.when((k == 6) & (F.col("doc_id") % 5 == 0), F.concat(F.lit("N"), "dna")).otherwise(F.col("dna"))).when(F.col("doc_id") % 3 == 2, F.concat("part", F.reverse(rest)))
    return tries.select(
        F.col("doc_id").cast("string").alias("session"), (2 * F.col("j") + F.col("t")).cast("long").alias("seq"), F.when(k == 1, "y").otherwise("x").alias("species"),
        F.when(k == 0, F.col("p") + 5).when(k == 3, F.col("before")).otherwise(F.col("p")).cast("int").alias("percent"), F.when(k == 4, ~fine).otherwise(fine).alias("fine"), observed.alias("observed"), completed.alias("completed"))


_STEPS_SQL = f"""docs AS (SELECT doc_id, {DNA_SQL} AS dna, doc_id % 2 = 1 AS odd FROM documents WHERE text IS NOT NULL),
g AS (SELECT *, {GRIDS.format(fine='odd')} AS grid FROM docs),
tries AS (SELECT *, grid[j + 1] AS p, grid[greatest(j - 1, 0) + 1] AS before, CASE WHEN t = 0 THEN (doc_id * 7 + j * 3) % 11 ELSE -1 END AS k FROM (SELECT *, unnest(range(len(grid))) AS j FROM g), (SELECT unnest([0, 1]) AS t)),
parts AS (SELECT *, substr(dna, 1, CAST(length(dna) * (CASE WHEN k = 5 THEN before ELSE p END) // 100 AS INTEGER)) AS part FROM tries),
steps AS (SELECT doc_id, CAST(2 * j + t AS BIGINT) AS seq, CASE WHEN k = 1 THEN 'y' ELSE 'x' END AS species, CASE k WHEN 0 THEN p + 5 WHEN 3 THEN before ELSE p END AS percent, CASE WHEN k = 4 THEN NOT odd ELSE odd END AS fine,
  CASE WHEN k = 2 THEN 'N' || substr(part, 2) ELSE part END AS observed,
  CASE doc_id % 3 WHEN 1 THEN CASE WHEN k = 6 AND doc_id % 5 = 0 THEN 'N' || dna ELSE dna END WHEN 2 THEN part || reverse(substr(dna, length(part) + 1)) END AS completed FROM parts)"""

#: A session's last accepted step goes from step to step; the first of the checks that fails names the reason.
_REPLAY_SQL = f"""WITH RECURSIVE {_STEPS_SQL},
r AS (
  SELECT doc_id, CAST(-1 AS BIGINT) AS seq, 0 AS percent, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS VARCHAR) AS species, CAST(NULL AS BOOLEAN) AS fine, CAST(NULL AS INTEGER) AS last, '' AS seen, CAST(NULL AS VARCHAR) AS guess, '' AS chain, 0::DOUBLE AS ratio FROM docs
  UNION ALL
  SELECT doc_id, seq, percent, reason, CASE WHEN reason IS NULL THEN own_species ELSE species END, CASE WHEN reason IS NULL THEN own_fine ELSE fine END, CASE WHEN reason IS NULL THEN percent ELSE last END,
    CASE WHEN reason IS NULL THEN observed ELSE seen END, CASE WHEN reason IS NULL THEN completed ELSE guess END, CASE WHEN reason IS NULL THEN sha256(chain || sha256(observed)) ELSE chain END,
    CASE WHEN reason IS NULL AND last IS NOT NULL AND guess IS NOT NULL THEN least(length(guess) - length(seen), length(observed) - length(seen))::DOUBLE / (length(observed) - length(seen)) ELSE 0 END
  FROM (SELECT r.doc_id, s.seq, CAST(s.percent AS INTEGER) AS percent, s.species AS own_species, s.fine AS own_fine, s.observed, s.completed, r.species, r.fine, r.last, r.seen, r.guess, r.chain, CASE
      WHEN NOT list_contains({GRIDS.format(fine='s.fine')}, s.percent) THEN 'percentage_not_scheduled'
      WHEN r.last IS NULL AND s.percent NOT IN (20, 100) THEN 'session_starts_elsewhere' WHEN r.last IS NULL THEN NULL
      WHEN r.species <> s.species THEN 'species_changed' WHEN r.fine <> s.fine THEN 'schedule_changed'
      WHEN NOT starts_with(s.observed, r.seen) THEN 'prefix_changed'
      WHEN r.last = 100 OR s.percent <> list_min(list_filter({GRIDS.format(fine='s.fine')}, lambda x: x > r.last)) THEN 'not_the_next_step'
      WHEN length(s.observed) = length(r.seen) THEN 'no_more_sequence'
      WHEN r.guess IS NOT NULL AND NOT starts_with(r.guess, r.seen) THEN 'prediction_changed' END AS reason
    FROM r JOIN steps s ON s.doc_id = r.doc_id AND s.seq = r.seq + 1))
SELECT CAST(doc_id AS VARCHAR) AS session, seq, percent, reason, CAST(length(seen) AS BIGINT) AS bases, chain, floor(ratio * 1e6 + 0.5) / 1e6 AS ratio FROM r WHERE seq >= 0"""


@query(_REPLAY_SQL)
def stream_session(spark, d):
    """2.12 session schedule, DQ10, ML12: three drops in micro-batches of half a drop's files; the stream is ended and started again before the third."""
    root, files = place(spark), file_count(spark)
    docs = materialise(table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", dna(F.col("text")).alias("dna")), "dna")
    # sequences are dealt out before they become steps, which are many times as long: a file has all steps of its groups of
    # sessions, so that a micro-batch of half the files meets half the groups
    steps = session_steps(docs.repartition(files, sessions.group_of(F.col("doc_id").cast("string"))))
    # a session's steps repeat each other, farther apart than snappy looks back
    send = lambda part: steps.filter(part).write.mode("append").option("compression", "zstd").parquet(f"{root}/in")
    run = lambda: take_available(sessions.answered(file_stream(spark, f"{root}/in", sessions.STEPS, files // 2)), f"{root}/checkpoint", f"{root}/out")
    send("seq < 6")
    send("seq BETWEEN 6 AND 11")
    run()
    send("seq > 11")
    run()
    out = spark.read.schema(sessions.ANSWERS).parquet(f"{root}/out")
    return out.select("session", "seq", "percent", "reason", "bases", "chain", (F.floor(F.col("ratio") * 1e6 + 0.5) / 1e6).alias("ratio"))


_LATE_SQL = B.READINGS_SQL.replace("FROM audited WHERE reason IS NULL", "FROM audited WHERE reason IS NULL AND rec_id % 13 <> 0").replace("SELECT genome_id, drug, day, count(*)", "SELECT genome_id, drug, count(*)").replace("SELECT genome_id, drug, day, CASE WHEN low", "SELECT genome_id, drug, CASE WHEN low")


@query(f"WITH {_LATE_SQL} SELECT genome_id, drug, lower AS mic_lower, {FINITE} AS mic_upper, sir, n, reason FROM resolved")
def stream_dedup_state(spark, d):
    """2.12 late merging, AG1, AG2, SK6: readings out of order, some twice, every thirteenth taken back, partly before it comes."""
    root, files, keys = place(spark), file_count(spark), ["genome_id", "drug"]
    rows = B.intervals(spark, d).select(*keys, F.col("ord").alias("at"), "lower", "upper", "sir", "raw", F.lit(False).alias("retracted"))
    rows = materialise(rows, "readings")
    back = rows.filter("at % 13 = 0").withColumn("retracted", F.lit(True))
    schema = rows.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")
    run = lambda: merging.follow(file_stream(spark, f"{root}/in", schema, files), keys, f"{root}/table", f"{root}/checkpoint")
    drop(rows.filter("at * 7 % 3 = 2").unionByName(back.filter("at % 2 = 0")), f"{root}/in", "genome_id", files)
    drop(rows.filter("at * 7 % 3 = 0 OR at % 5 = 0"), f"{root}/in", "at", files)
    run()
    drop(rows.filter("at * 7 % 3 = 1").unionByName(back), f"{root}/in", "at", files)
    run()
    return merging.labels(spark, f"{root}/table").select(*keys, F.col("lower").alias("mic_lower"), finite("upper").alias("mic_upper"), "sir", "n", "reason")


@query(f"""WITH o AS (SELECT *, o_orderkey % 10 = 3 AS earlier, o_orderkey % 7 > 0 AS runs, o_orderstatus <> 'O' AS ends, o_orderkey % 5 = 0 AS fails FROM orders),
j AS (SELECT 'j' || o_orderkey AS job_id, CASE WHEN ends AND fails THEN 'failed' WHEN ends THEN 'done' WHEN earlier AND o_orderkey % 3 = 2 AND NOT runs THEN 'done' WHEN earlier AND NOT runs THEN 'failed' WHEN runs THEN 'running' ELSE 'queued' END AS status, o_orderpriority AS sample_id,
  CASE WHEN ends AND fails THEN 'FAKE error' WHEN ends OR runs THEN NULL WHEN earlier AND o_orderkey % 3 < 2 THEN '{jobs.INTERRUPTED}' END AS error,
  CAST(CASE WHEN earlier AND o_orderkey % 3 < 2 THEN 2 + (o_orderkey % 3) ELSE CASE WHEN earlier THEN 3 ELSE 1 END END + CASE WHEN runs THEN 1 ELSE 0 END + CASE WHEN ends THEN 1 ELSE 0 END AS BIGINT) AS step FROM o)
SELECT * FROM j UNION ALL SELECT 'unknown ' || o_orderkey, 'refused', NULL, 'unknown_job', NULL FROM o WHERE o_orderkey % 97 = 0""")
def stream_jobs(spark, d):
    """2.12 job lifecycle, SO3's table: orders as jobs. A tenth comes from an earlier run, whose unfinished jobs fail at the restart."""
    root, files = place(spark), file_count(spark)
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("j"), F.col("o_orderkey").cast("string")).alias("job_id"), F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_orderpriority").alias("sample"), (F.col("o_orderkey") % 10 == 3).alias("earlier"), (F.col("o_orderkey") % 7 > 0).alias("runs"), (F.col("o_orderstatus") != "O").alias("ends"), (F.col("o_orderkey") % 5 == 0).alias("fails"))
    step = F.col("o_orderkey") % 3
    null = F.lit(None).cast("string")
    earlier = materialise(o.filter("earlier").select("job_id", (step + 1).alias("step"), "at", F.element_at(F.array(F.lit("queued"), F.lit("running"), F.lit("done")), (step + 1).cast("int")).alias("status"), F.col("sample").alias("sample_id"), null.alias("error"), null.alias("report"), F.col("at").alias("created_at")), "jobs")
    event = lambda rows, hours, kind, sample, payload, job="job_id": rows.select(F.expr(job).alias("job_id"), (F.col("at") + F.expr(f"INTERVAL {hours} HOURS")).alias("at"), F.lit(kind).alias("kind"), sample.alias("sample_id"), payload.alias("payload"))
    made = event(o.filter("NOT earlier"), 0, "create", F.col("sample"), null)
    run_ = event(o.filter("runs"), 1, "run", null, null).unionByName(event(o.filter("o_orderkey % 97 = 0"), 1, "run", null, null, "'unknown ' || o_orderkey"))
    ended = event(o.filter("ends AND fails"), 2, "fail", null, F.lit("FAKE error")).unionByName(event(o.filter("ends AND NOT fails"), 2, "finish", null, F.lit("{}")))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    run = lambda: take_available(jobs.changes(file_stream(spark, f"{root}/in", jobs.EVENTS, files), earlier), f"{root}/checkpoint", mode="update", each=keep)
    drop(made, f"{root}/in", "job_id", files)
    drop(run_, f"{root}/in", "job_id", files)
    run()
    drop(ended, f"{root}/in", "job_id", files)
    run()
    out = spark.read.schema(jobs.CHANGES).parquet(f"{root}/out").drop("batch")
    refused = out.filter("step IS NULL").select("job_id", F.lit("refused").alias("status"), "sample_id", "error", "step")
    return jobs.job_table(earlier.select(out.columns).unionByName(out)).select("job_id", "status", "sample_id", "error", "step").unionByName(refused)


_HASHED_SQL = f"""t AS (SELECT doc_id, {DNA_SQL} AS s FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, substr(s, i, 19) AS f, reverse(translate(substr(s, i, 19), 'ACGT', 'TGCA')) AS r FROM (SELECT doc_id, s, unnest(range(1, length(s) - 17)) AS i FROM t WHERE length(s) >= 19)),
c AS (SELECT DISTINCT doc_id, least(f, r) AS m FROM w),
p AS (SELECT doc_id, CAST({' + '.join(f"((instr('ACGT', substr(m, {j + 1}, 1)) - 1)::BIGINT << {2 * (18 - j)})" for j in range(19))} AS UHUGEINT) AS h0 FROM c),
h1 AS (SELECT doc_id, xor(h0, h0 >> 30) * 13787848793156543929::UHUGEINT % 18446744073709551616::UHUGEINT AS h FROM p),
h2 AS (SELECT doc_id, xor(h, h >> 27) * 10723151780598845931::UHUGEINT % 18446744073709551616::UHUGEINT AS h FROM h1),
h3 AS (SELECT doc_id, xor(h, h >> 31) AS h FROM h2)"""


@query(f"WITH {_HASHED_SQL} SELECT doc_id, CAST(CASE WHEN h >= 9223372036854775808::UHUGEINT THEN CAST(h AS HUGEINT) - 18446744073709551616::HUGEINT ELSE h END AS BIGINT) AS hash FROM h3 WHERE h % 2048 = 0")
def kmer_sketch_u64(spark, d):
    """ML8: canonical 19-mers of every document's sequence, two bits a base."""
    from susceptra.operators.sketch import sketch

    return sketch(table(spark, d, "documents").select("doc_id", dna(F.col("text")).alias("seq")), "doc_id", "seq")


@query("SELECT event_type, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    """2.12 append-only drops with resume: hourly counts of events that arrive in two drops in the order of time, each taken by a run
    that goes on from the checkpoint; two marks far behind them, a run each, close the last windows."""
    root = place(spark)
    events = table(spark, d, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    middle, last = events.agg(F.expr("percentile_approx(ts, 0.5)"), F.max("ts")).first()
    drops = [events.filter(F.col("ts") <= F.lit(middle)), events.filter(F.col("ts") > F.lit(middle))]
    drops += [spark.range(1).select(F.lit("mark").alias("event_type"), (F.lit(last) + F.make_dt_interval(F.lit(days))).alias("ts")) for days in (1, 2)]
    for rows in drops:
        rows.write.mode("append").parquet(f"{root}/in")
        # all files of a drop in one micro-batch: within it no event is late
        stream = file_stream(spark, f"{root}/in", "event_type string, ts timestamp", 1_000_000)
        take_available(tumbling_counts(stream, "event_type", "ts"), f"{root}/checkpoint", f"{root}/out")
    return spark.read.schema("event_type string, start timestamp_ntz, n long").parquet(f"{root}/out").filter("event_type <> 'mark'")
