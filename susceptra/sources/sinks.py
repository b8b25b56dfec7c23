"""Sinks beside Spark's own writers: summaries, small JSON artifacts, immutable releases with checksums, upserts."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from susceptra.operators.relational import first_in_group

#: An artifact is read by people and small programs; a larger table belongs into Parquet.
MOST_ROWS = 100_000


def write_summary(df: DataFrame, path: str, sep: str = ",") -> None:
    """SK2: delimited text with a header. Never overwrites."""
    df.write.option("header", True).option("sep", sep).mode("errorifexists").csv(path)


def write_json(value: object, path: str) -> None:
    """SK3, SK5: JSON on the driver's disk, whole or not at all: a new file beside it takes its name in one step."""
    fd, part = tempfile.mkstemp(dir=os.path.dirname(path) or ".", prefix=".part-")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            json.dump(value, f, indent=2, sort_keys=True)
            f.flush()
            os.fsync(f.fileno())
        os.replace(part, path)
    except BaseException:
        os.unlink(part)
        raise


def write_artifact(df: DataFrame, path: str, most: int = MOST_ROWS) -> None:
    """SK3: a small table as a JSON list of records; more rows than `most` raise, and nothing is written."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no artifact")
    write_json([r.asDict(recursive=True) for r in rows], path)


def write_stage(df: DataFrame, path: str, rows_per_file: int | None = None) -> DataFrame:
    """SK1: a stage's table as Parquet, never over an existing one -> the table as the next stage reads it."""
    writer = df.write.mode("errorifexists")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(tables: dict[str, DataFrame], root: str, version: str, pilot: bool = False) -> DataFrame:
    """SK7: the tables as Parquet under root/version, never over an existing one -> (name, n, checksum), also stored there.

    The checksum is over all rows in any order, so a reader can verify it at any partitioning. A pilot's results are
    refused. The version is named in root/releases once all of it is written; `latest` reads it there.
    """
    if pilot:
        raise ValueError("pilot results are never released")
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/{version}/{name}")
    spark = next(iter(tables.values())).sparkSession
    sums = checksums(spark, root, version, list(tables))
    sums.write.mode("errorifexists").parquet(f"{root}/{version}/_checksums")
    number = max((r.number for r in _rows(spark, f"{root}/releases", RELEASE)), default=0) + 1
    spark.createDataFrame([(number, version)], RELEASE).coalesce(1).write.mode("append").parquet(f"{root}/releases")
    return spark.read.parquet(f"{root}/{version}/_checksums")


RELEASE = "number long, version string"


def latest(spark: SparkSession, root: str) -> str | None:
    """The version released last, or None before the first."""
    last = max(_rows(spark, f"{root}/releases", RELEASE), key=lambda r: r.number, default=None)
    return None if last is None else last.version


def pull(spark: SparkSession, root: str, version: str | None = None) -> dict[str, DataFrame]:
    """SK7: the tables of a version (the latest by default), verified first; raises where one is not what was released."""
    version = version or latest(spark, root)
    if version is None:
        raise ValueError("nothing was released")
    if bad := [r.name for r in verify_release(spark, root, version).collect()]:
        raise ValueError(f"checksum differs: {', '.join(sorted(bad))}")
    names = [r.name for r in spark.read.parquet(f"{root}/{version}/_checksums").select("name").collect()]
    return {n: spark.read.parquet(f"{root}/{version}/{n}") for n in names}


def checksums(spark: SparkSession, root: str, version: str, names: list[str]) -> DataFrame:
    parts = []
    for name in names:
        df = spark.read.parquet(f"{root}/{version}/{name}")
        row = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}))
        parts.append(df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row.cast("decimal(20,0)")), F.lit(0)).cast("string").alias("checksum")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def verify_release(spark: SparkSession, root: str, version: str) -> DataFrame:
    """SK7: (name, reason) of tables that are not what was released; no rows where all are."""
    kept = spark.read.parquet(f"{root}/{version}/_checksums")
    now = checksums(spark, root, version, [r.name for r in kept.select("name").collect()]).select("name", F.col("n").alias("n_now"), F.col("checksum").alias("sum_now"))
    return kept.join(now, "name").filter("n <> n_now or checksum <> sum_now").select("name", F.lit("checksum_differs").alias("reason"))


def upsert(spark: SparkSession, path: str, changes: DataFrame, keys: list[str], at: str, token: str | None = None) -> str:
    """SK6: changes over the table at path, the row of the greatest `at` of each key -> the folder of the new state.

    States are folders of their own, and a row appended to path/commits makes one the current: nothing is ever overwritten
    or deleted, so a crash anywhere leaves the state before. A token that was committed already changes nothing, which
    makes a repeated micro-batch harmless. Two writers at once each commit a whole state; the later one's is current.
    """
    commits = _commits(spark, path)
    if token is not None and (done := [c for c in commits if c.token == token]):
        return f"{path}/{done[0].name}"
    old = current(spark, path)
    both = changes if old is None else old.unionByName(changes)
    number = max((c.number for c in commits), default=0) + 1
    name = f"state-{number:09d}-{uuid.uuid4().hex}"
    first_in_group(both, keys, F.col(at).desc(), F.xxhash64(*[F.col(f"`{c}`") for c in both.columns])).write.parquet(f"{path}/{name}")
    spark.createDataFrame([(number, name, token)], COMMIT).coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return f"{path}/{name}"


COMMIT = "number long, name string, token string"


def _commits(spark: SparkSession, path: str) -> list:
    return _rows(spark, f"{path}/commits", COMMIT)


def _rows(spark: SparkSession, path: str, schema: str) -> list:
    """All of a log's rows, one short row a commit or release; none where there is no log yet."""
    try:
        return spark.read.schema(schema).parquet(path).collect()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return []
        raise


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The state committed last, or None before the first."""
    last = max(_commits(spark, path), key=lambda c: (c.number, c.name), default=None)
    return None if last is None else spark.read.parquet(f"{path}/{last.name}")
