"""Readings that come late, twice, or are taken back, merged into one interval a key while they stream."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from susceptra.sources import sinks
from susceptra.streaming.runs import take_available

#: Keys are dealt into so many groups, a group's readings into so many values of the state. Both are part of a checkpoint.
GROUPS, CHUNKS = 1024, 16
MERGED = "lower double, upper double, sir string, raw string, n long, reason string"


class Readings:
    """AG1 and AG2 as a fold over readings in any order."""

    def __init__(self) -> None:
        self.n, self.low, self.high, self.best, self.sirs, self.raws = 0, -math.inf, math.inf, None, set(), {}

    def add(self, at: int, lower: float, upper: float, sir: str | None, raw: str | None) -> None:
        self.n += 1
        self.low, self.high = max(self.low, lower), min(self.high, upper)
        self.best = max(self.best or (-math.inf, -math.inf, 0), (lower, upper, -at))
        self.sirs.add(sir)
        if raw is not None:
            self.raws[raw] = min(at, self.raws.get(raw, at))

    def merged(self) -> tuple:
        """lower, upper, sir, raw, n, reason; nulls and n = 0 where no reading is left."""
        if not self.n:
            return None, None, None, None, 0, None
        meets = self.low < self.high
        apart = not meets and self.high > 0 and math.log2(self.low / self.high) + 1 > 1
        reason = None if self.n == 1 else "conflict_s_vs_r" if {"S", "R"} <= self.sirs else "conflict_gt_1_step" if apart else None
        lower, upper = (self.low, self.high) if meets else self.best[:2]
        return lower, upper, next((x for x in ("R", "I", "S") if x in self.sirs), None), "|".join(sorted(self.raws, key=self.raws.get)), self.n, reason


class Merger(StatefulProcessor):
    """The readings of a group of keys. A retraction stays as a mark, so it also holds against its reading coming later.

    A group's readings lie in RocksDB in CHUNKS values, dealt by id. A micro-batch asks for a chunk once for each frame of
    rows and tells it once, not for each reading; then the chunks are read through for the keys it touches. What is held
    meanwhile is one chunk, and bounds, flags and the distinct raw texts of those keys.
    """

    def init(self, handle) -> None:
        self.readings = handle.getMapState("readings", "chunk long", "readings binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        plain = lambda x: None if x is None or x != x else x
        folds: dict[str, Readings] = {}
        for part in rows:
            dealt: dict[int, list[tuple]] = {}
            for k, at, lower, upper, sir, raw, retracted in zip(*(part[c].tolist() for c in _HELD.names), strict=True):
                folds.setdefault(k, Readings())
                dealt.setdefault(at % CHUNKS, []).append(((k, at), (lower, upper, plain(sir), plain(raw), bool(retracted))))
            for chunk, came in dealt.items():
                held = self.readings.getValue((chunk,))
                known = {} if held is None else _unpacked(held[0])
                for at, reading in came:
                    old = known.get(at)
                    if old is None or reading[4] and not old[4]:
                        known[at] = reading
                self.readings.updateValue((chunk,), (_packed(known),))
        for _, (held,) in self.readings.iterator():
            for (k, at), (lower, upper, sir, raw, retracted) in _unpacked(held).items():
                if not retracted and k in folds:
                    folds[k].add(at, lower, upper, sir, raw)
        yield pd.DataFrame([(k, *fold.merged()) for k, fold in folds.items()], columns=["key", *(x.split()[0] for x in MERGED.split(", "))]).astype({"lower": float, "upper": float})

    def close(self) -> None:
        pass


_HELD = pa.schema([("key", pa.string()), ("at", pa.int64()), ("lower", pa.float64()), ("upper", pa.float64()), ("sir", pa.string()), ("raw", pa.string()), ("retracted", pa.bool_())])


def _packed(readings: dict[tuple, tuple]) -> bytes:
    columns = zip(*((*k, *r) for k, r in readings.items()), strict=True)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, _HELD) as writer:
        writer.write_batch(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _HELD.types, strict=True)], schema=_HELD))
    return out.getvalue().to_pybytes()


def _unpacked(held: bytes) -> dict[tuple, tuple]:
    rows = zip(*(c.to_pylist() for c in pa.ipc.open_stream(held).read_all().columns), strict=True)
    return {r[:2]: r[2:] for r in rows}


def merged(readings: DataFrame, keys: list[str]) -> DataFrame:
    """2.12 late merging: a stream of readings (keys, at, lower, upper, sir, raw, retracted) -> the key's new row, each time it changes.

    at is a reading's id: one that comes again changes nothing. The last row of a key is what resolve_duplicates makes of
    all its readings, whatever the order and the batches they came in; n = 0 says that all were taken back.
    """
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    rows = readings.select(key.alias("key"), "at", "lower", "upper", "sir", "raw", F.coalesce("retracted", F.lit(False)).alias("retracted"))
    rows = rows.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(GROUPS))).groupBy("group")
    out = rows.transformWithStateInPandas(Merger(), f"key string, {MERGED}", "Update", "None")
    own = F.from_json("key", StructType([readings.schema[k] for k in keys]))
    return out.withColumn("key", own).select("key.*", *(x.split()[0] for x in MERGED.split(", ")))


def follow(readings: DataFrame, keys: list[str], table: str, checkpoint: str) -> None:
    """The stream's rows into the versioned table at that path, once each: a micro-batch is one commit, also if it is run again."""

    def keep(batch: DataFrame, number: int) -> None:
        sinks.upsert(batch.sparkSession, table, batch.selectExpr("*", f"{number}L AS version"), keys, "version", token=f"{checkpoint}#{number}")

    take_available(merged(readings, keys), checkpoint, mode="update", each=keep)


def labels(spark: SparkSession, table: str) -> DataFrame | None:
    """The table's keys that have readings left."""
    now = sinks.current(spark, table)
    return None if now is None else now.filter("n > 0").drop("version")
