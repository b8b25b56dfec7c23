"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from susceptra.llm.text import table
from susceptra.storage import bounded_batches, free_name

BITS = 18
#: Bound of the training sample: the labelled documents with the smallest md5 of their id.
TRAIN_DOCS = 6000
THRESHOLD = 0.7
_TOKEN = re.compile(r"[^\W_]+|(?:[^\w\s]|_)+")
_REPEAT = 0x5851F42D


class _Hashes(dict):
    """32-bit hash of a token; forgets all beyond 100,000 tokens, to keep a worker's memory small."""

    def __missing__(self, token: str) -> int:
        if len(self) > 100_000:
            self.clear()
        self[token] = h = xxhash.xxh32_intdigest(token)
        return h


_HASHES = _Hashes()


def buckets(text: str | None) -> np.ndarray:
    """Buckets of the text's tokens and token pairs, one entry per occurrence.

    Tokens are lower-cased runs of letters and digits, or of signs. In a pair an equal neighbour is written as a back
    reference, so that repetition is one feature whatever word repeats.
    """
    tokens = _TOKEN.findall((text or "").lower())
    if not tokens:
        return np.empty(0, np.int64)
    one = np.array([_HASHES[t] for t in tokens], np.uint64)
    left, right = one[:-1], one[1:]
    pair = (left * np.uint64(0x9E3779B1) + right * np.uint64(0x85EBCA77)) & np.uint64(0xFFFFFFFF)
    pair[left == right] = _REPEAT
    return (np.concatenate((one, pair ^ pair >> np.uint64(15))) & np.uint64((1 << BITS) - 1)).astype(np.int64)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The text as a sparse vector: buckets and counts, scaled by the root of their sum."""
    found = buckets(text)
    index, counts = np.unique(found, return_counts=True)
    return index, counts / np.sqrt(max(1, len(found)))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        """P(label 1): a sparse dot product, summed over occurrences; the bias alone for a text without tokens."""
        found = buckets(text)
        z = self.bias + (float(self.weights[found].sum(dtype=np.float64)) / np.sqrt(len(found)) if len(found) else 0.0)
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -35, 35))))


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 1.0) -> Model:
    """FTRL-proximal with per-coordinate rates over rows (buckets, values, label), in the order given. No rows: score 0.5."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = 0.0

    def weight(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for index, value, label in rows:
            w = weight(z[index], n[index])
            b = -zb / ((beta + np.sqrt(nb)) / alpha)
            error = 1.0 / (1.0 + np.exp(-np.clip(b + w @ value, -35, 35))) - label
            g = error * value
            z[index] += g - (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / alpha * w
            n[index] += g * g
            zb += error - (np.sqrt(nb + error * error) - np.sqrt(nb)) / alpha * b
            nb += error * error
    return Model(weight(z, n).astype(np.float32), float(-zb / ((beta + np.sqrt(nb)) / alpha)))


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text leaves 2 modulo 4; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_DOCS, **options) -> Model:
    """Train on at most bound labelled documents that are not held out.

    Executors turn texts into sparse vectors; only those of the bounded sample come to the driver, at most 2 ** BITS
    entries each. Null labels or ids are ignored, contradicting labels of an id count as 0, repeated ids count once.
    """
    bounded_batches(docs.sparkSession)
    pairs = labels.filter("doc_id is not null and quality is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    known = docs.select("doc_id").join(pairs, "doc_id").distinct()
    chosen = known.withColumn("rank", F.md5(F.col("doc_id").cast("string"))).orderBy("rank", "doc_id").limit(bound)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [features(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("rank"), b.column("quality"), pa.array([i.astype(np.int32) for i, _ in made], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in made], pa.list_(pa.float32()))], ["rank", "quality", "index", "value"])

    # at most `bound` short rows: a proven size
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("rank", "quality", "text")
    found = texts.mapInArrow(vectors, "rank string, quality int, index array<int>, value array<float>").toArrow()
    order = np.argsort(np.array(found.column("rank").to_pylist(), dtype=object), kind="stable") if len(found) else []
    index, value, label = found.column("index").combine_chunks(), found.column("value").combine_chunks(), found.column("quality").to_pylist()
    rows, seen = [], set()
    for i in order:
        if (rank := found.column("rank")[int(i)].as_py()) not in seen:
            seen.add(rank)
            rows.append((index[int(i)].values.to_numpy(), value[int(i)].values.to_numpy(), label[int(i)]))
    return train_ftrl(rows, **options)


def score(docs: DataFrame, model: Model, text: str = "text", columns: list[str] | None = None, name: str = "score") -> DataFrame:
    """The given columns of docs (all by default) plus the score under name, in the place of a column so called; whole texts are read, null counts as empty."""
    bounded_batches(docs.sparkSession)
    keep = [c for c in (columns if columns is not None else docs.columns) if c != name]
    own = text in keep and dict(docs.dtypes)[text] == "string"
    source = docs.select(*keep) if own else docs.select(*keep, F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 1000) for i in range(0, b.num_rows, 1000)):
                scores = [model.score(t.as_py()) for t in part.column(text if own else "__text")]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(scores, pa.float64())], [*keep, name])

    return source.mapInArrow(run, docs.select(*keep).schema.add(name, "double"))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from the threshold on) for every row of docs.

    Null texts and ids are kept and judged as empty ones, repeated rows alike; other columns are not read; no rows give no rows.
    """
    model = fit(docs, labels)
    scored = score(docs, model, columns=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, sf_dir: str, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those the classifier rejects; it learns from the labels table beside them.

    All columns stay as they are, also one named score. Null texts are judged as empty, repeated rows alike; no rows give no rows.
    """
    model = fit(docs, table(docs.sparkSession, sf_dir, "labels"))
    name = free_name(docs, "__score")
    return score(docs, model, name=name).filter(F.col(name) >= threshold).select(*docs.columns)
