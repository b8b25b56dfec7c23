"""Quality rules: plain counts of a text, and the log-likelihood ratio of its hashed n-grams.

Tokens (runs of letters and digits, or of signs, A-Z lower-cased) and pairs of neighbours are hashed into 2 ** BITS buckets.
Two multinomials over the buckets are counted: the trusted target's, over every document labelled 1, and the raw corpus's,
over every document. A text's ratio is the mean over its n-grams of log(target / raw); it is kept from THRESHOLD on, if it
does not fail the counts first. Nothing is drawn at random and nothing is sampled, so equal texts have equal verdicts.

Both counts are dense arrays of 2 ** BITS numbers in each task and sparse rows between tasks, so memory and the model
sent to executors do not grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from susceptra.storage import bounded_batches

BITS = 16
#: Mean log ratio (nats a n-gram) from which a text is kept.
THRESHOLD = -0.5
#: Counts added to each bucket of either side.
SMOOTHING = 1.0
#: Ids of 8 bytes that may be sent to every task.
MOST_IDS = 2_000_000
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
_SPACE, _SYMBOL, _LATER = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL[list(b"#*$%&|<>")] = True
_LATER[0x80:0xC0] = True  # bytes of a code point after its first


#: Tokens are runs of one class: 1 letters, digits and all beyond ASCII, 2 signs; white space and control codes (0) part them.
_CLASS = np.full(256, 2, np.uint8)
_CLASS[[*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)]] = 1
_CLASS[[*range(0x21), 0x7F]] = 0
#: Whole texts are taken in pieces of so many bytes, cut at the next space, to bound the arrays made of them.
PIECE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.cumprod(np.full(n, x, np.uint64)) for x in (_BASE, _INVERSE))


def token_hashes(piece: bytes) -> np.ndarray:
    """A 64-bit polynomial hash of each token: sums of byte times power over its run, freed of the power at which it starts."""
    a = np.frombuffer(piece, np.uint8)
    if not len(a):
        return np.empty(0, np.uint64)
    kind = _CLASS[a]
    starts = np.concatenate(([0], np.flatnonzero(kind[1:] != kind[:-1]) + 1))
    up, down = _powers(1 << max(16, (len(a) - 1).bit_length()))
    tokens = kind[starts] > 0
    return (np.add.reduceat(a * up[: len(a)], starts) * down[starts])[tokens]


def pieces(raw: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        yield raw[at:end]
        at = end


def ngrams(raw: bytes) -> Iterator[np.ndarray]:
    """Buckets of the text's tokens and pairs of tokens, one entry per occurrence, piece by piece."""
    before = np.empty(0, np.uint64)
    for piece in pieces(raw.lower()):
        one = token_hashes(piece)
        run = np.concatenate((before, one))
        two = (run[:-1] * np.uint64(0xD6E8FEB86659FD93) ^ run[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
        yield (np.concatenate((one * np.uint64(0xA0761D6478BD642F), two)) >> np.uint64(64 - BITS)).astype(np.int64)
        before = run[-1:]


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window of three found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    _, pair = np.unique(at[:-1] * len(ids) + at[1:], return_inverse=True)
    _, triple, count = np.unique(pair[:-1] * len(ids) + at[2:], return_inverse=True, return_counts=True)
    again = count[triple] > 1
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : n - 2 + k] |= again
    return int(inside.sum())


def repeated_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def text_counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text in UTF-8."""
    words, signs = raw.split(), np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = len(raw) - int(signs[_SPACE].sum()) - int(signs[_LATER].sum())
    return len(words), chars, int(signs[_SYMBOL].sum()), repeated_lines(raw), repeated_words(words)


def fails_counts(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def bucket_counts(texts: DataFrame) -> DataFrame:
    """texts (raw binary, trusted boolean) -> (trusted, bucket, n): occurrences over all rows, trusted ones on both sides; each
    task sends at most 2 * 2 ** BITS rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BITS), np.int64)
        waiting: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])

        def add() -> None:
            for side, found in enumerate(waiting):
                total[side] += np.bincount(np.concatenate(found), minlength=1 << BITS) if found else 0
                found.clear()

        for b in batches:
            size = 0
            for x, trusted in zip(b.column("raw"), b.column("trusted").to_pylist(), strict=True):
                for found in ngrams(x.as_py() or b""):
                    waiting[0].append(found)
                    if trusted:
                        waiting[1].append(found)
                    size += len(found)
                    if size >= 1 << 18:
                        add()
                        size = 0
            add()
        side, found = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(side == 1), pa.array(found.astype(np.int32)), pa.array(total[side, found])], ["trusted", "bucket", "n"])

    return texts.mapInArrow(run, "trusted boolean, bucket int, n long").groupBy("trusted", "bucket").agg(F.sum("n").alias("n"))


def log_ratios(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """log(target / raw) of each bucket, both smoothed: 2 ** BITS numbers, whatever the corpus.

    Labels of an id that contradict each other count as 0; null labels and ids, and labels of no document, are ignored. The
    trusted ids are counted: up to MOST_IDS are sent to the tasks that read the texts, more are joined by a shuffle.
    """
    good = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id", F.lit(True).alias("trusted"))
    if good.count() <= MOST_IDS:
        good = F.broadcast(good)
    texts = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("raw")).join(good, "doc_id", "left").select("raw", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    found = bucket_counts(texts).toArrow()  # at most 2 * 2 ** BITS short rows
    trusted, bucket, n = (found.column(c).to_numpy() for c in ("trusted", "bucket", "n"))
    sides = []
    for side in (True, False):
        counts = np.full(1 << BITS, SMOOTHING)
        counts[bucket[trusted == side]] += n[trusted == side]
        sides.append(counts / counts.sum())
    return np.log(sides[0]) - np.log(sides[1])


def ratio(raw: bytes, weights: np.ndarray) -> float:
    """Mean log ratio over the text's n-grams; 0 for a text without any."""
    total, n = 0.0, 0
    for found in ngrams(raw):
        total, n = total + float(weights[found].sum()), n + len(found)
    return total / n if n else 0.0


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the counts of text_counts, base_failed, score (the ratio) and kept for every row of docs.

    A null text has no words. Null ids and repeated rows are judged like others; other columns of docs are not read; an
    empty table gives no rows, and without labels the ratio is that of a flat target.
    """
    bounded_batches(docs.sparkSession)
    weights = log_ratios(docs, labels)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, failed, scores = [], [], []
            for x in b.column("raw"):
                raw = x.as_py() or b""
                counts.append(text_counts(raw))
                failed.append(fails_counts(counts[-1][0], counts[-1][4]))
                scores.append(ratio(raw, weights))
            kept = [not f and s >= threshold for f, s in zip(failed, scores, strict=True)]
            columns = [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)] if counts else [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns, pa.array(failed, pa.bool_()), pa.array(scores, pa.float64()), pa.array(kept, pa.bool_())], ["doc_id", *names, "base_failed", "score", "kept"])

    read = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("raw"))
    schema = read.select("doc_id").schema
    for n in names:
        schema = schema.add(n, "long")
    return read.mapInArrow(run, schema.add("base_failed", "boolean").add("score", "double").add("kept", "boolean"))
