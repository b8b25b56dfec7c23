"""ML8: canonical k-mer sketches with 64-bit wrap-around hashing, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from susceptra.storage import bounded_batches

_UNKNOWN = 4
_CODE = np.full(256, _UNKNOWN, np.uint8)
# Two bits a base, in this order, so that 3 minus a code is its complement's.
_CODE[list(b"ACGT")] = range(4)


def kmer_hashes(seq: str, k: int = 19, bits: int = 11) -> np.ndarray:
    """Distinct mixed hashes of canonical k-mers whose low bits are zero; windows with other letters than A, C, G, T are skipped.

    A k-mer is the number of its two-bit codes, first base highest, and canonical is the smaller of both strands; k is 31 at most.
    """
    return np.unique(_sampled(seq.encode("utf-8", "replace"), k, bits)[1])


#: Bases that are hashed at once where texts are many: what is computed stays in the processor's cache.
_AT_ONCE = 1 << 15


def kmer_sets(seqs: list[str], k: int = 19, bits: int = 11) -> list[set[int]]:
    """kmer_hashes of each, as sets. Short texts are hashed together, with a letter that is no base between them."""
    found, texts = [set() for _ in seqs], [seq.encode("utf-8", "replace") for seq in seqs]
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) < _AT_ONCE):
            size, last = size + len(texts[last]) + 1, last + 1
        at, hashes = _sampled(b"N".join(texts[first:last]), k, bits)
        ends = np.cumsum([len(text) + 1 for text in texts[first:last]])
        for i, h in zip(np.searchsorted(ends, at, "right").tolist(), hashes.tolist(), strict=True):
            found[first + i].add(h)
        first = last
    return found


def _sampled(text: bytes, k: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the k-mers start whose hashes are kept, and these hashes."""
    codes = _CODE[np.frombuffer(text, np.uint8)]
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    unknown = np.concatenate(([0], np.cumsum(codes == _UNKNOWN)))
    whole = np.flatnonzero(unknown[k:] == unknown[:-k])
    own, other = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    base = (codes & 3).astype(np.uint64)
    four, three = np.uint64(4), np.uint64(3)
    for i in range(k):
        own = own * four + base[i : i + n]
        other = other * four + (three - base[k - 1 - i : k - 1 - i + n])
    h = np.minimum(own, other)[whole]
    # fixed values: the public splitmix64 finaliser
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    kept = h & np.uint64((1 << bits) - 1) == 0
    return whole[kept], h[kept]


def sketch(df: DataFrame, key: str, seq: str, k: int = 19, bits: int = 11) -> DataFrame:
    """(key, seq) -> (key, hash): hashes as signed longs; null sequences have none."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # a frame a batch: one a row costs more than its hashes
            found = [kmer_hashes(s.as_py() or "", k, bits) for s in b.column(1)]
            rows = np.repeat(np.arange(len(found)), [len(h) for h in found])
            flat = np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(flat)], [key, "hash"])

    bounded_batches(df.sparkSession)
    return df.select(key, seq).mapInArrow(run, f"{key} {kind}, hash bigint")
