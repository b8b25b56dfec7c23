"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within RADIUS bits share a variant that each reaches by flipping at most RADIUS / 2 bits. So every
distinct fingerprint stands for its 1 + 64 + 2016 variants, variants are brought together, and fingerprints that share one
are linked. Sharing a variant bounds the distance by 2 + 2 bits, so a collision is its own proof; the distance is still
computed and checked.

Variants travel by a linear route: route(v) is the XOR of one ROUTE-bit word per set bit of v, so
route(fp ^ mask) = route(fp) ^ route(mask). A row (route, fp) therefore tells its receiver exactly which masks of fp land
there, and 2081 variants cost at most 2 ** ROUTE_BITS shuffled rows instead of 2081. Each route is one group of at most one
row per distinct fingerprint, handled in slices of bounded memory. Past ROUTE_ROWS fingerprints the number of routes grows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from susceptra.operators.components import connected_components
from susceptra.storage import bounded_batches, free_name, materialise

SHINGLE, RADIUS, SEED = 4, 4, 42
ROUTE_BITS, ROUTE_ROWS, SLICE = 6, 1 << 23, 1 << 19
_UPPER_TO_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def simhash(text: str | None, size: int = SHINGLE) -> int:
    """64-bit SimHash of the text's word shingles, repeats included, as an unsigned number; no words give zero.

    Words are runs without ASCII white space, A-Z lower-cased; a bit is 1 if more than half of the shingles' XXH64 have it.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_UPPER_TO_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > size:
        starts, ends = starts[: 1 - size], ends[size - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, np.int64), len(starts)
    for at in range(0, n, 1 << 16):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + (1 << 16)].tolist(), ends[at : at + (1 << 16)].tolist(), strict=True)], np.uint64)
        counts += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a column fp: the SimHash's bits as a signed long. Null text has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([simhash(t.as_py()) for t in b.column(text)], np.uint64).astype(np.int64)
            keep = [n for n in b.schema.names if n != text]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in keep], pa.array(fps)], [*keep, "fp"])

    bounded_batches(docs.sparkSession)
    columns = [c for c in docs.columns if c not in (text, "fp")]
    schema = docs.select(*columns).schema.add("fp", "long")
    return docs.select(*columns, text).mapInArrow(run, schema)


def _splitmix(x: int) -> int:
    """The public splitmix64 finaliser."""
    x = (x + 0x9E3779B97F4A7C15) & (1 << 64) - 1
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & (1 << 64) - 1
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & (1 << 64) - 1
    return x ^ x >> 31


@lru_cache(maxsize=4)
def _masks(half: int) -> tuple[np.ndarray, np.ndarray]:
    """All masks of at most half set bits, and the 32-bit route of each."""
    one = [np.uint64(1) << np.uint64(i) for i in range(64)]
    word = [np.uint64(_splitmix(i) >> 32) for i in range(64)]
    masks, routes, last = [np.uint64(0)], [np.uint64(0)], [(-1, np.uint64(0), np.uint64(0))]
    for _ in range(half):
        last = [(j, m | one[j], r ^ word[j]) for i, m, r in last for j in range(i + 1, 64)]
        masks += [m for _, m, _ in last]
        routes += [r for _, _, r in last]
    return np.array(masks, np.uint64), np.array(routes, np.uint64)


def _route(fps: np.ndarray) -> np.ndarray:
    out = np.zeros(len(fps), np.uint64)
    for i in range(64):
        out ^= np.where(fps >> np.uint64(i) & np.uint64(1), np.uint64(_splitmix(i) >> 32), np.uint64(0))
    return out


def _collisions(fps: np.ndarray, route: int, bits: int, half: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links (smallest, other) among fps sharing a variant whose route starts with the given bits."""
    masks, routes = _masks(half)
    own = _route(fps)
    deeper = 0
    while len(fps) * len(masks) >> bits + deeper > SLICE and bits + deeper < 30:
        deeper += 1
    depth = np.uint64(32 - bits - deeper)
    by_code: dict[int, list[int]] = {}
    for i, r in enumerate((routes >> depth).tolist()):
        by_code.setdefault(r, []).append(i)
    codes = own >> depth
    order = np.argsort(codes, kind="stable")
    distinct, first = np.unique(codes[order], return_index=True)
    groups = dict(zip(distinct.tolist(), np.split(fps[order], first[1:]), strict=True))
    links = []
    for low in range(1 << deeper):
        target = route << deeper | low
        found, owner = [], []
        for code, members in groups.items():
            if mine := by_code.get(code ^ target):
                found.append((members[:, None] ^ masks[mine][None, :]).ravel())
                owner.append(np.repeat(members, len(mine)))
        if not found:
            continue
        variants = np.concatenate(found)
        if len(variants) < 2:
            continue
        ordered = np.sort(variants)
        shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if not len(shared):
            continue
        slot = np.minimum(np.searchsorted(shared, variants), len(shared) - 1)
        hit = shared[slot] == variants
        who, slot = np.concatenate(owner)[hit], slot[hit]
        least = np.full(len(shared), np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(least, slot, who)
        a, b = least[slot], who
        pairs = np.unique(np.stack([a[a != b], b[a != b]], 1), axis=0)
        links.append((pairs[:, 0], pairs[:, 1]))
    return links


def links(fps: DataFrame, radius: int = RADIUS, route_bits: int | None = None) -> DataFrame:
    """Distinct fp (one column, materialised) -> links (a, b) that join all fingerprints at radius or fewer differing bits.

    Fingerprints sharing a variant are all within radius of each other, so each is tied to the smallest of them: the
    links connect exactly what all pairs would, without emitting a group's pairs.
    """
    half = radius // 2
    if radius % 2:
        raise ValueError("the radius is split in two: give an even one")
    bits = route_bits
    if bits is None:
        n, bits = fps.count(), ROUTE_BITS
        while bits < 24 and n * min(1.0, len(_masks(half)[0]) / (1 << bits)) > ROUTE_ROWS:
            bits += 1

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = np.unique(_masks(half)[1] >> np.uint64(32 - bits))
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for part in np.array_split(fp, max(1, len(fp) * len(codes) >> 20)):
                routes = (_route(part) >> np.uint64(32 - bits))[:, None] ^ codes[None, :]
                yield pa.RecordBatch.from_arrays([pa.array(routes.ravel().astype(np.int32)), pa.array(np.repeat(part, len(codes)).view(np.int64))], ["route", "fp"])

    def meet(key: tuple, group: pa.Table) -> pa.Table:
        fp = np.sort(group.column("fp").to_numpy().view(np.uint64))
        found = _collisions(fp, int(key[0].as_py()), bits, half)
        a = np.concatenate([x for x, _ in found]) if found else np.empty(0, np.uint64)
        b = np.concatenate([x for _, x in found]) if found else np.empty(0, np.uint64)
        near = np.unpackbits((a ^ b).view(np.uint8).reshape(-1, 8), axis=1).sum(1) <= radius if len(a) else np.empty(0, bool)
        pairs = np.unique(np.stack([a[near], b[near]], 1), axis=0) if len(a) else np.empty((0, 2), np.uint64)
        return pa.table({"a": pairs[:, 0].copy().view(np.int64), "b": pairs[:, 1].copy().view(np.int64)})

    bounded_batches(fps.sparkSession)
    routed = fps.select("fp").mapInArrow(emit, "route int, fp long")
    return routed.groupBy("route").applyInArrow(meet, "a long, b long").distinct()


def _components(marked: DataFrame, radius: int) -> DataFrame:
    """marked (doc_id, fp), materialised -> (fp, component, component_id): a row per fingerprint; component is a fingerprint of its own."""
    nodes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprints")
    joined = connected_components(materialise(links(nodes.select("fp"), radius), "links"))
    named = nodes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = materialise(named, "components")
    lowest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return named.join(lowest, "component").select("fp", "component", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, fingerprint, component_id) per row of docs: components of the links between fingerprints.

    Fingerprint zero (no words, null text) links like any other. Null ids keep their row and never name a component
    unless all ids in it are null. Repeated rows are kept. Other columns are ignored. No rows give no rows.
    """
    marked = materialise(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))), "simhash")
    return marked.join(_components(marked, radius).drop("component"), "fp").select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs without near-duplicates: of each component the row with the smallest doc_id stays, once; all columns are kept.

    Rows of one doc_id are told apart by their texts, so only rows of the same component remove each other; of rows equal
    in both any one stays. A component of null ids only keeps one row. Other columns stay, whatever their names.
    """
    key = free_name(docs, "__key")
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id").cast("string"), F.col("text").isNull(), F.col("text").cast("string")))
    marked = materialise(fingerprints(keyed.select("doc_id", key, F.col("text").cast("string").alias("text"))), "simhash")
    classes = _components(marked, radius).select("fp", "component")
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", key)
    heads = marked.join(classes, "fp").groupBy("component").agg(F.min(place).alias("head"))
    rows = marked.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    heads = materialise(heads.select(F.col(f"head.{key}").alias(key)).join(rows, key), "kept")
    # only rows that stand more than once are grouped, so texts are not shuffled for the others
    once = keyed.join(heads.filter("n = 1"), key, "left_semi")
    more = keyed.join(heads.filter("n > 1"), key, "left_semi").dropDuplicates([key])
    return once.unionByName(more).select(*docs.columns)
