"""Centroid clustering: exact k-means on integers, each assignment by annulus search.

Components become floor(SCALE * x), so that sums, means and distances are integers and no order of adding changes a
result. Centroids are sorted by norm. The distance u of a vector to the centroid nearest in norm bounds what it looks for,
and | |c| - |x| | <= |c - x|, so any centroid as near as u has its norm within u of the vector's own: two binary searches
find this annulus (a little wider than rounding could err, so that ties on its border are in it), and only the centroids
in it are compared, exactly.

A round is one pass over the vectors: tasks assign and add up, and send a count and sums for each centroid. The centroids,
k of them, are all that the driver and the tasks hold. Vectors are never moved, so no cluster or repeated vector is hot.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from susceptra.llm.text import hex_digest
from susceptra.storage import bounded_batches, materialise

SCALE, DIM, CLUSTERS, ROUNDS, SEED = 1024, 64, 8, 10, "3:"
#: Integers up to here in size keep squared distances of DIM components below 2 ** 63; larger ones are Python integers.
_EXACT = 1 << 27
_LIMB = 1 << 60
_LARGEST = (1 << 63) - 1


def usable(vector: Column, dim: int = DIM) -> Column:
    """Vectors with exactly dim components, none null or non-finite; never null itself."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dim) & finite, F.lit(False))


def as_integers(flat: np.ndarray, dim: int) -> np.ndarray:
    """Rows of floor(SCALE * x); int64 where all of it fits, else Python integers."""
    scaled = np.floor(flat.astype(np.float64) * SCALE).reshape(-1, dim)
    if len(scaled) == 0 or np.abs(scaled).max() < _EXACT:
        return scaled.astype(np.int64)
    return np.array([[int(x) for x in row] for row in scaled.tolist()], object).reshape(-1, dim)


class Annulus:
    """Centroids in the order of their norms."""

    def __init__(self, centroids: list[tuple[int, ...]]):
        exact = all(abs(x) < _EXACT for c in centroids for x in c)
        rows = np.array(centroids, np.int64 if exact else object)
        norms = np.array([float(sum(x * x for x in c)) ** 0.5 for c in centroids])
        self.order = np.lexsort((np.arange(len(centroids)), norms))
        self.rows, self.norms = rows[self.order], norms[self.order]

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each vector the number of the nearest centroid, the smaller of equally near ones, and the squared distance."""
        if vectors.dtype != self.rows.dtype:
            vectors = vectors.astype(object)
        norm = np.sqrt((vectors * vectors).sum(1).astype(np.float64))
        right = np.searchsorted(self.norms, norm).clip(1, len(self.norms) - 1) if len(self.norms) > 1 else np.zeros(len(norm), int)
        near = np.where(np.abs(self.norms[right] - norm) < np.abs(norm - self.norms[right - 1]), right, right - 1) if len(self.norms) > 1 else right
        best = ((vectors - self.rows[near]) ** 2).sum(1)
        who = self.order[near]
        bound = np.sqrt(best.astype(np.float64))
        slack = bound + 1e-9 * (bound + norm + self.norms[-1]) + 1e-6
        low, high = np.searchsorted(self.norms, norm - slack, "left"), np.searchsorted(self.norms, norm + slack, "right")
        for j in range(int(low.min(initial=0)), int(high.max(initial=0))):
            at = np.flatnonzero((low <= j) & (j < high) & (near != j))
            if len(at):
                d = ((vectors[at] - self.rows[j]) ** 2).sum(1)
                nearer = (d < best[at]) | (d == best[at]) & (self.order[j] < who[at])
                best[at[nearer]], who[at[nearer]] = d[nearer], self.order[j]
        return who, best


def _vectors(batch: pa.RecordBatch, column: str, dim: int) -> np.ndarray:
    return as_integers(batch.column(column).flatten().to_numpy(zero_copy_only=False), dim)


def first_centroids(kept: DataFrame, k: int = CLUSTERS, seed: str = SEED, dim: int = DIM) -> list[tuple[int, ...]]:
    """The k vectors with the smallest sha256 of seed and id, in this order: k rows come to the driver.

    A null id counts as empty; vectors of one id are in the order of their components. Fewer than k vectors give fewer.
    """
    rows = kept.select(hex_digest(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("")))).alias("h"), "vector").orderBy("h", "vector").limit(k).collect()
    return [tuple(int(x) for x in as_integers(np.array(r.vector), dim)[0]) for r in rows]


def moved(kept: DataFrame, centroids: list[tuple[int, ...]], dim: int = DIM) -> list[tuple[int, ...]]:
    """One round: every centroid with vectors becomes floor(sum / count), component by component."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, count = Annulus(centroids), [0] * k
        total = np.zeros((k, dim), object)
        for b in batches:
            vectors = _vectors(b, "vector", dim)
            who, _ = search.nearest(vectors)
            for c in np.unique(who):
                own = vectors[who == c]
                count[c] += len(own)
                total[c] += own.sum(0).astype(object)
        rows = [(c, d, count[c], *divmod(int(total[c, d]), _LIMB)) for c in range(k) if count[c] for d in range(dim)]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0), pa.decimal128(38, 0))
        made = [pa.array([Decimal(x) for x in c] if pa.types.is_decimal(t) else c, t) for c, t in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(made, ["cluster", "at", "n", "high", "low"])

    # sums of up to 2 ** 60 are two numbers, so that no vector and no number of them overflows
    part = kept.select("vector").mapInArrow(run, "cluster int, at int, n long, high decimal(38,0), low decimal(38,0)")
    sums = part.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).collect()  # k * dim rows
    after = [list(c) for c in centroids]
    for r in sums:
        after[r.cluster][r.at] = (int(r.high) * _LIMB + int(r.low)) // r.n
    return [tuple(c) for c in after]


def assigned(kept: DataFrame, centroids: list[tuple[int, ...]], dim: int = DIM) -> DataFrame:
    """id, cluster and squared distance of every vector; a distance of 2 ** 63 or more is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Annulus(centroids)
        for b in batches:
            who, distance = search.nearest(_vectors(b, "vector", dim))
            far = pa.array([int(x) if x <= _LARGEST else None for x in distance], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(who.astype(np.int32)), far], ["id", "cluster", "distance"])

    return kept.mapInArrow(run, kept.select("id").schema.add("cluster", "integer").add("distance", "long"))


def cluster(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED, dim: int = DIM) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every usable vector, after so many rounds.

    Vectors of another length, null ones, and those with a null or non-finite component give no row. Null ids and repeated
    rows are clustered like others; other columns are not read; a table without usable vectors gives no rows. vectors is
    read rounds + 2 times: write it first if it is dear to compute. Inertias of 2 ** 63 or more are null.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    kept = vectors.select(F.col(f"`{vec_id}`").alias("id"), F.col(f"`{embedding}`").alias("vector")).filter(usable(F.col("vector"), dim))
    centroids = first_centroids(kept, k, seed, dim)
    for _ in range(rounds if centroids else 0):
        after = moved(kept, centroids, dim)
        if after == centroids:  # the rounds left would change nothing
            break
        centroids = after
    if centroids:
        found = materialise(assigned(kept, centroids, dim), "clusters")
    else:
        found = kept.filter(F.lit(False)).select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    wide = F.col("distance").cast("decimal(38,0)")
    sums = found.groupBy("cluster").agg(F.when(F.count("distance") == F.count(F.lit(1)), F.sum(wide)).alias("s")).collect()  # k rows
    every = sum(r.s for r in sums) if all(r.s is not None for r in sums) else None
    fits = lambda s: int(s) if s is not None and s <= _LARGEST else None
    own = {r.cluster: fits(r.s) for r in sums}
    table = [(c, own.get(c), fits(every), ",".join(map(str, x))) for c, x in enumerate(centroids)]
    facts = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, components string")
    facts = facts.withColumn("centroid_sha256", hex_digest(F.col("components"))).drop("components")
    return found.join(F.broadcast(facts), "cluster").select(F.col("id").alias(vec_id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
