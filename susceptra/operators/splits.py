"""Cluster-level splits. Clusters are few (one row each); genomes join their cluster's split afterwards."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def greedy_fill(names: list[str], sizes: list[int], seed: int, least: float = 0.15, most: float = 0.20) -> set[str]:
    """SO5: clusters in a seeded order join the test set while it is below `least`, skipping any that would pass `most`."""
    total, have, chosen = sum(sizes), 0, set()
    order = sorted(range(len(names)), key=lambda i: names[i])
    random.Random(seed).shuffle(order)
    for i in order:
        if have >= least * total:
            break
        if have + sizes[i] <= most * total:
            chosen.add(names[i])
            have += sizes[i]
    return chosen


def fill_with_classes(names: list[str], sizes: list[int], counts: dict, drugs: list[str], seed: int, tries: int = 50, least_per_class: int = 10) -> set[str]:
    """SO5: the first of so many seeded fills whose test set has enough R and S of every drug; raises where none has.

    counts: cluster -> {(drug, sir): n}.
    """
    for attempt in range(seed, seed + tries):
        chosen = greedy_fill(names, sizes, attempt)
        if all(sum(counts.get(c, {}).get((d, x), 0) for c in chosen) >= least_per_class for d in drugs for x in "RS"):
            return chosen
    raise ValueError("no seed gave a test set with R and S of every drug")


def folds(names: list[str], sizes: list[int], k: int) -> dict[str, int]:
    """SO6: largest cluster first into the emptiest fold, lowest number on ties."""
    load, out = [0] * k, {}
    for i in sorted(range(len(names)), key=lambda i: (-sizes[i], names[i])):
        f = min(range(k), key=lambda j: (load[j], j))
        out[names[i]] = f
        load[f] += sizes[i]
    return out


def _one_task(clusters: DataFrame, schema: str, run) -> DataFrame:
    """The greedy rules are sequential over clusters, whose table is bounded by the number of lineages."""

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if parts:
            yield run(pd.concat(parts))

    return clusters.select("cluster", "n").coalesce(1).mapInPandas(whole, schema)


def greedy_test_clusters(clusters: DataFrame, seed: int) -> DataFrame:
    """(cluster, n) -> (cluster, n, split)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        test = greedy_fill(pdf.cluster.tolist(), pdf.n.tolist(), seed)
        return pdf.assign(split=["test" if c in test else "train" for c in pdf.cluster])

    return _one_task(clusters, "cluster string, n long, split string", run)


def lpt_fold(clusters: DataFrame, k: int) -> DataFrame:
    """(cluster, n) -> (cluster, n, fold)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = folds(pdf.cluster.tolist(), pdf.n.tolist(), k)
        return pdf.assign(fold=[own[c] for c in pdf.cluster])

    return _one_task(clusters, "cluster string, n long, fold int", run)


#: Clusters whose sizes and label counts are collected to be dealt out one after the other; more raise.
MOST_CLUSTERS = 1_000_000


def make_splits(lineages: DataFrame, labels: DataFrame, drugs: list[str], seed: int, k: int = 5, least_per_class: int = 10, tries: int = 50) -> DataFrame:
    """SO5, SO6: lineages (genome, cluster, ...) plus split and fold (null in the test set); whole clusters go either way.

    labels (genome, drug, sir). The test set is the first of so many seeded fills, of 15 to 20 % of the genomes, that has
    enough R and S of every drug; if none has, this raises. The rules are sequential over clusters, so clusters' sizes and
    counts, but no genomes, come to the driver; the assignment goes back as a small table.
    """
    sizes = lineages.filter("cluster is not null").groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).limit(MOST_CLUSTERS + 1).collect()
    if len(sizes) > MOST_CLUSTERS:
        raise ValueError(f"more than {MOST_CLUSTERS} clusters")
    wanted = labels.filter(F.col("drug").isin(*drugs) & F.col("sir").isin("R", "S")).join(lineages.select("genome", "cluster"), "genome")
    counts: dict[str, dict] = {}
    for r in wanted.groupBy("cluster", "drug", "sir").agg(F.count(F.lit(1)).alias("n")).collect():  # clusters * drugs * 2
        counts.setdefault(r.cluster, {})[r.drug, r.sir] = r.n
    names, n = [r.cluster for r in sizes], [r.n for r in sizes]
    test = fill_with_classes(names, n, counts, drugs, seed, tries, least_per_class)
    rest = [(c, size) for c, size in zip(names, n, strict=True) if c not in test]
    own = folds([c for c, _ in rest], [size for _, size in rest], k)
    dealt = lineages.sparkSession.createDataFrame([(c, "test" if c in test else "train", own.get(c)) for c in names], "cluster string, split string, fold int")
    return lineages.join(F.broadcast(dealt) if len(names) <= 100_000 else dealt, "cluster").select(*lineages.columns, "split", "fold")


def lineage_ids(genomes: DataFrame, snp_clusters: DataFrame) -> DataFrame:
    """SO7: genomes (genome, species, biosample) plus cluster: the species with the biosample's SNP cluster, without its version,
    or marked as alone where there is none. snp_clusters (biosample, snp_cluster); of several the least counts."""
    known = snp_clusters.filter("snp_cluster is not null").groupBy("biosample").agg(F.min(F.split_part("snp_cluster", F.lit("."), F.lit(1))).alias("snp__"))
    own = F.coalesce("snp__", F.concat(F.lit("SOLO_"), F.coalesce("biosample", F.lit(""))))
    return genomes.join(known, "biosample", "left").select(*genomes.columns, F.concat_ws("_", "species", own).alias("cluster"))
