"""Columns chosen inside each training fold, for all folds in one pass over the long relation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from susceptra.storage import materialise


def _without(cells: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """cells (fold, keys, sums) -> (held, keys, sums): for each fold the sums over all other folds, and for -1 those over all.

    Each cell goes to its keys' total and, negated, to the fold that holds it out; keys are few against rows. The cells are
    written, as they are read three times and what they are summed from is long.
    """
    cells = materialise(cells, "cells")
    folds = cells.groupBy().agg(F.array_union(F.sort_array(F.collect_set("fold")), F.array(F.lit(-1).cast(cells.schema["fold"].dataType))).alias("folds"))  # one row, a number a fold
    total = cells.groupBy(*keys).agg(*[F.sum(s).alias(s) for s in sums])
    spread = total.join(folds).withColumn("held", F.explode("folds"))
    own = cells.select(F.col("fold").alias("held"), *keys, *[(-F.col(s)).alias(s) for s in sums])
    return spread.select("held", *keys, *sums).unionByName(own).groupBy("held", *keys).agg(*[F.sum(s).alias(s) for s in sums])


def frequent_by_fold(present: DataFrame, genomes: DataFrame, least: int = 5) -> DataFrame:
    """ML6, AG26: (held, column) present in at least so many genomes of some species outside the held fold."""
    cells = present.select("genome", "column").distinct().join(genomes, "genome").groupBy("fold", "species", "column").agg(F.count(F.lit(1)).alias("n"))
    return _without(cells, ["species", "column"], ["n"]).groupBy("held", "column").agg(F.max("n").alias("most")).filter(F.col("most") >= least).select("held", "column")


def correlated_by_fold(present: DataFrame, genomes: DataFrame, targets: DataFrame, low: float = 0.01, high: float = 0.99, most: int = 20_000) -> DataFrame:
    """ML6, AG27: (held, species, column, correlation) of each species' columns outside the held fold.

    present (genome, column), genomes (genome, species, fold), targets (genome, drug, y). A column's share of the genomes must
    be within low and high; if more than `most` columns are, the greatest correlation (absolute, of any drug with three
    genomes or more) decides, equal ones by name. Sums by fold are made once, and each fold's own are taken off the total.
    """
    pairs = present.select("genome", "column").distinct().join(genomes, "genome")
    sizes = _without(genomes.groupBy("fold", "species").agg(F.count(F.lit(1)).alias("size")), ["species"], ["size"])
    counts = _without(pairs.groupBy("fold", "species", "column").agg(F.count(F.lit(1)).alias("n")), ["species", "column"], ["n"])
    within = counts.join(sizes, ["held", "species"]).filter((F.col("n") >= low * F.col("size")) & (F.col("n") <= high * F.col("size")) & (F.col("size") > 0)).select("held", "species", "column")
    y = targets.join(genomes, "genome")
    by_drug = y.groupBy("fold", "species", "drug").agg(F.count(F.lit(1)).alias("known"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"))
    by_drug = _without(by_drug, ["species", "drug"], ["known", "sy", "syy"]).filter("known >= 3")
    by_column = pairs.join(targets, "genome").groupBy("fold", "species", "drug", "column").agg(F.count(F.lit(1)).alias("nx"), F.sum("y").alias("sxy"))
    by_column = _without(by_column, ["species", "drug", "column"], ["nx", "sxy"])
    j = by_column.join(by_drug, ["held", "species", "drug"])
    cross = F.col("sxy") - F.col("nx") * F.col("sy") / F.col("known")
    width = F.sqrt(F.greatest(F.col("nx") - F.col("nx") * F.col("nx") / F.col("known"), F.lit(0.0))) + 1e-9
    height = F.sqrt(F.greatest(F.col("syy") - F.col("sy") * F.col("sy") / F.col("known"), F.lit(0.0))) + 1e-9
    best = j.groupBy("held", "species", "column").agg(F.max(F.round(F.abs(cross) / (width * height), 9)).alias("correlation"))
    ranked = within.join(best, ["held", "species", "column"], "left").withColumn("correlation", F.coalesce("correlation", F.lit(0.0)))
    by = W.partitionBy("held", "species").orderBy(F.col("correlation").desc(), "column")
    return ranked.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= most).drop("rank")
