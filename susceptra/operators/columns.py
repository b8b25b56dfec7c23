"""Maps of feature columns, collapsed patterns, label counts with empty cells, and the same-profile baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column_map(hits: DataFrame, column: Column, symbol: str, kind: str, genome: str) -> DataFrame:
    """AG11: (column_name, source_symbol, class, n_genomes_present): the sorted symbols joined, the first class that is not null, distinct genomes.

    The first class is that of the least (genome, symbol, class), so it does not depend on the order of files. Aggregated
    in parts: what is kept of a column is its distinct symbols and one class.
    """
    first = F.min(F.when(F.col(kind).isNotNull(), F.struct(genome, symbol, kind)))
    out = hits.groupBy(column.alias("column_name")).agg(F.array_join(F.array_sort(F.collect_set(symbol)), "|").alias("source_symbol"), first.alias("first__"), F.count_distinct(genome).alias("n_genomes_present"))
    return out.select("column_name", "source_symbol", F.col("first__")[kind].alias("class"), "n_genomes_present")


def merge_column_maps(maps: list[DataFrame]) -> DataFrame:
    """AG12: the maps as one: symbols split and joined again, the class of the first map that has one, genomes added up."""
    every = maps[0].withColumn("map__", F.lit(0))
    for i, m in enumerate(maps[1:], 1):
        every = every.unionByName(m.withColumn("map__", F.lit(i)))
    symbols = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("source_symbol", r"\|")))))
    first = F.min(F.when(F.col("class").isNotNull(), F.struct("map__", "class")))["class"]
    return every.groupBy("column_name").agg(F.array_join(symbols, "|").alias("source_symbol"), first.alias("class"), F.sum("n_genomes_present").alias("n_genomes_present"))


def collapse_patterns(present: DataFrame, genome: str, column: str, genomes: int, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """EX2: (first, members, n_genomes) of the columns that are present in exactly the same genomes, within the frequency window.

    Sums of two hashes of the genomes and their number name a pattern: no column's genomes are ever gathered. Sums of
    different sets agree with a chance of about 2 ** -127.
    """
    pairs = present.select(genome, column).distinct()
    wide = lambda seed: F.sum(F.xxhash64(F.lit(seed), F.col(genome)).cast("decimal(20,0)"))
    own = pairs.groupBy(column).agg(F.count(F.lit(1)).alias("n"), wide(1).alias("one"), wide(2).alias("two")).filter((F.col("n") >= low * genomes) & (F.col("n") <= high * genomes))
    return own.groupBy("n", "one", "two").agg(F.array_sort(F.collect_list(column)).alias("members")).select(F.col("members")[0].alias("first"), "members", F.col("n").alias("n_genomes"))


def label_counts_everywhere(labels: DataFrame, one: str, two: str) -> DataFrame:
    """AG28: (one, two, n_labels) for every pair of values that occur, also where no label has both.

    Values of either key are dimensions of the domain (species, drugs): few, and counted before they are paired.
    """
    counted = labels.groupBy(one, two).agg(F.count(F.lit(1)).alias("n_labels"))
    values = counted.groupBy().agg(F.array_sort(F.collect_set(one)).alias("ones"), F.array_sort(F.collect_set(two)).alias("twos"))  # one row
    grid = values.select(F.explode("ones").alias(one), "twos").select(one, F.explode("twos").alias(two))
    return grid.join(counted, [one, two], "left").fillna(0, ["n_labels"])


def same_profile_median(rows: DataFrame, profile: str, value: str, train: str) -> DataFrame:
    """EX4: rows plus baseline: the median value of the training rows of the same profile, null where none has it."""
    known = rows.filter(F.col(train) & F.col(profile).isNotNull()).groupBy(profile).agg(F.median(value).alias("baseline"))
    return rows.join(known, profile, "left")
