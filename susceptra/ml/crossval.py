"""Models for every held-out fold at once, their out-of-fold predictions with bands, and scoring by a released model."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from susceptra.functions import mic
from susceptra.ml import linear, selection
from susceptra.operators.relational import conformal_fit
from susceptra.storage import dealt, materialise

#: The model that holds no fold out.
FINAL = -1
#: Names of drugs, folds and chosen columns are collected: so many at most.
MOST_COLUMNS = 1_000_000
MODEL = "drug string, kind string, species string, column string, weight double"


@dataclass(frozen=True)
class Inputs:
    """genomes (genome, species, fold), labels (genome, drug, lower, upper in log2), known (genome, column, n), wide (genome, column)."""

    genomes: DataFrame
    labels: DataFrame
    known: DataFrame
    wide: DataFrame


@dataclass(frozen=True)
class Options:
    known_min_count: int = 5
    wide_low: float = 0.01
    wide_high: float = 0.99
    wide_most: int = 20_000
    decay: float = 1e-3
    rounds: int = 60
    patience: int | None = 15
    level: float = 0.9
    band_min_rows: int = 20


def proxies(labels: DataFrame) -> DataFrame:
    """A finite stand-in for each interval: its upper bound, or the lower where that is infinite."""
    bound = F.when(F.abs("upper") != F.lit(mic.INF), F.col("upper")).otherwise(F.col("lower"))
    return labels.select("genome", "drug", bound.alias("y")).filter(F.abs("y") != F.lit(mic.INF))


def chosen_columns(data: Inputs, options: Options) -> DataFrame:
    """ML6: (held, kind, species, column) of each fold's model and of the FINAL one; species is null for the shared kinds."""
    null = F.lit(None).cast("string")
    known = selection.frequent_by_fold(data.known, data.genomes, options.known_min_count).select("held", F.lit("known").alias("kind"), null.alias("species"), "column")
    wide = selection.correlated_by_fold(data.wide, data.genomes, proxies(data.labels), options.wide_low, options.wide_high, options.wide_most).select("held", F.lit("wide").alias("kind"), "species", "column")
    # of every species but one, so that the intercept stays determined; the first is the one measured against
    each = data.genomes.groupBy().agg(F.sort_array(F.collect_set("species")).alias("s"), F.collect_set("fold").alias("f"))
    species = each.select(F.explode(F.array_union("f", F.array(F.lit(FINAL).cast("int")))).alias("held"), F.slice("s", 2, 1 << 20).alias("s")).select("held", F.lit("species").alias("kind"), null.alias("species"), F.explode("s").alias("column"))
    return known.unionByName(wide).unionByName(species)


@dataclass
class Fitted:
    drugs: list[str]
    columns: DataFrame  # index, kind, species, column
    names: list[tuple]
    examples: DataFrame  # genome, species, drug (index), fold, lower, upper, index, value
    models: dict[int, np.ndarray]
    history: list[dict]


def features(genomes: DataFrame, known: DataFrame, wide: DataFrame, columns: DataFrame) -> DataFrame:
    """(genome, index, value): log counts of known columns, 1 for wide columns of the genome's species and for the species itself.

    Columns that no model has are left out. columns is bounded, and sent to the tasks that read the long relations.
    """
    few = F.broadcast(columns)
    one = known.groupBy("genome", "column").agg(F.log1p(F.max("n").cast("double")).alias("value")).join(few.filter("kind = 'known'").select("column", "index"), "column").select("genome", "index", "value")
    placed = wide.select("genome", "column").distinct().join(genomes.select("genome", "species"), "genome")
    two = placed.join(few.filter("kind = 'wide'").select("species", "column", "index"), ["species", "column"]).select("genome", "index", F.lit(1.0).alias("value"))
    own = genomes.join(few.filter("kind = 'species'").select(F.col("column").alias("species"), "index"), "species").select("genome", "index", F.lit(1.0).alias("value"))
    long = one.unionByName(two).unionByName(own).filter("value <> 0")
    packed = long.groupBy("genome").agg(F.sort_array(F.collect_list(F.struct("index", "value"))).alias("p"))  # at most all columns
    return packed.select("genome", F.col("p.index").alias("index"), F.col("p.value").alias("value"))


def _written(df: DataFrame, label: str) -> DataFrame:
    """df as a table, read in shares by genome: what is made of it neither makes its rows again nor sorts many in one task."""
    table = materialise(df, label)
    return dealt(table, table.count(), "genome")


def cross_validate(data: Inputs, options: Options = Options()) -> Fitted:
    """ML4: a model without each fold, all in the same passes, then the final one for as many steps as they took in the median.

    Columns are chosen and weights fitted without the fold that a model is tested on. Labels with a null bound are not read.
    """
    spark = data.genomes.sparkSession
    data = replace(data, **{name: _written(getattr(data, name), name) for name in ("known", "wide", "labels")})
    drugs = [r.drug for r in data.labels.select("drug").filter("drug is not null").distinct().orderBy("drug").limit(MOST_COLUMNS).collect()]
    chosen = materialise(chosen_columns(data, options), "chosen")
    keys = ["kind", "species", "column"]
    every = chosen.select(*keys).distinct().orderBy(*keys).limit(MOST_COLUMNS + 1).collect()
    if len(every) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} columns chosen")
    names = [tuple(r) for r in every]
    at = {n: i for i, n in enumerate(names)}
    columns = materialise(spark.createDataFrame([(i, *n) for i, n in enumerate(names)], "index int, kind string, species string, column string"), "columns")
    number = F.broadcast(spark.createDataFrame(list(enumerate(drugs)), "i int, drug string"))
    labels = data.labels.filter("lower is not null and upper is not null").join(number, "drug").join(data.genomes, "genome").join(features(data.genomes, data.known, data.wide, columns), "genome", "left")
    null = lambda c, t: F.coalesce(c, F.array().cast(t)).alias(c)
    examples = materialise(labels.select("genome", "species", F.col("i").alias("drug"), F.col("fold").cast("int").alias("fold"), "lower", "upper", null("index", "array<int>"), null("value", "array<double>")), "examples")
    allowed: dict[int, np.ndarray] = {}
    held = chosen.join(F.broadcast(columns), (chosen.kind == columns.kind) & chosen.species.eqNullSafe(columns.species) & (chosen.column == columns.column)).select("held", "index")
    for r in held.groupBy("held").agg(F.collect_list("index").alias("i")).collect():  # each at most all columns
        allowed[r.held] = np.zeros((len(drugs), len(at)), bool)
        allowed[r.held][:, r.i] = True
    folds = sorted(r.fold for r in data.genomes.select("fold").distinct().collect())
    nothing = np.zeros((len(drugs), len(at)), bool)
    problems = [linear.Problem(f, allowed.get(f, nothing)) for f in folds]
    history = linear.fit(examples, problems, options.decay, options.rounds, patience=options.patience)
    steps = [sum(h["model"] == m for h in history) - (options.patience or 0) for m in range(len(problems))]
    last = linear.Problem(None, allowed.get(FINAL, nothing))
    linear.fit(examples, [last], options.decay, max(1, int(np.median(steps or [1]))) if options.patience else options.rounds)
    models = {p.held: p.weights for p in problems} | {FINAL: last.weights}
    return Fitted(drugs, columns, names, examples, models, history)


def out_of_fold(fitted: Fitted, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """ML5: every label's row as the model without its fold predicts it, with bands -> (predictions, half widths by pair)."""
    spark = fitted.examples.sparkSession
    scored = linear.predicted(fitted.examples, fitted.models, ["genome", "species", "drug", "fold", "lower", "upper"])
    names = F.broadcast(spark.createDataFrame(list(enumerate(fitted.drugs)), "drug int, name string"))
    scored = materialise(scored.join(names, "drug").drop("drug").withColumnRenamed("name", "drug"), "oof")
    exact = scored.filter((F.abs("lower") != F.lit(mic.INF)) & (F.abs("upper") != F.lit(mic.INF)))
    bands = conformal_fit(exact.withColumn("r", F.abs(F.col("mu") - F.col("upper"))), "species", "drug", "r", options.level, options.band_min_rows)
    return with_bands(scored, bands), bands


def with_bands(rows: DataFrame, bands: DataFrame) -> DataFrame:
    """rows (species, drug, mu) plus pred_mic, band_low and band_high, rounded up to steps; pairs without a band get width 1."""
    q = F.coalesce("q", F.lit(1.0))
    j = rows.join(bands.select("species", "drug", "q"), ["species", "drug"], "left")
    return j.withColumn("pred_mic", mic.round_up(F.col("mu"))).withColumn("band_low", mic.round_up(F.col("mu") - q)).withColumn("band_high", mic.round_up(F.col("mu") + q)).drop("q")


def model_table(fitted: Fitted, which: int = FINAL) -> DataFrame:
    """MODEL rows of a model: its weights that are not zero, its intercepts and log sigmas; what release() writes and predict() reads."""
    w = fitted.models[which]
    drug, place = np.nonzero(w)
    names = [*fitted.names, ("intercept", None, None), ("log_sigma", None, None)]
    kind, species, column = zip(*(names[p] for p in place), strict=True) if len(place) else ((), (), ())
    table = pa.table({"drug": [fitted.drugs[d] for d in drug], "kind": pa.array(kind, pa.string()), "species": pa.array(species, pa.string()), "column": pa.array(column, pa.string()), "weight": w[drug, place]})
    return fitted.examples.sparkSession.createDataFrame(table, MODEL)


def predict(model: DataFrame, bands: DataFrame, reportable: DataFrame, genomes: DataFrame, known: DataFrame, wide: DataFrame) -> DataFrame:
    """ML7: (genome, species, drug, mu, pred_mic, band_low, band_high) of new genomes for the drugs reportable (species, drug) for
    their species. Columns the model does not have are ignored, absent ones count as zero; a genome without any column is
    predicted by intercept and species.

    The long relations meet the model's weights by equi-joins and are summed by (genome, drug); nothing is made dense.
    """
    weight = lambda kind: model.filter(F.col("kind") == kind)
    one = known.groupBy("genome", "column").agg(F.log1p(F.max("n").cast("double")).alias("x")).join(weight("known").select("column", "drug", "weight"), "column").select("genome", "drug", (F.col("x") * F.col("weight")).alias("part"))
    placed = wide.select("genome", "column").distinct().join(genomes.select("genome", "species"), "genome")
    two = placed.join(weight("wide").select("species", "column", "drug", "weight"), ["species", "column"]).select("genome", "drug", F.col("weight").alias("part"))
    sums = one.unionByName(two).groupBy("genome", "drug").agg(F.sum("part").alias("part"))
    asked = genomes.select("genome", "species").join(reportable.select("species", "drug").distinct(), "species")
    base = weight("intercept").select("drug", F.col("weight").alias("base"))
    shift = weight("species").select(F.col("column").alias("species"), "drug", F.col("weight").alias("shift"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = asked.join(sums, ["genome", "drug"], "left").join(base, "drug", "left").join(shift, ["species", "drug"], "left")
    return with_bands(out.select("genome", "species", "drug", (zero("base") + zero("shift") + zero("part")).alias("mu")), bands)


def probabilities(oof: DataFrame, model: DataFrame, breakpoints: DataFrame) -> DataFrame:
    """PR33: rows whose laboratory category is known by breakpoints (species, drug, s, r), plus resistant and p_raw = P(MIC <= s)."""
    sigma = model.filter("kind = 'log_sigma'").select("drug", F.exp("weight").alias("sigma"))
    j = oof.join(breakpoints, ["species", "drug"]).join(sigma, "drug", "left")
    susceptible, resistant = F.col("upper") <= F.log2("s"), F.col("lower") >= F.log2("r")
    z = (F.log2("s") - F.col("mu")) / F.coalesce("sigma", F.lit(1.0))
    return j.filter(susceptible | resistant).withColumn("resistant", resistant).withColumn("p_raw", mic.normal_cdf(z)).drop("s", "r", "sigma")
