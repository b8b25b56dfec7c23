"""Queries of the fitting half: columns by fold, cross-validated models, their calls, and a released model's predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from susceptra.functions import mic
from susceptra.ml import calibration, crossval, selection
from susceptra.ml.crossval import Inputs, Options
from susceptra.plans import bridge as B
from susceptra.plans.bridge import table
from susceptra.plans.catalogue import query, r6, sql6
from susceptra.storage import dealt, materialise

DRUGS = ("A", "N", "R")
FOLDS = 5


def inputs(spark, d, reused: bool = False) -> Inputs:
    """Customers as genomes, their parts' names as known columns and brands with sizes as wide ones; labels follow the names, with noise.

    Where known columns and labels are both read, or labels twice, `reused` writes what both follow from.
    """
    genomes = table(spark, d, "customer").select(F.col("c_custkey").alias("genome"), F.col("c_mktsegment").alias("species"), (F.col("c_custkey") % FOLDS).cast("int").alias("fold"))
    lines = table(spark, d, "lineitem").count()
    hits = dealt(B.hits(spark, d), lines, "genome_id")
    known = hits.groupBy(F.col("genome_id").alias("genome"), F.concat(F.lit("gene_"), "symbol").alias("column")).agg(F.count(F.lit(1)).alias("n"))
    if reused:
        known = dealt(materialise(known, "known"), lines, "genome")
    wide = hits.select(F.col("genome_id").alias("genome"), F.concat_ws("/", "brand", F.col("size").cast("string")).alias("column")).distinct()
    number = lambda *x: F.conv(F.substring(F.md5(F.concat_ws("/", *x)), 1, 4), 16, 10).cast("long")
    drug = F.explode(F.array(*map(F.lit, DRUGS))).alias("drug")
    effects = known.select("genome", "column", drug).groupBy("genome", "drug").agg(F.sum(number("column", "drug") % 7 - 3).alias("thirds"))
    noise = number(F.col("genome").cast("string"), "drug") % 10
    step = F.floor((F.col("thirds") * 10 + noise) / 30.0).cast("double")
    labels = effects.withColumn("step", step).filter(number("drug", F.col("genome").cast("string")) % 10 > 0)
    lower = F.when(F.col("step") <= -4, -mic.INF).otherwise(F.least(F.col("step") - 1, F.lit(4.0)))
    upper = F.when(F.col("step") > 4, mic.INF).otherwise(F.greatest("step", F.lit(-4.0)))
    return Inputs(genomes, labels.select("genome", "drug", lower.alias("lower"), upper.alias("upper")), known, wide)


INPUTS_SQL = f"""{B.HITS_SQL},
g AS (SELECT c_custkey AS genome, c_mktsegment AS species, c_custkey % 5 AS fold FROM customer),
known AS (SELECT genome_id AS genome, 'gene_' || symbol AS col, count(*) AS n FROM hits GROUP BY ALL),
wide AS (SELECT DISTINCT genome_id AS genome, brand || '/' || size AS col FROM hits),
num AS (SELECT genome, drug, sum(('0x' || substr(md5(col || '/' || drug), 1, 4))::BIGINT % 7 - 3) AS thirds FROM known, (SELECT unnest(['A', 'N', 'R']) AS drug) GROUP BY ALL),
steps AS (SELECT genome, drug, floor((thirds * 10 + ('0x' || substr(md5(genome || '/' || drug), 1, 4))::BIGINT % 10)::DOUBLE / 30) AS step FROM num WHERE ('0x' || substr(md5(drug || '/' || genome), 1, 4))::BIGINT % 10 > 0),
t AS (SELECT genome, drug, CASE WHEN step > 4 THEN 4::DOUBLE ELSE greatest(step, -4::DOUBLE) END AS y FROM steps),
k AS (SELECT unnest([-1, 0, 1, 2, 3, 4]) AS held)"""


@query(f"WITH {INPUTS_SQL}, c AS (SELECT held, species, col, count(*) AS n FROM (SELECT DISTINCT genome, col FROM known) JOIN g USING (genome) JOIN k ON fold <> held GROUP BY ALL) SELECT held, col AS \"column\" FROM c GROUP BY ALL HAVING max(n) >= 25")
def known_columns_by_fold(spark, d):
    """ML6, AG26: columns that 25 genomes of some species have outside the held fold; -1 holds none out."""
    data = inputs(spark, d)
    return selection.frequent_by_fold(data.known, data.genomes, 25).select(F.col("held").cast("int").alias("held"), "column")


@query(f"""WITH {INPUTS_SQL},
sizes AS (SELECT held, species, count(*) AS size FROM g JOIN k ON fold <> held GROUP BY ALL),
counts AS (SELECT held, species, col, count(*) AS n FROM wide JOIN g USING (genome) JOIN k ON fold <> held GROUP BY ALL),
within AS (SELECT held, species, col FROM counts JOIN sizes USING (held, species) WHERE n >= 0.01::DOUBLE * size AND n <= 0.99::DOUBLE * size),
drugs AS (SELECT held, species, drug, count(*)::DOUBLE AS known, sum(y) AS sy, sum(y * y) AS syy FROM t JOIN g USING (genome) JOIN k ON fold <> held GROUP BY ALL HAVING count(*) >= 3),
cols AS (SELECT held, species, drug, col, count(*)::DOUBLE AS nx, sum(y) AS sxy FROM wide JOIN t USING (genome) JOIN g USING (genome) JOIN k ON fold <> held GROUP BY ALL),
best AS (SELECT held, species, col, max(round(abs(sxy - nx * sy / known) / ((sqrt(greatest(nx - nx * nx / known, 0)) + 1e-9::DOUBLE) * (sqrt(greatest(syy - sy * sy / known, 0)) + 1e-9::DOUBLE)), 9)) AS r FROM cols JOIN drugs USING (held, species, drug) GROUP BY ALL),
ranked AS (SELECT held, species, col, coalesce(r, 0) AS r, row_number() OVER (PARTITION BY held, species ORDER BY coalesce(r, 0) DESC, col) AS n FROM within LEFT JOIN best USING (held, species, col))
SELECT held, species, col AS "column", {sql6('r')} AS correlation FROM ranked WHERE n <= 200""")
def correlated_columns_by_fold(spark, d):
    """ML6, AG27: for each fold and species, of the columns within the frequency window the 200 that follow any drug most."""
    data = inputs(spark, d, reused=True)
    found = selection.correlated_by_fold(data.wide, data.genomes, crossval.proxies(data.labels), most=200)
    return found.select(F.col("held").cast("int").alias("held"), "species", "column", r6(F.col("correlation")).alias("correlation"))


#: Small enough for every round to take well under a second on test tables; the operator's defaults are the full sizes.
OPTIONS = Options(wide_most=50, rounds=25, patience=8)


def _fitted(spark, d):
    return crossval.cross_validate(inputs(spark, d, reused=True), OPTIONS)


@query()
def oof_predictions(spark, d):
    """ML1 to ML6, AG18, AG19: each label as the model without its fold predicts it; tests hold it against numpy."""
    predictions, _ = crossval.out_of_fold(_fitted(spark, d), OPTIONS)
    return predictions.select("genome", "species", "drug", "fold", "mu", "pred_mic", "band_low", "band_high", F.pow(F.lit(2.0), "lower").alias("lab_lower"), F.pow(F.lit(2.0), "upper").alias("lab_upper"))


@query()
def loo_refit_calls(spark, d):
    """AG20, AG22, AG23, AG25, PR33: out-of-fold probabilities, then curves and thresholds refitted without each fold, and the calls they make."""
    fitted = _fitted(spark, d)
    predictions, _ = crossval.out_of_fold(fitted, OPTIONS)
    limits = spark.createDataFrame([(x, 0.5, 2.0) for x in DRUGS], "drug string, s double, r double")
    breakpoints = table(spark, d, "customer").select(F.col("c_mktsegment").alias("species")).distinct().join(F.broadcast(limits))
    rows = crossval.probabilities(predictions, crossval.model_table(fitted), breakpoints)
    return calibration.calls_report(calibration.loo_calls(rows, ["species", "drug"], "fold", "p_raw", "resistant", min_class=5), ["species", "drug"], "resistant")


@query(f"""WITH {B.HITS_SQL},
g AS (SELECT c_custkey AS genome, c_mktsegment AS species FROM customer),
d AS (SELECT unnest(['A', 'N', 'R']) AS drug),
known AS (SELECT genome_id AS genome, 'gene_' || symbol AS col, count(*) AS n FROM hits GROUP BY ALL),
wide AS (SELECT DISTINCT genome_id AS genome, brand || '/' || size AS col FROM hits),
w AS (SELECT drug, col, (length(col) % 7 - 3)::DOUBLE / 8 AS weight FROM (SELECT DISTINCT col FROM known WHERE length(col) % 3 > 0), d),
v AS (SELECT DISTINCT drug, c_mktsegment AS species, p_brand || '/' || p_size AS col, CASE drug WHEN 'A' THEN 0.25::DOUBLE ELSE -0.125::DOUBLE END AS weight FROM part, customer, d WHERE p_size % 2 = 0 AND c_mktsegment < 'C'),
s AS (SELECT genome, drug, sum(part) AS part FROM (SELECT genome, drug, ln(1 + n) * weight AS part FROM known JOIN w USING (col) UNION ALL SELECT genome, drug, weight FROM wide JOIN g USING (genome) JOIN v USING (species, col)) GROUP BY ALL),
m AS (SELECT g.genome, species, drug, CASE drug WHEN 'A' THEN 0.5::DOUBLE WHEN 'N' THEN -1::DOUBLE ELSE 0::DOUBLE END + length(species) / 4::DOUBLE + coalesce(part, 0) AS mu
  FROM g CROSS JOIN d LEFT JOIN s USING (genome, drug) WHERE drug <> 'R' OR species < 'F')
SELECT genome, species, drug, {sql6('mu')} AS mu, pow(2::DOUBLE, ceil(mu + CASE drug WHEN 'A' THEN 1.5::DOUBLE ELSE 1::DOUBLE END - 1e-9::DOUBLE)) AS band_high FROM m""")
def score_released_model(spark, d):
    """ML7: a model table's predictions for all genomes, for the drugs reportable for their species."""
    data = inputs(spark, d)
    drugs = spark.createDataFrame([("A", 0.5, 0.25), ("N", -1.0, -0.125), ("R", 0.0, -0.125)], "drug string, base double, wide double")
    species = data.genomes.select("species").distinct()
    null = F.lit(None).cast("string")
    row = lambda df, kind, sp, col, weight: df.select("drug", F.lit(kind).alias("kind"), sp.alias("species"), col.alias("column"), weight.cast("double").alias("weight"))
    names = data.known.select("column").distinct().filter("length(column) % 3 > 0").join(F.broadcast(drugs))
    model = row(names, "known", null, F.col("column"), (F.length("column") % 7 - 3) / 8)
    combos = table(spark, d, "part").filter("p_size % 2 = 0").select(F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("column")).distinct().join(F.broadcast(species.filter("species < 'C'"))).join(F.broadcast(drugs))
    model = model.unionByName(row(combos, "wide", F.col("species"), F.col("column"), F.col("wide"))).unionByName(row(drugs, "intercept", null, null, F.col("base")))
    model = model.unionByName(row(species.join(F.broadcast(drugs)), "species", null, F.col("species"), F.length("species") / 4))
    reportable = species.join(F.broadcast(drugs.select("drug"))).filter("drug <> 'R' OR species < 'F'")
    bands = species.join(F.broadcast(drugs.select("drug"))).filter("drug = 'A'").withColumn("q", F.lit(1.5))
    out = crossval.predict(model, bands, reportable, data.genomes, data.known, data.wide)
    return out.select("genome", "species", "drug", r6(F.col("mu")).alias("mu"), "band_high")


@query(f"""WITH {B.PREDS_SQL},
x AS (SELECT l_returnflag AS pair, p AS x, count_if(NOT resistant)::DOUBLE AS s, count(*)::DOUBLE AS w FROM preds GROUP BY ALL),
e AS (SELECT pair FROM x GROUP BY 1 HAVING least(sum(s), sum(w) - sum(s)) >= 20),
c AS (SELECT pair, x, sum(s) OVER o AS s, sum(w) OVER o AS w, sum(s) OVER o - s AS s0, sum(w) OVER o - w AS w0 FROM x JOIN e USING (pair) WINDOW o AS (PARTITION BY pair ORDER BY x)),
lows AS (SELECT i.pair, i.x, j.x AS j, min((k.s - j.s0) / (k.w - j.w0)) AS m FROM c i JOIN c j ON j.pair = i.pair AND j.x <= i.x JOIN c k ON k.pair = i.pair AND k.x >= i.x GROUP BY ALL),
f AS (SELECT pair, x, {sql6('max(m)')} AS fitted FROM lows GROUP BY ALL),
n AS (SELECT *, lag(fitted) OVER (PARTITION BY pair ORDER BY x) AS a, lead(fitted) OVER (PARTITION BY pair ORDER BY x) AS b FROM f)
SELECT pair, {sql6('x')} AS x, fitted FROM n WHERE a IS DISTINCT FROM fitted OR b IS DISTINCT FROM fitted""")
def isotonic_fit(spark, d):
    """AG20: the ends of each pair's levels; in SQL by the greatest of the least means."""
    rows = B.preds(spark, d).select(F.col("l_returnflag").alias("pair"), "p", (~F.col("resistant")).cast("double").alias("y"))
    return calibration.isotonic_by_pair(rows, "pair", "p", "y").select("pair", r6(F.col("x")).alias("x"), r6(F.col("fitted")).alias("fitted"))
