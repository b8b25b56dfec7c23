"""The driver's tables in the shape of the domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from susceptra.functions import mic


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def readings(spark: SparkSession, d: str) -> DataFrame:
    """events as laboratory readings with text values, as a raw file has them."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"), k.alias("k"))
    sign = F.element_at(F.array(*map(F.lit, ("=", "<=", "<", ">", ">="))), F.col("k") % 5 + 1)
    value = F.when(F.col("k") % 11 == 0, None).when(F.col("k") % 7 == 0, F.lit("1.5")).otherwise(F.element_at(F.array(*map(F.lit, ("0.25", "0.5", "1", "2"))), F.col("k") % 4 + 1))
    sir = F.when(F.col("k") % 3 == 0, "S").when(F.col("k") % 3 == 1, "R")
    return e.select(F.col("event_id").alias("rec_id"), F.col("user_id").alias("genome_id"), F.col("event_type").alias("drug"), "day", sign.alias("sign"), value.cast("string").alias("value"), sir.alias("sir"), F.when(F.col("k") % 6 == 0, "disk diffusion").otherwise("broth dilution").alias("method"))


READINGS_SQL = """k AS (SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS day, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events),
readings AS (SELECT event_id AS rec_id, user_id AS genome_id, event_type AS drug, day, (['=', '<=', '<', '>', '>='])[k % 5 + 1] AS sign,
  CASE WHEN k % 11 = 0 THEN NULL WHEN k % 7 = 0 THEN 1.5::DOUBLE ELSE ([0.25::DOUBLE, 0.5::DOUBLE, 1::DOUBLE, 2::DOUBLE])[k % 4 + 1] END AS v,
  CASE k % 3 WHEN 0 THEN 'S' WHEN 1 THEN 'R' END AS sir FROM k),
audited AS (SELECT *, CASE WHEN v IS NULL THEN 'unparseable_value' WHEN abs(v - pow(2::DOUBLE, round(log2(v)))) / pow(2::DOUBLE, round(log2(v))) > 0.05 THEN 'off_grid_value' END AS reason FROM readings),
intervals AS (SELECT *, CASE WHEN sign IN ('=', '>=') THEN v / 2 WHEN sign IN ('<=', '<') THEN 0 ELSE v END AS lower,
  CASE WHEN sign IN ('>', '>=') THEN 'infinity'::DOUBLE ELSE v END AS upper,
  sign || CASE v WHEN 0.25 THEN '0.25' WHEN 0.5 THEN '0.5' WHEN 1 THEN '1' WHEN 2 THEN '2' END AS raw FROM audited WHERE reason IS NULL),
g AS (SELECT genome_id, drug, day, count(*) AS n, max(lower) AS low, min(upper) AS high, arg_max(lower, struct_pack(a := lower, b := upper, c := -rec_id)) AS blow, arg_max(upper, struct_pack(a := lower, b := upper, c := -rec_id)) AS bup,
  coalesce(bool_or(sir = 'S'), false) AS has_s, coalesce(bool_or(sir = 'R'), false) AS has_r, list(raw ORDER BY rec_id) AS raws FROM intervals GROUP BY ALL),
resolved AS (SELECT genome_id, drug, day, CASE WHEN low < high THEN low ELSE blow END AS lower, CASE WHEN low < high THEN high ELSE bup END AS upper,
  CASE WHEN has_r THEN 'R' WHEN has_s THEN 'S' END AS sir, n, raws,
  CASE WHEN n = 1 THEN NULL WHEN has_s AND has_r THEN 'conflict_s_vs_r' WHEN low >= high AND log2(low / high) + 1 > 1 THEN 'conflict_gt_1_step' END AS reason FROM g)"""


def audited(spark: SparkSession, d: str) -> DataFrame:
    from susceptra.operators.relational import with_reason

    r = readings(spark, d).withColumn("v", mic.first_number(F.col("value"))).withColumn("step", mic.snap(F.col("v")))
    return with_reason(r, [(F.col("v").isNull(), "unparseable_value"), (F.col("step").isNull(), "off_grid_value")])


def intervals(spark: SparkSession, d: str) -> DataFrame:
    r = audited(spark, d).filter("reason is null").withColumn("i", mic.from_mic(mic.normal_sign(F.col("sign")), F.col("step")))
    return r.select("genome_id", "drug", "day", F.col("rec_id").alias("ord"), "i.lower", "i.upper", "sir", F.concat("sign", F.trim("value")).alias("raw"))


def preds(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as predictions with laboratory bounds."""
    q = F.col("l_quantity")
    step = F.pow(F.lit(2.0), F.floor(q / 10) - 2)
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", q.alias("q"), F.pow(F.lit(2.0), F.col("l_linenumber") - 3).alias("pred"), step.alias("step"))  # noqa: E741
    l = l.withColumn("lab_lower", F.when(F.col("q") % 5 == 0, 0.0).otherwise(F.col("step") / 2)).withColumn("lab_upper", F.when(F.col("q") % 7 == 0, F.lit(mic.INF)).otherwise(F.col("step")))  # noqa: E741
    l = l.withColumn("low", F.col("pred") / 2).withColumn("high", F.col("pred") * 2)  # noqa: E741
    s, r = F.lit(0.5), F.lit(2.0)
    l = l.withColumn("pred_sir", mic.sir_of_mic(F.col("pred"), s, r)).withColumn("lab_sir", F.when(F.col("lab_upper") <= s, "S").when(F.col("lab_lower") >= r, "R").otherwise("I"))  # noqa: E741
    return l.withColumn("p", (51 - F.col("q")) / 51).withColumn("resistant", (F.col("q") + F.col("l_linenumber") * 6) > 40)


PREDS_SQL = """l0 AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity AS q, pow(2::DOUBLE, l_linenumber - 3) AS pred, pow(2::DOUBLE, floor(l_quantity / 10) - 2) AS step FROM lineitem),
l1 AS (SELECT *, CASE WHEN q % 5 = 0 THEN 0::DOUBLE ELSE step / 2 END AS lab_lower, CASE WHEN q % 7 = 0 THEN 'infinity'::DOUBLE ELSE step END AS lab_upper, pred / 2 AS low, pred * 2 AS high FROM l0),
preds AS (SELECT *, CASE WHEN pred <= 0.5 THEN 'S' WHEN pred > 2 THEN 'R' ELSE 'I' END AS pred_sir, CASE WHEN lab_upper <= 0.5 THEN 'S' WHEN lab_lower >= 2 THEN 'R' ELSE 'I' END AS lab_sir,
  (51::DOUBLE - q) / 51::DOUBLE AS p, q + l_linenumber * 6 > 40 AS resistant FROM l1)"""


def hits(spark: SparkSession, d: str) -> DataFrame:
    o, l, p = (table(spark, d, n) for n in ("orders", "lineitem", "part"))  # noqa: E741
    j = l.select("l_orderkey", "l_partkey").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return j.select(F.col("o_custkey").alias("genome_id"), F.col("p_name").alias("symbol"), F.col("p_type").alias("class"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))


HITS_SQL = "hits AS (SELECT o_custkey AS genome_id, p_name AS symbol, p_type AS class, p_brand AS brand, p_size AS size FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"

#: (drug, standard, effective_year, s, r): small versioned table for the as-of queries.
BREAKPOINTS = [("R", "CLSI", 1992, 8.0, 16.0), ("R", "CLSI", 1995, 4.0, 16.0), ("A", "CLSI", 1993, 2.0, 8.0), ("A", "CLSI", 1997, 2.0, 8.0), ("N", "CLSI", 1992, 1.0, 4.0), ("N", "EUCAST", 1994, 1.0, 2.0), ("A", "EUCAST", 1996, 1.0, 4.0), ("N", "CLSI", 1996, 1.0, 4.0)]
BREAKPOINTS_SQL = "breakpoints(drug, standard, effective_year, s, r) AS (VALUES " + ", ".join(f"('{a}', '{b}', {c}, {s}::DOUBLE, {r}::DOUBLE)" for a, b, c, s, r in BREAKPOINTS) + ")"


def breakpoints(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BREAKPOINTS, "drug string, standard string, effective_year int, s double, r double")
