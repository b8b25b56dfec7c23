"""Queries that call the harmonising, validation, report and selection operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from susceptra.functions import mic
from susceptra.operators import harmonize, reports, validate
from susceptra.operators import relational as R
from susceptra.plans.bridge import table
from susceptra.plans.catalogue import query, r6, sql6

METHODS = ("Broth dilution", "Disk diffusion", "Etest", "unheard of")
SPECIES = {"Genus alpha": "ALPHA", "Genus beta": "BETA"}
VERSIONS = [("ALPHA", "view", "CLSI", 2019, 1.0, 4.0), ("ALPHA", "view", "CLSI", 2021, 0.5, 4.0), ("BETA", "view", "CLSI", 2019, 2.0, 8.0), ("BETA", "view", "CLSI", 2021, 2.0, 8.0), ("ALPHA", "click", "CLSI", 2020, 0.25, 0.5)]
VERSIONS_SQL = "versions(species, drug, standard, y, s, r) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {y}, {s}::DOUBLE, {r}::DOUBLE)" for a, b, c, y, s, r in VERSIONS) + ")"


def raw_results(spark, d):
    """events as the raw results of source A, and their metadata."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", k.alias("k"))
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (F.col("k") % by + 1).cast("int"))
    results = e.select(
        F.col("event_id").cast("string").alias("genome_id"), F.col("event_type").alias("antibiotic"), pick(("Resistant", " susceptible", "Intermediate", "?"), 4).alias("resistant_phenotype"),
        pick(("=", "<=", ">", "=="), 4).alias("measurement_sign"), pick(("0.25", "2", "", "1.5", "4"), 5).alias("measurement_value"), pick(("mg/L", "mm"), 2).alias("measurement_unit"),
        pick(METHODS, 4).alias("laboratory_typing_method"), pick(("CLSI", "clsi ", ""), 3).alias("testing_standard"),
        F.when(F.col("k") % 3 == 0, 2018 + F.col("k") % 4).cast("int").alias("testing_standard_year"), F.when(F.col("k") % 13 == 0, "Computational Method").otherwise("Laboratory Method").alias("evidence"),
    )
    meta = e.select(F.col("event_id").cast("string").alias("genome_id"), F.concat(F.lit("S"), (F.col("user_id") % 40).cast("string")).alias("biosample_accession"), F.when(F.col("k") % 2 == 0, "Genus alpha x").when(F.col("k") % 7 == 1, "Other").otherwise("genus BETA").alias("species"), (F.col("k") % 9).alias("contigs"))
    return results, meta


RAW_SQL = f"""k AS (SELECT event_id, user_id, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events),
{VERSIONS_SQL},
raw AS (SELECT event_id, user_id, k, event_type AS drug, (['R', 'S', 'I', NULL])[k % 4 + 1] AS sir, (['=', '<=', '>', '='])[k % 4 + 1] AS sign, ([0.25::DOUBLE, 2::DOUBLE, NULL, 1.5::DOUBLE, 4::DOUBLE])[k % 5 + 1] AS v,
  (['0.25', '2', '', '1.5', '4'])[k % 5 + 1] AS t, k % 2 = 0 AS unit_ok, (['dilution', 'disk', 'gradient', NULL])[k % 4 + 1] AS method, (['CLSI', 'CLSI', NULL])[k % 3 + 1] AS standard,
  CASE WHEN k % 3 = 0 THEN 2018 + k % 4 END AS year, k % 13 <> 0 AS lab, CASE WHEN k % 2 = 0 THEN 'ALPHA' WHEN k % 7 = 1 THEN NULL ELSE 'BETA' END AS species, 'S' || (user_id % 40) AS biosample, k % 9 AS contigs FROM k),
admitted AS (SELECT *, CASE WHEN NOT lab THEN 'not_lab_method' WHEN species IS NULL THEN 'species_out_of_scope' WHEN drug NOT IN ('view', 'click', 'purchase') THEN 'drug_not_in_panel' WHEN method IS NULL THEN 'unknown_method' END AS reason FROM raw)"""
DRUGS = {"View": "view", "click": "click", "purchase": "purchase"}


def admitted(spark, d):
    results, meta = raw_results(spark, d)
    return harmonize.admitted(harmonize.source_a(results, meta), SPECIES, DRUGS)


@query(f"WITH {RAW_SQL} SELECT coalesce(reason, 'kept') AS reason, drug, count(*) AS n FROM admitted GROUP BY ALL")
def standardise_and_admit(spark, d):
    """PR1, PR2, PR3, PR4, PR5, PR6: source A in the common layout, the first reason of every rejected row."""
    return admitted(spark, d).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason"), F.col("antibiotic").alias("drug")).agg(F.count(F.lit(1)).alias("n"))


_ROUTED_SQL = f"""{RAW_SQL},
b AS (SELECT a.*, method IN ('dilution', 'gradient') AND t <> '' AS by_mic, (SELECT max(y) FROM versions v WHERE v.species = a.species AND v.drug = a.drug AND v.standard = a.standard AND v.y <= a.year) AS in_force,
  pow(2::DOUBLE, round(log2(v))) AS p FROM admitted a WHERE reason IS NULL),
agreed AS (SELECT species, drug, standard, max(s) AS s, max(r) AS r FROM versions GROUP BY ALL HAVING count(DISTINCT (s, r)) = 1 AND min(y) = 2019),
j AS (SELECT b.*, CASE WHEN year IS NULL THEN g.s ELSE v.s END AS s, CASE WHEN year IS NULL THEN g.r ELSE v.r END AS r, CASE WHEN abs(v - p) / p <= 0.05 THEN p END AS step
  FROM (SELECT * FROM b) b LEFT JOIN agreed g USING (species, drug, standard) LEFT JOIN versions v ON v.species = b.species AND v.drug = b.drug AND v.standard = b.standard AND v.y = b.in_force),
i AS (SELECT *, CASE WHEN by_mic THEN CASE sign WHEN '=' THEN step / 2 WHEN '<=' THEN 0 ELSE step END ELSE CASE WHEN sir = 'S' AND s IS NOT NULL THEN 0 WHEN sir = 'R' THEN r WHEN sir = 'I' AND s < r THEN s END END AS lower,
  CASE WHEN by_mic THEN CASE WHEN sign = '>' AND step IS NOT NULL THEN -1 ELSE step END ELSE CASE WHEN sir = 'S' THEN s WHEN sir = 'R' AND r IS NOT NULL THEN -1 WHEN sir = 'I' AND s < r THEN r END END AS upper FROM j)
SELECT drug, CASE WHEN by_mic AND NOT unit_ok THEN 'bad_unit' WHEN by_mic AND step IS NULL THEN 'off_grid_value' WHEN by_mic THEN 'kept' WHEN sir IS NULL THEN 'no_value_no_phenotype' WHEN standard IS NULL THEN 'no_standard_for_sir_only' WHEN lower IS NULL THEN 'no_breakpoint' ELSE 'kept' END AS reason,
  CASE WHEN by_mic THEN sign || t ELSE sir END AS raw_result, CASE WHEN by_mic AND step IS NULL THEN NULL ELSE lower END AS mic_lower, CASE WHEN by_mic AND step IS NULL THEN NULL ELSE upper END AS mic_upper, count(*) AS n FROM i GROUP BY ALL"""


@query(f"WITH {_ROUTED_SQL}".replace("abs(v - p)", "abs(b.v - p)"))
def route_mic_or_category(spark, d):
    """PR9 to PR16, JN7, JN8: both paths in one pass; disk results go by category and breakpoint."""
    versions = spark.createDataFrame(VERSIONS, "species string, drug string, standard string, effective_year int, s double, r double")
    out = harmonize.routed(admitted(spark, d).filter("reason is null").drop("reason"), versions)
    upper = F.when(F.col("mic_upper") == mic.INF, -1.0).otherwise(F.col("mic_upper"))
    return out.groupBy("drug", F.coalesce("reason", F.lit("kept")).alias("reason"), "raw_result", "mic_lower", upper.alias("mic_upper")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {RAW_SQL}, m AS (SELECT biosample, CAST(arg_min(event_id, struct_pack(a := contigs, b := CAST(event_id AS VARCHAR))) AS VARCHAR) AS c FROM raw GROUP BY biosample),
g AS (SELECT event_id, c AS genome_id, species FROM admitted JOIN m USING (biosample) WHERE reason IS NULL), n AS (SELECT genome_id FROM g GROUP BY genome_id HAVING count(DISTINCT species) > 1)
SELECT genome_id, CASE WHEN genome_id IN (SELECT genome_id FROM n) THEN 'species_conflict' ELSE 'kept' END AS reason, count(*) AS n FROM g GROUP BY ALL""")
def canonical_genome_ids(spark, d):
    """PR17, AG5, AG6: rows by the canonical genome of their biosample."""
    out = harmonize.genome_ids(admitted(spark, d).filter("reason is null").drop("reason"), raw_results(spark, d)[1])
    return out.groupBy("genome_id", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_custkey, string_agg(o_orderstatus || CASE WHEN o_orderkey % 5 = 0 THEN '=POINT' WHEN o_orderkey % 5 = 1 THEN '=MISTRANSLATION' WHEN o_orderkey % 5 = 2 THEN '=PARTIAL_END_OF_CONTIG' WHEN o_orderkey % 5 = 3 THEN '=PARTIAL' ELSE '' END, ',' ORDER BY o_orderkey) AS genotypes
FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY o_custkey""")
def genotype_strings(spark, d):
    """PR27, PR28."""
    k = F.col("o_orderkey")
    method = F.when(k % 5 == 1, "INTERNAL_STOP").when(k % 5 == 2, "PARTIAL_CONTIG_ENDX").when(k % 5 == 3, "PARTIALX").otherwise("EXACTX")
    h = table(spark, d, "orders").select("o_custkey", k.alias("ord"), F.col("o_orderstatus").alias("symbol"), F.when(k % 3 == 0, "STRESS").otherwise("AMR").alias("type"), F.when(k % 5 == 0, "POINT_DISRUPT").otherwise("AMR").alias("subtype"), method.alias("method"))
    return reports.genotype_string(h, "o_custkey")


@query("""WITH c AS (SELECT p_brand AS symbol, min(p_type) AS class FROM part WHERE p_partkey % 3 = 0 GROUP BY p_brand),
r AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand || '-' || p_size ELSE p_brand END AS symbol, p_brand FROM part)
SELECT p_partkey, r.symbol, coalesce(a.class, b.class) AS class FROM r LEFT JOIN c a ON a.symbol = r.symbol LEFT JOIN c b ON b.symbol = r.p_brand""")
def class_by_fallback_key(spark, d):
    """JN12."""
    p = table(spark, d, "part")
    rows = p.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string"))).otherwise(F.col("p_brand")).alias("symbol"))
    return reports.class_of_symbol(rows, p.filter("p_partkey % 3 = 0").select(F.col("p_brand").alias("symbol"), F.col("p_type").alias("class")))


@query("""WITH m AS (SELECT o_orderkey AS job, o_orderdate AS "at", 'memory' AS origin FROM orders WHERE o_orderkey % 2 = 0),
s AS (SELECT o_orderkey AS job, o_orderdate - INTERVAL 1 DAY AS "at", 'stored' AS origin FROM orders WHERE o_orderkey % 3 = 0)
SELECT * FROM (SELECT * FROM m UNION ALL SELECT * FROM s WHERE job NOT IN (SELECT job FROM m)) ORDER BY "at" DESC, job LIMIT 100""")
def recent_of_two_histories(spark, d):
    """JN18, SO3: a full join of two histories, memory first."""
    o = table(spark, d, "orders")
    m = o.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("job"), F.col("o_orderdate").alias("at"), F.lit("memory").alias("origin"))
    s = o.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("job"), (F.col("o_orderdate") - F.expr("INTERVAL 1 DAY")).alias("at"), F.lit("stored").alias("origin"))
    return reports.recent_of_two(m, s, "job", "at", 100)


@query("SELECT o_orderkey, o_orderstatus, l_linenumber FROM orders JOIN (SELECT l_orderkey AS o_orderkey, l_linenumber FROM lineitem) l USING (o_orderkey)")
def jobs_using_reports(spark, d):
    """JN19: SQL's USING."""
    table(spark, d, "orders").createOrReplaceTempView("susceptra_jobs")
    table(spark, d, "lineitem").selectExpr("l_orderkey AS o_orderkey", "l_linenumber").createOrReplaceTempView("susceptra_reports")
    return spark.sql("SELECT o_orderkey, o_orderstatus, l_linenumber FROM susceptra_jobs JOIN susceptra_reports USING (o_orderkey)")


_LABELS_SQL = """l AS (SELECT l_orderkey AS genome_id, l_linenumber AS drug, CASE WHEN l_quantity % 10 = 0 THEN NULL ELSE l_returnflag END AS species, l_quantity % 5 AS lower, l_quantity % 7 AS upper,
  CASE WHEN l_quantity % 5 = 0 AND l_quantity % 3 <> 0 THEN 'left' WHEN l_quantity % 11 = 0 THEN 'odd' ELSE 'interval' END AS censor FROM lineitem)"""


@query(f"""WITH {_LABELS_SQL}, v AS (SELECT 'null species' AS rule, count_if(species IS NULL) AS n FROM l UNION ALL SELECT 'lower not below upper', count_if(NOT lower < upper) FROM l
UNION ALL SELECT 'left is not lower 0', count_if((censor = 'left') <> (lower = 0)) FROM l UNION ALL SELECT 'unexpected censor', count_if(censor NOT IN ('interval', 'left', 'right')) FROM l
UNION ALL SELECT 'unexpected species', count_if(species NOT IN ('A', 'N')) FROM l
UNION ALL SELECT 'repeated key', count_if(c > 1) FROM (SELECT count(*) AS c FROM l GROUP BY genome_id, drug)) SELECT * FROM v WHERE n > 0""")
def label_acceptance(spark, d):
    """DQ1: every broken rule of the labels, in one pass."""
    q = F.col("l_quantity")
    species = F.when(q % 10 != 0, F.col("l_returnflag"))
    censor = F.when((q % 5 == 0) & (q % 3 != 0), "left").when(q % 11 == 0, "odd").otherwise("interval")
    none, year = F.lit(None).cast("string"), F.lit(None).cast("int")
    values = (F.col("l_orderkey"), none, species, F.col("l_linenumber"), q % 5, q % 7, censor, none, F.lit("=1"), F.lit("disk"), none, year, F.lit("NCBI"), none, none, year)
    labels = table(spark, d, "lineitem").select(*[v.alias(n) for v, n in zip(values, harmonize.LABELS, strict=True)])
    return validate.label_failures(labels, ("A", "N"))


@query("""WITH l AS (SELECT c_custkey % 900 AS id, c_acctbal AS lower, 500::DOUBLE AS upper, c_mktsegment AS species FROM customer),
v AS (SELECT 'inverted bounds' AS rule, count_if(NOT lower < upper) AS n FROM l UNION ALL SELECT 'unknown species', count_if(species NOT IN ('BUILDING', 'MACHINERY')) FROM l
UNION ALL SELECT 'repeated key', count_if(c > 1) FROM (SELECT count(*) AS c FROM l GROUP BY id, species) UNION ALL SELECT 'several species', count_if(c > 1) FROM (SELECT count(DISTINCT species) AS c FROM l GROUP BY id)) SELECT * FROM v WHERE n > 0""")
def matrix_guards(spark, d):
    """DQ9."""
    m = table(spark, d, "customer").select((F.col("c_custkey") % 900).alias("genome_id"), F.col("c_mktsegment").alias("drug"), F.col("c_acctbal").alias("mic_lower"), F.lit(500.0).alias("mic_upper"), F.col("c_mktsegment").alias("species"))
    return validate.matrix_failures(m, ("BUILDING", "MACHINERY"))


@query("""WITH q AS (SELECT c_custkey % 1400 AS id, c_custkey % 100 - 1 AS n, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_acctbal > 0 END AS pass, CASE WHEN c_acctbal > 10 THEN NULL ELSE 'x' END AS reason FROM customer),
v AS (SELECT 'null qc_pass' AS rule, count_if(pass IS NULL) AS n FROM q UNION ALL SELECT 'reason does not match qc_pass', count_if(pass <> (reason IS NULL)) FROM q
UNION ALL SELECT 'negative n_contigs', count_if(n < 0) FROM q UNION ALL SELECT 'repeated key', count_if(c > 1) FROM (SELECT count(*) AS c FROM q GROUP BY id)) SELECT * FROM v WHERE n > 0""")
def qc_acceptance(spark, d):
    """DQ2."""
    k, b = F.col("c_custkey"), F.col("c_acctbal")
    values = (k % 1400, k % 100 - 1, b, b, b, F.col("c_mktsegment"), b, F.when(k % 17 != 0, b > 0), F.when(~(b > 10), "x"))
    return validate.qc_failures(table(spark, d, "customer").select(*[v.alias(n) for v, n in zip(values, validate.QC_COLUMNS, strict=True)]))


@query("""WITH r AS (SELECT c_custkey, c_custkey % 700 AS n, c_acctbal AS total, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_mktsegment END AS species, CASE WHEN c_custkey % 4 > 0 THEN (c_custkey % 13) / 200::DOUBLE END AS dist FROM customer)
SELECT c_custkey, CASE WHEN n = 0 THEN 'empty_assembly' ELSE nullif(concat_ws(';', CASE WHEN n > 500 THEN 'too_fragmented' END, CASE WHEN species IS NULL THEN 'species_not_covered' WHEN abs(total / 5000 - 1) > 0.2 THEN 'wrong_genome_size' END,
  CASE WHEN species IS NOT NULL AND dist > 0.05 THEN 'too_distant' END), '') END AS qc_fail_reason FROM r""")
def single_genome_qc(spark, d):
    """DQ4."""
    k = F.col("c_custkey")
    species = F.when(k % 6 != 0, F.col("c_mktsegment"))
    r = table(spark, d, "customer").select("c_custkey", (k % 700).alias("n_contigs"), F.col("c_acctbal").alias("total_length"), species.alias("species"), F.when(species.isNotNull(), 5000.0).alias("expected"), F.when(k % 4 > 0, (k % 13) / 200).alias("distance"))
    return validate.genome_qc(r).select("c_custkey", "qc_fail_reason")


@query("""WITH x AS (SELECT l_orderkey AS k, l_linenumber AS ord, l_returnflag AS reference, l_discount AS distance FROM lineitem), b AS (SELECT k, arg_min(reference, struct_pack(a := distance, b := ord, c := reference)) AS reference, min(distance) AS distance FROM x GROUP BY k)
SELECT k, CASE WHEN distance <= 0.05 THEN reference END AS reference, distance FROM b""")
def species_identified(spark, d):
    """DQ5: nearest reference within 0.05, the first line on ties."""
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ord"), F.col("l_returnflag").alias("reference"), F.col("l_discount").alias("distance"))
    return validate.identified(x, "k")


@query("""WITH n AS (SELECT l_orderkey AS k, min(l_tax) AS nearest FROM lineitem WHERE l_linenumber > 2 GROUP BY ALL), g AS (SELECT o_orderkey AS k, o_orderkey % 4 <> 0 AS checked FROM orders)
SELECT g.k, checked, CASE WHEN checked THEN nearest END AS nearest, NOT checked OR coalesce(nearest <= 0.02, false) AS in_range FROM g LEFT JOIN n USING (k)""")
def novelty_check(spark, d):
    """DQ6."""
    g = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 4 != 0).alias("checked"))
    return validate.novelty(g, table(spark, d, "lineitem").filter("l_linenumber > 2").select(F.col("l_orderkey").alias("k"), F.col("l_tax").alias("distance")), "k")


def _report_rows(spark, d):
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    call = F.when(q % 3 == 0, "likely_active").when(q % 3 == 1, "likely_inactive").otherwise("uncertain")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("k"), n.alias("drug"), F.when(q % 9 > 0, q).alias("pred_mic"), (q - q % 4).alias("band_low"), (q + q % 5 - 1).alias("band_high"), (q % 8).alias("s_breakpoint"), (q % 11 + 1).alias("r_breakpoint"),
        F.when(q % 6 > 0, q / 60).alias("p_active"), F.when(q % 6 > 1, "level").alias("confidence_level"), call.alias("call"), F.array("l_returnflag").alias("reasons"), (q % 4).cast("int").alias("margin_steps"), F.when(q % 2 == 0, 1).alias("rank"),
    )


@query("""WITH r AS (SELECT l_quantity AS q, CASE WHEN l_quantity % 9 > 0 THEN l_quantity END AS p, l_quantity - l_quantity % 4 AS lo, l_quantity + l_quantity % 5 - 1 AS hi FROM lineitem),
v AS (SELECT 'mic fields set in part' AS rule, count_if(p IS NULL) AS n FROM r UNION ALL SELECT 'mic outside its band', count_if(p IS NOT NULL AND NOT (lo <= p AND p <= hi)) FROM r
UNION ALL SELECT 'breakpoints out of order', count_if(q % 8 > q % 11 + 1) FROM r UNION ALL SELECT 'probability without level', count_if((q % 6 > 0) <> (q % 6 > 1)) FROM r
UNION ALL SELECT 'ranked but not active', count_if(q % 2 = 0 AND q % 3 <> 0) FROM r) SELECT * FROM v WHERE n > 0""")
def report_invariants(spark, d):
    """DQ7."""
    return validate.report_failures(_report_rows(spark, d).withColumn("override", F.lit(None).cast("string")))


@query("""SELECT l_orderkey AS k, l_linenumber AS drug, CASE WHEN l_orderkey % 5 = 0 AND l_linenumber = 1 OR l_quantity % 9 = 0 THEN NULL ELSE l_quantity END AS pred_mic,
  CASE WHEN l_orderkey % 5 <= 1 AND l_linenumber = 1 THEN 'likely_inactive' WHEN l_quantity % 3 = 0 THEN 'likely_active' WHEN l_quantity % 3 = 1 THEN 'likely_inactive' ELSE 'uncertain' END AS call,
  CASE WHEN l_orderkey % 5 <= 1 AND l_linenumber = 1 THEN NULL ELSE CAST(l_quantity % 4 AS INTEGER) END AS margin_steps, CASE WHEN l_orderkey % 5 = 1 AND l_linenumber = 1 THEN 'a,b' ELSE 'model' END AS reasons FROM lineitem""")
def report_overrides(spark, d):
    """PR36."""
    rows = _report_rows(spark, d).withColumn("reasons", F.array(F.lit("model")))
    kind = F.when(F.col("o_orderkey") % 5 == 0, "natural_resistance").otherwise("strong_marker")
    over = table(spark, d, "orders").filter("o_orderkey % 5 <= 1").select(F.col("o_orderkey").alias("k"), F.lit(1).alias("drug"), kind.alias("kind"), F.array(F.lit("b"), F.lit("a"), F.lit("b")).alias("markers"))
    return reports.with_overrides(rows, over, ["k", "drug"]).select("k", "drug", "pred_mic", "call", "margin_steps", F.array_join("reasons", ",").alias("reasons"))


@query("""SELECT l_orderkey AS k, count_if(l_quantity % 3 = 0) AS n_active, count_if(l_quantity % 3 = 1) AS n_inactive, count_if(l_quantity % 3 = 2) AS n_uncertain, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS markers FROM lineitem GROUP BY l_orderkey""")
def report_summaries(spark, d):
    """AG37."""
    return reports.report_summary(_report_rows(spark, d), "k")


@query("SELECT c_mktsegment, c_nationkey, count_if(c_custkey % 3 = 0) AS n_r, count_if(c_custkey % 3 = 1) AS n_s, count_if(c_custkey % 7 = 100) AS n_i FROM customer GROUP BY ALL")
def class_balance(spark, d):
    """AG14, AG28: zero cells stay."""
    sir = F.when(F.col("c_custkey") % 3 == 0, "R").when(F.col("c_custkey") % 3 == 1, "S")
    return reports.label_counts(table(spark, d, "customer").withColumn("sir", sir), ["c_mktsegment", "c_nationkey"], "sir", ["R", "S", "I"])


@query("""WITH r AS (SELECT o_orderkey AS u, o_custkey % 60 AS c, CASE WHEN o_custkey % 60 < 10 THEN 'test' ELSE 'train' END AS split, CASE WHEN o_custkey % 60 >= 10 THEN CASE WHEN o_orderkey % 500 = 0 THEN 9 ELSE o_custkey % 60 % 5 END END AS fold FROM orders)
SELECT 'cluster in several splits' AS rule, count(*) AS n FROM (SELECT c FROM r GROUP BY c HAVING greatest(count(DISTINCT split), count(DISTINCT fold)) > 1) HAVING count(*) > 0""")
def leakage_checklist(spark, d):
    """AG13, EX6."""
    c = F.col("o_custkey") % 60
    fold = F.when(c >= 10, F.when(F.col("o_orderkey") % 500 == 0, 9).otherwise(c % 5))
    return validate.leakage_failures(table(spark, d, "orders").select(F.col("o_orderkey").alias("u"), c.alias("c"), F.when(c < 10, "test").otherwise("train").alias("split"), fold.alias("fold")), "u", "c")


_OBSERVED = "SELECT doc_id, text, CAST((doc_id % 9 + 2) * 10 AS INTEGER) AS p FROM documents WHERE text IS NOT NULL"


@query(f"""WITH s AS ({_OBSERVED}), o AS (SELECT doc_id, CAST((doc_id % 8 + 2) * 10 AS INTEGER) AS p, length(text) // 2 AS n, doc_id % 5 = 0 AS spoilt FROM documents WHERE doc_id % 3 > 0 AND text IS NOT NULL)
SELECT s.doc_id, s.p AS percent, CASE WHEN o.p IS NULL AND s.p NOT IN (20, 100) THEN 'session_starts_elsewhere' WHEN o.p IS NOT NULL AND spoilt THEN 'prefix_changed' WHEN o.p IS NOT NULL AND s.p <> o.p + 10 THEN 'not_the_next_step' WHEN o.p IS NOT NULL AND length(text) <= n THEN 'no_more_sequence' END AS reason
FROM s LEFT JOIN o USING (doc_id)""")
def incremental_steps(spark, d):
    """DQ10: each step extends exactly the prefix of the step before."""
    t = table(spark, d, "documents").filter("text is not null")
    steps = t.select(F.col("doc_id").alias("session"), F.lit("x").alias("species"), ((F.col("doc_id") % 9 + 2) * 10).cast("int").alias("percent"), F.col("text").alias("observed"))
    half = F.expr("length(text) div 2").cast("int")
    sha = F.when(F.col("doc_id") % 5 == 0, "spoilt").otherwise(F.sha2(F.substring(F.col("text"), F.lit(1), half), 256))
    states = t.filter("doc_id % 3 > 0").select(F.col("doc_id").alias("session"), F.lit("x").alias("species"), ((F.col("doc_id") % 8 + 2) * 10).cast("int").alias("percent"), half.alias("bases"), sha.alias("sha256"))
    return validate.step_failures(steps, states).select(F.col("session").alias("doc_id"), "percent", "reason")


_CAND_SQL = "c AS (SELECT l_orderkey AS k, l_linenumber AS c, l_discount * 10 AS containment, l_quantity / 50 AS coverage, 1 - l_tax AS identity, l_quantity / 25 AS ratio, l_linenumber % 3 AS clips, l_extendedprice AS target FROM lineitem)"
_SUPPORT_SQL = f"{_CAND_SQL}, s AS (SELECT *, 0.4::DOUBLE * containment + 0.4::DOUBLE * coverage + 0.2::DOUBLE * identity - 0.08::DOUBLE * abs(ln(ratio)) - 0.1::DOUBLE * clips AS support FROM c)"


def _candidates(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("c"), (F.col("l_discount") * 10).alias("containment"), (q / 50).alias("coverage"), (1 - F.col("l_tax")).alias("identity"), (q / 25).alias("length_ratio"), (F.col("l_linenumber") % 3).alias("clips"), F.col("l_extendedprice").alias("target"))


@query(f"WITH {_SUPPORT_SQL}, m AS (SELECT k, list_reverse_sort(list(support)) AS t FROM s GROUP BY k) SELECT k, {sql6('t[1]')} AS best, {sql6('t[1] - t[2]')} AS margin FROM m")
def support_margin(spark, d):
    """ML9, WN3."""
    m = reports.margins(reports.support_score(_candidates(spark, d)), "k", "support")
    return m.select("k", r6(F.col("best")).alias("best"), r6(F.col("margin")).alias("margin"))


@query(f"""WITH {_CAND_SQL} SELECT a.k, a.c AS a, b.c AS b, {sql6('a.containment - b.containment')} AS containment, {sql6('a.coverage - b.coverage')} AS coverage, CASE WHEN a.target > b.target THEN 1::DOUBLE ELSE 0::DOUBLE END AS label, {sql6('abs(a.target - b.target)')} AS weight
FROM c a JOIN c b ON a.k = b.k AND a.c < b.c AND a.target <> b.target""")
def pairwise_rank(spark, d):
    """ML11, JN20: the training pairs of the learned selector."""
    p = reports.pairwise_rank(_candidates(spark, d), "k", "c", ["containment", "coverage"], "target")
    return p.select("k", "a", "b", r6(F.col("containment")).alias("containment"), r6(F.col("coverage")).alias("coverage"), "label", r6(F.col("weight")).alias("weight"))


@query("SELECT o_orderkey, CAST(o_custkey AS BIGINT) + 2 AS matched, 1 AS substituted, 3 AS inserted, 2 AS deleted FROM orders")
def cs_decode(spark, d):
    """AG33: events of difference strings."""
    cs = F.concat(F.lit(":"), F.col("o_custkey").cast("string"), F.lit("*ac=AC+acg-tt"))
    e = reports.cs_events(cs)
    return table(spark, d, "orders").select("o_orderkey", e["matched"].cast("long").alias("matched"), e["substituted"].alias("substituted"), e["inserted"].alias("inserted"), e["deleted"].alias("deleted"))


@query("""WITH p AS (SELECT o_orderkey AS k, (o_orderkey % 101) / 100::DOUBLE AS p FROM orders), s AS (SELECT DISTINCT c_nationkey AS g, (c_custkey % 97) / 100::DOUBLE AS p FROM customer)
SELECT k, count(DISTINCT g) AS n_groups FROM p LEFT JOIN s ON abs(p.p - s.p) <= 0.05::DOUBLE GROUP BY k""")
def calibration_support(spark, d):
    """AG34."""
    p = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), ((F.col("o_orderkey") % 101) / F.lit(100.0)).alias("p"))
    return reports.calibration_support(p, table(spark, d, "customer").select(F.col("c_nationkey").alias("group"), ((F.col("c_custkey") % 97) / F.lit(100.0)).alias("p")), "k")


@query("""WITH y AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders ORDER BY 1 DESC LIMIT 2)
SELECT o_orderkey, year(o_orderdate) IN (SELECT y FROM y) AS holdout_time, o_orderpriority = '1-URGENT' AS holdout_country, o_orderstatus IN ('P') AS holdout_source FROM orders""")
def external_holdouts(spark, d):
    """EX3."""
    o = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), "o_orderpriority", "o_orderstatus")
    return reports.external_holdouts(o, "year", "o_orderpriority", "o_orderstatus", 2, ["1-URGENT"], ["P"]).select("o_orderkey", "holdout_time", "holdout_country", "holdout_source")


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN -1::DOUBLE ELSE {sql6('1::DOUBLE / 3')} END AS jaccard, CASE WHEN o_orderkey % 4 = 0 THEN 0::DOUBLE ELSE 2::DOUBLE END AS ratio FROM orders")
def history_features(spark, d):
    """ML12: two sets of two hashes that share one."""
    k = F.col("o_orderkey")
    new, guess = F.array(F.lit(7), F.lit(20)), F.when(k % 4 != 0, F.array(F.lit(7), F.lit(30)))
    h = reports.history(new, guess, F.lit(8.0), F.lit(4.0))
    return table(spark, d, "orders").select("o_orderkey", F.when(k % 4 == 0, h["jaccard"]).otherwise(r6(h["jaccard"])).alias("jaccard"), h["ratio"].alias("ratio"))


@query("SELECT c_custkey, " + sql6("ln(1 + c_custkey % 50)") + " AS x, " + sql6("ln(1 + c_nationkey)") + " AS y FROM customer")
def log_counts(spark, d):
    """PR38."""
    return table(spark, d, "customer").select("c_custkey", r6(F.log1p(F.col("c_custkey") % 50)).alias("x"), r6(F.log1p("c_nationkey")).alias("y"))


@query("SELECT l_orderkey, l_linenumber, pow(2::DOUBLE, ceil(log2(l_quantity) - 1e-9)) AS band_high, pow(2::DOUBLE, ceil(log2(l_quantity) - 2 - 1e-9)) AS band_low, pow(2::DOUBLE, ceil(log2(l_quantity) - 1 - 1e-9)) AS pred_mic FROM lineitem")
def prediction_bands(spark, d):
    """ML5, PR30: log2 predictions and half widths as steps, rounded up."""
    mu, half = F.log2("l_quantity") - 1, 1
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", mic.round_up(mu).alias("pred_mic"), mic.round_up(mu - half).alias("band_low"), mic.round_up(mu + half).alias("band_high"))


@query("""WITH u AS (SELECT doc_id % 20 AS genome, upper(text) AS t, length(text) AS l, doc_id FROM documents WHERE lang = 'en'),
c AS (SELECT *, l - length(replace(replace(t, 'G', ''), 'C', '')) AS strong, l - length(replace(replace(t, 'A', ''), 'T', '')) AS weak, sum(l) OVER (PARTITION BY genome ORDER BY l DESC, doc_id) AS upto, sum(l) OVER (PARTITION BY genome) AS whole FROM u)
SELECT genome, count(*) AS n_contigs, CAST(sum(l) AS BIGINT) AS total_length, """ + sql6("100::DOUBLE * sum(strong) / sum(strong + weak)") + """ AS gc_percent, max(CASE WHEN upto * 2 >= whole THEN l END) AS n50 FROM c GROUP BY genome""")
def assembly_stats(spark, d):
    """PR39, AG29: contigs, length, N50 and GC of the letters A, C, G and T, of genomes."""
    from susceptra.functions.sequence import count_of

    t = table(spark, d, "documents").filter("lang = 'en'").select((F.col("doc_id") % 20).alias("genome"), F.col("text").alias("t"), F.translate("text", "acgt", "ACGT").alias("s"))
    one = t.select("genome", F.length("t").alias("length"), (count_of(F.col("s"), "G") + count_of(F.col("s"), "C")).alias("gc"), (count_of(F.col("s"), "A") + count_of(F.col("s"), "T")).alias("at"))
    total = one.groupBy("genome").agg(F.count(F.lit(1)).alias("n_contigs"), F.sum("length").alias("total_length"), r6(100.0 * F.sum("gc") / F.sum(F.col("gc") + F.col("at"))).alias("gc_percent"))
    return total.join(R.n50(one, ["genome"], "length"), "genome")
