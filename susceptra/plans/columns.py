"""Queries on feature columns, empty cells, profiles and difference strings of whole sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from susceptra.functions import mic
from susceptra.operators import columns, reports
from susceptra.plans import bridge as B
from susceptra.plans.bridge import table
from susceptra.plans.catalogue import query, r6, sql6
from susceptra.plans.stateful import DNA_SQL, dna

_NAMED_SQL = "regexp_replace(regexp_replace(lower(brand), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g')"
_MAP_SQL = f"SELECT {{key}}{_NAMED_SQL} AS column_name, list_aggregate(list_sort(list_distinct(list(symbol))), 'string_agg', '|') AS source_symbol, arg_min(class, struct_pack(a := genome_id, b := symbol, c := class)) AS class, count(DISTINCT genome_id) AS n_genomes_present FROM hits GROUP BY {{by}}"


@query(f"WITH {B.HITS_SQL} {_MAP_SQL.format(key='', by='1')}")
def column_map_with_class(spark, d):
    """AG11, PR24: symbols, first class and genomes of each column."""
    return columns.column_map(B.hits(spark, d), mic.column_name("", F.col("brand")), "symbol", "class", "genome_id")


@query(f"""WITH {B.HITS_SQL}, m AS ({_MAP_SQL.format(key='genome_id % 3 AS part, ', by='1, 2')})
SELECT column_name, list_aggregate(list_sort(list_distinct(flatten(list(string_split(source_symbol, '|'))))), 'string_agg', '|') AS source_symbol, arg_min(class, part) AS class, CAST(sum(n_genomes_present) AS BIGINT) AS n_genomes_present FROM m GROUP BY 1""")
def column_maps_merged(spark, d):
    """AG12: the maps of three parts of the genomes as one."""
    hits = B.hits(spark, d)
    return columns.merge_column_maps([columns.column_map(hits.filter(F.col("genome_id") % 3 == i), mic.column_name("", F.col("brand")), "symbol", "class", "genome_id") for i in range(3)])


@query(f"""WITH {B.HITS_SQL}, h AS (SELECT genome_id % 7 AS genome, symbol FROM hits WHERE (genome_id % 7 + length(symbol)) % 3 < 2), p AS (SELECT symbol, count(DISTINCT genome) AS n, list_aggregate(list_sort(list_distinct(list(genome))), 'string_agg', ',') AS pattern FROM h GROUP BY 1)
SELECT min(symbol) AS first, string_agg(symbol, '|' ORDER BY symbol) AS members, n AS n_genomes FROM p WHERE n >= 0.2::DOUBLE * 7 AND n <= 0.99::DOUBLE * 7 GROUP BY pattern, n""")
def collapsed_patterns(spark, d):
    """EX2: symbols present in the same groups of genomes, with their members, within a frequency window."""
    h = B.hits(spark, d).filter((F.col("genome_id") % 7 + F.length("symbol")) % 3 < 2).select((F.col("genome_id") % 7).alias("genome"), "symbol")
    return columns.collapse_patterns(h, "genome", "symbol", 7, low=0.2).withColumn("members", F.array_join("members", "|"))


@query("""WITH l AS (SELECT c_mktsegment AS species, c_nationkey AS drug FROM customer WHERE (c_nationkey + length(c_mktsegment)) % 3 > 0), a AS (SELECT DISTINCT species FROM l), b AS (SELECT DISTINCT drug FROM l)
SELECT a.species, b.drug, count(l.drug) AS n_labels FROM a CROSS JOIN b LEFT JOIN l ON l.species = a.species AND l.drug = b.drug GROUP BY ALL""")
def label_counts_zero_cells(spark, d):
    """AG28: pairs that no label has are rows of zero."""
    rows = table(spark, d, "customer").filter((F.col("c_nationkey") + F.length("c_mktsegment")) % 3 > 0).select(F.col("c_mktsegment").alias("species"), F.col("c_nationkey").alias("drug"))
    return columns.label_counts_everywhere(rows, "species", "drug")


@query(f"""WITH p AS (SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS profile, avg(o_totalprice) AS v FROM orders GROUP BY 1), m AS (SELECT profile, median(v) AS baseline FROM p WHERE o_custkey % 5 > 0 GROUP BY 1)
SELECT o_custkey, o_custkey % 5 > 0 AS train, {sql6('v')} AS value, {sql6('baseline + 1e-9::DOUBLE')} AS baseline FROM p LEFT JOIN m USING (profile)""")
def profile_baseline(spark, d):
    """EX4, AG35: each customer beside the median of training customers of the same profile."""
    p = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("profile"), F.avg("o_totalprice").alias("value"))
    out = columns.same_profile_median(p.withColumn("train", F.col("o_custkey") % 5 > 0), "profile", "value", "train")
    return out.select("o_custkey", "train", r6(F.col("value")).alias("value"), r6(F.col("baseline") + 1e-9).alias("baseline"))


@query(f"""WITH s AS (SELECT doc_id, {DNA_SQL} AS s FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, length(s) AS n, length(s) // 8 AS a, doc_id % 2 = 0 AS fwd FROM s WHERE length(s) >= 80),
t AS (SELECT doc_id, p, (p < n // 4) OR (p >= 5 AND p < 5 + a) OR (p >= 6 + a AND p < 6 + 3 * a) OR (p >= 7 + 3 * a AND p < 7 + 4 * a) AS hit, p = 5 + a OR p = 6 + 3 * a AS edit FROM (SELECT *, unnest(range(n)) AS p FROM n)),
o AS (SELECT doc_id, n, fwd, a, unnest([0, a, a + 1, 2 * a + 1, 2 * a + 3, 3 * a + 3]) AS lo, unnest([a, a + 1, 2 * a + 1, 2 * a + 3, 3 * a + 3, 4 * a + 3]) AS hi, unnest([false, true, false, true, false, false]) AS edit FROM n),
r AS (SELECT doc_id, edit, CASE WHEN fwd THEN 3 + lo ELSE 3 + 4 * a + 3 - hi END AS lo, CASE WHEN fwd THEN 3 + hi ELSE 3 + 4 * a + 3 - lo END AS hi FROM o UNION ALL SELECT doc_id, false, 0, n // 4 FROM n),
q AS (SELECT doc_id, p, bool_or(NOT edit) AS hit, bool_or(edit) AS edit FROM (SELECT doc_id, edit, unnest(range(lo, hi)) AS p FROM r) GROUP BY ALL),
x AS (SELECT n.doc_id, n.n, (SELECT count(*) FROM t WHERE t.doc_id = n.doc_id AND hit AND NOT edit) AS tx, (SELECT count(*) FROM q WHERE q.doc_id = n.doc_id AND hit AND NOT edit) AS qx FROM n)
SELECT doc_id, {sql6('tx::DOUBLE / n')} AS recall, {sql6('qx::DOUBLE / n')} AS "precision", {sql6('2 * (tx::DOUBLE / n) * (qx::DOUBLE / n) / (tx::DOUBLE / n + qx::DOUBLE / n)')} AS f1 FROM x""")
def alignment_scores(spark, d):
    """AG33: recall, precision and F1 of every document's sequence from two alignments each, of which one has edits; half are reversed."""
    s = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", dna(F.col("text")).alias("target")).filter("length(target) >= 80")
    s = s.withColumn("n", F.length("target")).withColumn("a", F.expr("n DIV 8").cast("int"))
    text = F.col("a").cast("string")
    edited = F.concat(F.lit(":"), text, F.lit("*ag:"), text, F.lit("+cc:"), text, F.lit("-t:"), text)
    quarter = F.expr("n DIV 4").cast("int")
    part = lambda qs, qe, strand, ts, te, cs: F.struct(qs.alias("qs"), qe.alias("qe"), strand.alias("strand"), ts.alias("ts"), te.alias("te"), cs.alias("cs"))
    one = part(F.lit(3), 4 * F.col("a") + 6, F.when(F.col("doc_id") % 2 == 0, "+").otherwise("-"), F.lit(5), 4 * F.col("a") + 7, edited)
    two = part(F.lit(0), quarter, F.lit("+"), F.lit(0), quarter, F.concat(F.lit(":"), quarter.cast("string")))
    both = s.select("doc_id", "target", F.col("target").alias("query"), F.explode(F.array(one, two)).alias("p")).select("doc_id", "target", "query", "p.*")
    scores = reports.cs_decode(both, "doc_id")
    return scores.select("doc_id", *[r6(F.col(c)).alias(c) for c in ("recall", "precision", "f1")])


@query("""WITH h AS (SELECT DISTINCT o_custkey AS genome, p_name AS symbol FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE p_size % 3 > 0 AND p_brand <> 'Brand#7'), g AS (SELECT c_custkey AS genome, c_mktsegment AS species FROM customer),
m(species, drug, pattern) AS (VALUES ('BUILDING', 'A', '^red'), ('BUILDING', 'N', 'ring$'), ('MACHINERY', 'A', 'blue (bolt|ring)'), ('AUTOMOBILE', 'R', '^small')), b AS (SELECT genome, 'R' AS drug FROM g WHERE species IN ('AUTOMOBILE', 'FURNITURE')),
f AS (SELECT genome, drug, string_agg(DISTINCT symbol, ',' ORDER BY symbol) AS markers FROM h JOIN g USING (genome) JOIN m USING (species) WHERE regexp_matches(symbol, pattern) GROUP BY ALL)
SELECT genome, drug, 'natural_resistance' AS kind, '' AS markers FROM b UNION ALL SELECT genome, drug, 'strong_marker', markers FROM f WHERE (genome, drug) NOT IN (SELECT (genome, drug) FROM b)""")
def call_overrides(spark, d):
    """JN10: rules of species and drugs against every customer's parts; a third is of another type, one brand is broken."""
    o, l, p = (table(spark, d, n) for n in ("orders", "lineitem", "part"))  # noqa: E741
    found = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    hits = found.select(F.col("o_custkey").alias("genome"), F.col("p_name").alias("symbol"), F.when(F.col("p_size") % 3 > 0, "AMR").otherwise("STRESS").alias("type"), F.when(F.col("p_brand") == "Brand#7", "INTERNAL_STOP").otherwise("EXACTX").alias("method"), F.lit("AMR").alias("subtype"))
    genomes = table(spark, d, "customer").select(F.col("c_custkey").alias("genome"), F.col("c_mktsegment").alias("species"))
    markers = spark.createDataFrame([("BUILDING", "A", "^red"), ("BUILDING", "N", "ring$"), ("MACHINERY", "A", "blue (bolt|ring)"), ("AUTOMOBILE", "R", "^small")], "species string, drug string, pattern string")
    natural = spark.createDataFrame([("AUTOMOBILE", "R"), ("FURNITURE", "R")], "species string, drug string")
    return reports.overrides(genomes, natural, markers, hits).withColumn("markers", F.array_join("markers", ","))
