"""Named queries on the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from susceptra.functions import mic, sequence
from susceptra.operators import containment
from susceptra.operators import relational as R
from susceptra.operators.components import connected_components
from susceptra.plans import bridge as B
from susceptra.plans.bridge import table
from susceptra.storage import dealt, materialise

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def r6(x: Column) -> Column:
    """Six decimals by floor, which both engines do alike."""
    return F.floor(x * 1e6 + 0.5) / 1e6


def sql6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


FINITE = "CASE WHEN upper = 'infinity'::DOUBLE THEN -1 ELSE upper END"


def finite(c: str) -> Column:
    return F.when(F.col(c) == mic.INF, -1.0).otherwise(F.col(c))


# labels ---------------------------------------------------------------------------------------------------------------

@query(f"WITH {B.READINGS_SQL} SELECT genome_id, drug, CAST(day AS VARCHAR) AS day, lower AS mic_lower, {FINITE} AS mic_upper, CASE WHEN lower = 0 THEN 'left' WHEN upper = 'infinity'::DOUBLE THEN 'right' ELSE 'interval' END AS censor, sir, n AS n_readings FROM resolved WHERE reason IS NULL")
def harmonize_labels(spark, d):
    """PR9-PR16, PR22, AG1: readings to one interval per key."""
    r = R.resolve_duplicates(B.intervals(spark, d), ["genome_id", "drug", "day"]).filter("reason is null")
    return r.select("genome_id", "drug", F.col("day").cast("string").alias("day"), F.col("lower").alias("mic_lower"), finite("upper").alias("mic_upper"), mic.censor(F.col("lower"), F.col("upper")).alias("censor"), "sir", F.col("n").alias("n_readings"))


@query(f"WITH {B.READINGS_SQL} SELECT coalesce(reason, 'kept') AS reason, drug, count(*) AS n FROM audited GROUP BY ALL")
def audit_drop_reasons(spark, d):
    """PR2, AG36."""
    return B.audited(spark, d).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason"), "drug").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {B.READINGS_SQL} SELECT genome_id, drug, CAST(day AS VARCHAR) AS day, reason, n FROM resolved WHERE reason IS NOT NULL")
def dedup_intervals_conflicts(spark, d):
    """AG1, AG2."""
    return R.resolve_duplicates(B.intervals(spark, d), ["genome_id", "drug", "day"]).filter("reason is not null").select("genome_id", "drug", F.col("day").cast("string").alias("day"), "reason", "n")


@query(f"WITH {B.READINGS_SQL}, c AS (SELECT drug, count(*) AS n_rows, count_if(sir = 'S') AS n_s, count_if(sir = 'I') AS n_i, count_if(sir = 'R') AS n_r, count_if(list_bool_and(list_transform(raws, lambda x: x LIKE '=%'))) AS n_exact, count_if(NOT list_bool_and(list_transform(raws, lambda x: x LIKE '=%'))) AS n_censored, count(DISTINCT CASE WHEN list_bool_and(list_transform(raws, lambda x: x LIKE '=%')) THEN upper END) AS n_distinct_mic FROM resolved WHERE reason IS NULL GROUP BY drug) SELECT *, n_i + n_r AS n_nonsusceptible, n_i + n_r >= 50 AND n_s >= 50 AND n_distinct_mic >= 4 AS kept FROM c")
def pair_counts_inclusion(spark, d):
    """AG3, AG4."""
    labels = R.resolve_duplicates(B.intervals(spark, d), ["genome_id", "drug", "day"]).filter("reason is null")
    out = R.pair_counts(labels, ["drug"])
    return out.select("drug", *[F.col(c).cast("long").alias(c) for c in ("n_rows", "n_s", "n_i", "n_r", "n_exact", "n_censored", "n_distinct_mic", "n_nonsusceptible")], "kept")


@query("SELECT l_orderkey, l_linenumber, l_quantity AS v, CASE WHEN abs(l_quantity - pow(2::DOUBLE, round(log2(l_quantity)))) / pow(2::DOUBLE, round(log2(l_quantity))) <= 0.05 THEN pow(2::DOUBLE, round(log2(l_quantity))) END AS step FROM lineitem")
def snap_to_grid(spark, d):
    """PR11, PR13."""
    v = mic.first_number(F.col("l_quantity").cast("string"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", v.alias("v"), mic.snap(v).alias("step"))


_KEYWORDS = (("the", "article"), ("der", "article"), ("que", "relative"), ("tion", "noun"))


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'the') THEN 'article' WHEN contains(lower(text), 'der') THEN 'article' WHEN contains(lower(text), 'que') THEN 'relative' WHEN contains(lower(text), 'tion') THEN 'noun' ELSE 'other' END AS class FROM documents WHERE text IS NOT NULL")
def first_keyword_class(spark, d):
    """PR6, PR7."""
    return table(spark, d, "documents").filter("text is not null").select("doc_id", mic.first_keyword(F.col("text"), _KEYWORDS, "other").alias("class"))


@query("SELECT p_partkey, regexp_replace(translate(lower(regexp_replace(p_name, '^\\s+|\\s+$', '', 'g')), '/ ', '--'), '-+', '-', 'g') AS alias, CASE WHEN lower(p_brand) NOT IN ('', 'na', 'unknown', 'brand#11') THEN p_brand END AS brand FROM part")
def alias_normalize(spark, d):
    """PR5, PR18."""
    brand = F.when(~F.lower("p_brand").isin("", "na", "unknown", "brand#11"), F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", mic.alias_key(F.col("p_name")).alias("alias"), brand.alias("brand"))


@query("SELECT o_orderkey, CAST(substr(CAST(o_orderdate AS VARCHAR), 1, 4) AS INTEGER) AS year, split_part(o_orderpriority || ':x', ':', 1) AS country FROM orders")
def year_country_extract(spark, d):
    """PR19, PR20."""
    return table(spark, d, "orders").select("o_orderkey", mic.year_of(F.col("o_orderdate").cast("string")).alias("year"), mic.country_of(F.concat("o_orderpriority", F.lit(":x"))).alias("country"))


@query("SELECT o_orderkey, CASE lower(o_orderstatus) WHEN 'o' THEN 'S' WHEN 'f' THEN 'R' END AS sir, CASE o_orderstatus WHEN 'O' THEN 0::DOUBLE WHEN 'F' THEN 8::DOUBLE END AS lower FROM orders")
def sir_intervals(spark, d):
    """PR8, PR15."""
    sir = mic.phenotype_sir(F.when(F.col("o_orderstatus") == "O", " Susceptible").when(F.col("o_orderstatus") == "F", "resistant ").otherwise("?"))
    return table(spark, d, "orders").select("o_orderkey", sir.alias("sir"), mic.from_sir(sir, F.lit(2.0), F.lit(8.0))["lower"].alias("lower"))


# joins ----------------------------------------------------------------------------------------------------------------

@query("SELECT o_custkey, count(DISTINCT o_orderpriority) AS n_species FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1")
def species_conflict(spark, d):
    """AG5."""
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderpriority").alias("n_species")).filter("n_species > 1")


@query("SELECT o_custkey, arg_min(o_orderkey, struct_pack(a := o_totalprice, b := o_orderkey)) AS first_order FROM orders GROUP BY 1")
def canonical_first_in_group(spark, d):
    """AG6, AG7."""
    return R.first_in_group(table(spark, d, "orders"), ["o_custkey"], F.col("o_totalprice").asc_nulls_last(), F.col("o_orderkey")).select("o_custkey", F.col("o_orderkey").alias("first_order"))


@query(f"WITH {B.BREAKPOINTS_SQL}, l AS (SELECT l_orderkey, l_linenumber, l_returnflag AS drug, CAST(year(l_shipdate) AS INTEGER) AS y FROM lineitem), v AS (SELECT *, lead(effective_year) OVER (PARTITION BY drug ORDER BY effective_year) AS valid_to FROM breakpoints WHERE standard = 'CLSI') SELECT l_orderkey, l_linenumber, l.drug, y, s, r FROM l LEFT JOIN v ON l.drug = v.drug AND y >= effective_year AND (valid_to IS NULL OR y < valid_to)")
def asof_breakpoint(spark, d):
    """JN7."""
    facts = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("drug"), F.year("l_shipdate").alias("y"))
    out = R.asof_backward(facts, B.breakpoints(spark).filter("standard = 'CLSI'").drop("standard"), ["drug"], "y")
    return out.select("l_orderkey", "l_linenumber", "drug", "y", "s", "r")


@query("""WITH breakpoints AS (SELECT DISTINCT l_suppkey AS drug, l_linestatus AS standard, year(l_shipdate) AS effective_year, CASE WHEN l_suppkey % 3 = 0 AND year(l_shipdate) % 2 = 0 THEN 2::DOUBLE ELSE 1::DOUBLE END AS s, 4::DOUBLE + l_suppkey % 2 AS r FROM lineitem WHERE (l_suppkey + year(l_shipdate)) % 4 > 0),
o AS (SELECT standard, min(effective_year) AS oldest FROM breakpoints GROUP BY 1), g AS (SELECT drug, standard, min(effective_year) AS first, count(DISTINCT (s, r)) AS n, max(s) AS s, max(r) AS r FROM breakpoints GROUP BY ALL) SELECT drug, standard, s, r FROM g JOIN o USING (standard) WHERE first = oldest AND n = 1""")
def consensus_breakpoint(spark, d):
    """JN8: editions that the lines name, of which some suppliers' disagree and some lack the oldest."""
    year, drug = F.year("l_shipdate"), F.col("l_suppkey")
    s = F.when((drug % 3 == 0) & (year % 2 == 0), 2.0).otherwise(1.0)
    lines = table(spark, d, "lineitem").filter((drug + year) % 4 > 0)
    versions = lines.select(drug.alias("drug"), F.col("l_linestatus").alias("standard"), year.alias("effective_year"), s.alias("s"), (4.0 + drug % 2).alias("r")).distinct()
    return R.consensus(versions, ["drug"])


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') GROUP BY 1")
def semi_kept_pairs(spark, d):
    """JN1, JN2, JN5."""
    kept = table(spark, d, "orders").filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(kept, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, 'no_order' AS reason FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def anti_unmatched(spark, d):
    """JN6."""
    orders = table(spark, d, "orders").filter("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(orders, "c_custkey", "left_anti").select("c_custkey", F.lit("no_order").alias("reason"))


@query("SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def left_zero_fill(spark, d):
    """JN3, JN4, JN13, JN14."""
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "customer").select("c_custkey").join(n, "c_custkey", "left").fillna(0, ["n"])


_RULES = [("Brand#1", "^a"), ("Brand#2", "e.*o"), ("Brand#3", "[0-9]$")]


@query("WITH rules(brand, pattern) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _RULES) + ") SELECT p_partkey, brand, pattern FROM part JOIN rules ON substr(p_brand, 1, 7) = brand AND regexp_matches(p_name, pattern)")
def regex_rule_join(spark, d):
    """JN10."""
    rules = spark.createDataFrame(_RULES, "brand string, pattern string")
    return table(spark, d, "part").join(rules, (F.substring("p_brand", 1, 7) == F.col("brand")) & F.expr("p_name rlike pattern")).select("p_partkey", "brand", "pattern")


@query("WITH c AS (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS class FROM part), r(class, word) AS (VALUES ('STEEL', 'Brand#1'), ('SMALL', NULL), ('economy', NULL), ('STANDARD', '3')) SELECT DISTINCT c.p_partkey, c.class FROM c JOIN r ON c.class = r.class JOIN part p ON p.p_partkey = c.p_partkey WHERE r.word IS NULL OR contains(p.p_brand, r.word)")
def class_containment_join(spark, d):
    """JN11."""
    rules = spark.createDataFrame([("STEEL", "Brand#1"), ("SMALL", None), ("economy", None), ("STANDARD", "3")], "class string, word string")
    c = table(spark, d, "part").select("p_partkey", "p_brand", F.explode(F.split("p_type", " ")).alias("class"))
    return c.join(rules, "class").filter("word is null or contains(p_brand, word)").select("p_partkey", "class").distinct()


@query("SELECT a.l_orderkey, a.l_linenumber AS left_line, b.l_linenumber AS right_line FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND b.l_shipdate BETWEEN a.l_shipdate AND a.l_shipdate + INTERVAL 30 DAY")
def range_join_overlap(spark, d):
    """JN16, JN17, JN20: equi-join on the order with the range as a residual."""
    a, b = table(spark, d, "lineitem").alias("a"), table(spark, d, "lineitem").alias("b")
    on = (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_linenumber") < F.col("b.l_linenumber")) & F.col("b.l_shipdate").between(F.col("a.l_shipdate"), F.col("a.l_shipdate") + F.expr("interval 30 days"))
    return a.join(b, on).select("a.l_orderkey", F.col("a.l_linenumber").alias("left_line"), F.col("b.l_linenumber").alias("right_line"))


@query("SELECT n_nationkey, r_name, n_name FROM nation JOIN region ON lower(r_name) = 'asia' AND n_regionkey = r_regionkey OR starts_with(lower(n_name), substr(lower(r_name), 1, 1) || 'r')")
def prefix_theta_join(spark, d):
    """JN9, PR4: region is a fixed small dimension, so the theta join is a broadcast loop."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    on = ((F.lower("r_name") == "asia") & (F.col("n_regionkey") == F.col("r_regionkey"))) | F.expr("startswith(lower(n_name), concat(substr(lower(r_name), 1, 1), 'r'))")
    return n.join(F.broadcast(r), on).select("n_nationkey", "r_name", "n_name")


# features -------------------------------------------------------------------------------------------------------------

_BRANDS = ["Brand#11", "Brand#12", "Brand#13", "Brand#21", "Brand#22"]


@query(f"WITH {B.HITS_SQL} SELECT genome_id, " + ", ".join(f"CAST(max(CASE WHEN brand = '{b}' THEN 1 ELSE 0 END) AS INTEGER) AS \"{b}\"" for b in _BRANDS) + " FROM hits GROUP BY 1")
def presence_pivot(spark, d):
    """AG9."""
    return R.presence_pivot(B.hits(spark, d), "genome_id", "brand", _BRANDS)


@query(f"WITH {B.HITS_SQL} SELECT genome_id, " + ", ".join(f"CAST(least(3, count_if(brand = '{b}')) AS INTEGER) AS \"{b}\"" for b in _BRANDS) + " FROM hits GROUP BY 1")
def class_count_pivot(spark, d):
    """AG10."""
    return R.presence_pivot(B.hits(spark, d), "genome_id", "brand", _BRANDS, counts=True, limit=3)


@query(f"WITH {B.HITS_SQL} SELECT regexp_replace(regexp_replace(lower(brand), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') AS column_name, list_aggregate(list_sort(list_distinct(list(class))), 'string_agg', '|') AS symbols, count(DISTINCT genome_id) AS n_genomes_present FROM hits GROUP BY 1")
def column_map(spark, d):
    """AG11, PR24."""
    return B.hits(spark, d).groupBy(mic.column_name("", F.col("brand")).alias("column_name")).agg(F.array_join(F.array_sort(F.collect_set("class")), "|").alias("symbols"), F.count_distinct("genome_id").alias("n_genomes_present"))


@query(f"WITH {B.HITS_SQL}, h AS (SELECT *, genome_id % 2 AS part FROM hits), m AS (SELECT part, brand, list_distinct(list(class)) AS s, count(DISTINCT genome_id) AS n FROM h GROUP BY ALL) SELECT brand, list_aggregate(list_sort(list_distinct(flatten(list(s)))), 'string_agg', '|') AS symbols, CAST(sum(n) AS BIGINT) AS n FROM m GROUP BY 1")
def column_map_merge(spark, d):
    """AG12."""
    parts = B.hits(spark, d).groupBy((F.col("genome_id") % 2).alias("part"), "brand").agg(F.array_join(F.collect_set("class"), "|").alias("s"), F.count_distinct("genome_id").alias("n"))
    return parts.groupBy("brand").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("s", r"\|"))))), "|").alias("symbols"), F.sum("n").alias("n"))


@query("SELECT n_nationkey AS id, n_name AS name, 0 AS region_only FROM nation UNION ALL SELECT r_regionkey, r_name, 1 FROM region")
def union_missing_columns(spark, d):
    """ST1, ST2."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(1).alias("region_only"))
    return n.unionByName(r, allowMissingColumns=True).fillna(0, ["region_only"])


@query("(SELECT 'both' AS side, * FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier)) UNION ALL (SELECT 'customer', * FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier))")
def set_intersect_except(spark, d):
    """ST3-ST5."""
    c, s = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.intersect(s).select(F.lit("both").alias("side"), "k").unionByName(c.subtract(s).select(F.lit("customer").alias("side"), "k"))


@query(f"WITH {B.HITS_SQL}, c AS (SELECT genome_id % 5 AS species, symbol, count(DISTINCT genome_id) AS n FROM hits GROUP BY ALL) SELECT symbol, max(n) AS most FROM c GROUP BY 1 HAVING max(n) >= 5")
def rare_feature_filter(spark, d):
    """AG26."""
    return R.frequent_columns(B.hits(spark, d).withColumn("species", F.col("genome_id") % 5), "species", "genome_id", "symbol", 5).withColumnRenamed("column", "symbol")


@query(f"WITH {B.HITS_SQL}, x AS (SELECT DISTINCT genome_id, brand FROM hits), n AS (SELECT count(*) AS n, sum(c_acctbal) AS sy, sum(c_acctbal * c_acctbal) AS syy FROM customer), s AS (SELECT brand, count(*) AS sx, sum(c_acctbal) AS sxy FROM x JOIN customer ON c_custkey = genome_id GROUP BY 1) SELECT brand, floor(abs((n * sxy - sx * sy) / sqrt((n * sx - sx * sx)::DOUBLE * (n * syy - sy * sy))) * 1e4 + 0.5) / 1e4 AS correlation FROM s, n")
def correlation_screen(spark, d):
    """AG27: sums over the sparse relation only; the totals are one row."""
    x = B.hits(spark, d).select("genome_id", "brand").distinct()
    c = table(spark, d, "customer")
    n = c.agg(F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("sy"), F.sum(F.col("c_acctbal") ** 2).alias("syy")).withColumn("one", F.lit(1))
    s = x.join(c, F.col("c_custkey") == F.col("genome_id")).groupBy("brand").agg(F.count(F.lit(1)).alias("sx"), F.sum("c_acctbal").alias("sxy")).withColumn("one", F.lit(1))
    r = F.abs((F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt((F.col("n") * F.col("sx") - F.col("sx") * F.col("sx")) * (F.col("n") * F.col("syy") - F.col("sy") * F.col("sy"))))
    return s.join(F.broadcast(n), "one").select("brand", (F.floor(r * 1e4 + 0.5) / 1e4).alias("correlation"))


# sequences and sketches -----------------------------------------------------------------------------------------------

@query("WITH g AS (SELECT source, n_chars, sum(n_chars) AS w FROM documents GROUP BY ALL), r AS (SELECT *, sum(w) OVER (PARTITION BY source ORDER BY n_chars DESC) AS upto, sum(w) OVER (PARTITION BY source) AS total FROM g) SELECT source, max(n_chars) AS n50 FROM r WHERE upto * 2 >= total GROUP BY 1")
def n50(spark, d):
    """AG29."""
    return R.n50(table(spark, d, "documents"), ["source"], "n_chars")


_FOLDED_SQL = "u AS (SELECT doc_id, translate(text, 'acgtn', 'ACGTN') AS t FROM documents)"


@query(f"""WITH {_FOLDED_SQL}, c AS (SELECT doc_id, length(t) - length(replace(t, 'G', '')) + length(t) - length(replace(t, 'C', '')) AS gc, length(t) * 4 - length(replace(t, 'G', '')) - length(replace(t, 'C', '')) - length(replace(t, 'A', '')) - length(replace(t, 'T', '')) AS n, t FROM u)
SELECT doc_id, CASE WHEN n > 0 THEN 100::DOUBLE * gc / n ELSE 0 END AS gc_percent, sha256(reverse(translate(t, 'ACGTN', 'TGCAN'))) AS rc_sha256 FROM c""")
def gc_like_ratio(spark, d):
    """PR39, PR40 of whole texts. The SQL's reverse keeps combined characters together, which these texts have none of."""
    u = F.translate("text", "acgtn", "ACGTN")
    return table(spark, d, "documents").select("doc_id", sequence.gc_percent(u).alias("gc_percent"), F.sha2(sequence.reverse_complement(u), 256).alias("rc_sha256"))


@query(f"WITH {_FOLDED_SQL} SELECT doc_id, CAST(length(t) AS BIGINT) AS rc_chars, sha256(reverse(translate(t, 'ACGTN', 'TGCAN'))) AS rc_sha256 FROM u")
def reverse_complement_whole(spark, d):
    """PR40 of whole texts: length and digest of the result."""
    rc = sequence.reverse_complement(F.translate("text", "acgtn", "ACGTN"))
    return table(spark, d, "documents").select("doc_id", F.length(rc).cast("long").alias("rc_chars"), F.sha2(rc, 256).alias("rc_sha256"))


@query("SELECT p_partkey, substr(p_name || p_name, p_partkey % length(p_name) + 1, CAST(floor(length(p_name) / 2) AS BIGINT)) AS piece FROM part")
def circular_pieces(spark, d):
    """PR41."""
    half = F.floor(F.length("p_name") / 2).cast("int")
    return table(spark, d, "part").select("p_partkey", sequence.circular_slice(F.col("p_name"), F.col("p_partkey").cast("int"), half).alias("piece"))


@query("WITH h AS (SELECT l_orderkey AS k, l_linenumber * 7 AS a, l_linenumber * 7 + CAST(l_quantity AS INTEGER) AS b, l_discount AS w FROM lineitem), p AS (SELECT DISTINCT k, unnest([a, b]) AS p FROM h), s AS (SELECT k, p, lead(p) OVER (PARTITION BY k ORDER BY p) AS q FROM p), m AS (SELECT s.k, s.p, s.q, max(w) AS w FROM s JOIN h ON s.k = h.k AND a <= s.p AND b >= s.q GROUP BY ALL) SELECT k, CAST(sum(q - p) AS BIGINT) AS covered, floor(sum((q - p) * w) * 1e6 + 0.5) / 1e6 AS weighted FROM m GROUP BY 1")
def interval_union_coverage(spark, d):
    """AG30."""
    lines = table(spark, d, "lineitem")
    h = lines.select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") * 7).alias("a"), (F.col("l_linenumber") * 7 + F.col("l_quantity").cast("int")).alias("b"), F.col("l_discount").alias("w"))
    h = dealt(h, lines.count(), "k")
    return R.interval_coverage(h, "k", "a", "b", "w").select("k", "covered", r6(F.col("weighted")).alias("weighted"))


_SKETCH = "w AS (SELECT doc_id, source, unnest(regexp_extract_all(lower(text), '[^ \\n]+')) AS w FROM documents), h AS (SELECT DISTINCT doc_id, source, substr(md5(w), 1, 12) AS h FROM w WHERE substr(md5(w), 1, 1) = '0')"


_CONTAINMENT_SQL = f"WITH {_SKETCH}, q AS (SELECT doc_id AS query_id, h FROM h WHERE doc_id % <every> = 0), n AS (SELECT query_id, count(*) AS n FROM q GROUP BY 1), m AS (SELECT query_id, h.doc_id, h.source, count(*) AS shared FROM q JOIN h ON q.h = h.h AND h.doc_id <> query_id GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY shared DESC, doc_id) AS r FROM m), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, doc_id) AS rank FROM b WHERE r = 1) SELECT query_id, doc_id, CAST(shared AS DOUBLE) / n AS containment, rank FROM k JOIN n USING (query_id) WHERE rank <= 5"


@query(_CONTAINMENT_SQL.replace("<every>", "100"))
def sketch_containment_topk(spark, d):
    """JN15, WN2, WN4, ST5: the documents of ids divisible by 100 ask, all answer; in sketch_containment_all all ask."""
    return _containment(spark, d, F.col("doc_id") % 100 == 0)


@query(_CONTAINMENT_SQL.replace("<every>", "1"))
def sketch_containment_all(spark, d):
    """JN15, WN2, WN4, ST5 for every document; tests hold it against plain Python as well."""
    return _containment(spark, d, F.lit(True))


def _containment(spark, d, asked):
    """Every 16th word's hash as a number; the best of each source, then the top five."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[^ \n]+"), F.lit(0)))
    marked = F.filter(F.transform(words, F.md5), lambda m: F.startswith(m, F.lit("0")))
    number = F.transform(marked, lambda m: F.conv(F.substring(m, 1, 12), 16, 10).cast("long"))
    rows = table(spark, d, "documents").select("doc_id", "source", number.alias("hashes")).filter("size(hashes) > 0")
    held = materialise(rows.groupBy("doc_id", "source").agg(F.array_distinct(F.flatten(F.collect_list("hashes"))).alias("hashes")), "word-hashes")
    own = held.filter(asked).groupBy(F.col("doc_id").alias("query_id")).agg(F.flatten(F.collect_list("hashes")).alias("hashes"))
    return containment.most_contained(own, held)


@query("SELECT sha256(text) AS hash, arg_max(doc_id, struct_pack(a := n_chars, b := -doc_id)) AS doc_id, count(*) AS n FROM documents GROUP BY 1")
def dedup_by_hash_best(spark, d):
    """AG31."""
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.max_by("doc_id", F.struct(F.col("n_chars"), -F.col("doc_id"))).alias("doc_id"), F.count(F.lit(1)).alias("n"))


# evaluation -----------------------------------------------------------------------------------------------------------

_AGREE = """SELECT {keys} count(*) AS n, count_if(lab_lower > 0 AND lab_upper < 'infinity'::DOUBLE) AS n_exact,
 {vme} AS vme, {me} AS me, {mine} AS mine, {cat} AS categorical, {ess} AS essential, {exact} AS exact, {cov} AS coverage, {width} AS width FROM preds {group}"""
_AGREE_PARTS = {
    "vme": sql6("avg(CASE WHEN lab_sir = 'R' THEN (pred_sir = 'S')::INTEGER END)"), "me": sql6("avg(CASE WHEN lab_sir = 'S' THEN (pred_sir = 'R')::INTEGER END)"),
    "mine": sql6("avg((pred_sir <> lab_sir AND (pred_sir = 'I' OR lab_sir = 'I'))::INTEGER)"), "cat": sql6("avg((pred_sir = lab_sir)::INTEGER)"),
    "ess": sql6("avg(CASE WHEN lab_lower > 0 AND lab_upper < 'infinity'::DOUBLE THEN (abs(log2(pred) - log2(lab_upper)) <= 1)::INTEGER END)"),
    "exact": sql6("avg(CASE WHEN lab_lower > 0 AND lab_upper < 'infinity'::DOUBLE THEN (abs(log2(pred) - log2(lab_upper)) < 1e-9)::INTEGER END)"),
    "cov": sql6("avg((high > lab_lower AND low <= lab_upper)::INTEGER)"), "width": sql6("avg(log2(high) - log2(low))"),
}
_RATES = ("vme", "me", "mine", "categorical", "essential", "exact", "coverage", "width")


@query(f"WITH {B.PREDS_SQL} " + _AGREE.format(keys="", group="", **_AGREE_PARTS))
def agreement_metrics(spark, d):
    """AG15."""
    out = R.agreement(B.preds(spark, d), [])
    return out.select("n", "n_exact", *[r6(F.col(c)).alias(c) for c in _RATES])


@query(f"WITH {B.PREDS_SQL} " + _AGREE.format(keys="l_returnflag, l_linestatus,", group="GROUP BY ALL", **_AGREE_PARTS))
def metrics_by_pair(spark, d):
    """AG17."""
    out = R.agreement(B.preds(spark, d), ["l_returnflag", "l_linestatus"])
    return out.select("l_returnflag", "l_linestatus", "n", "n_exact", *[r6(F.col(c)).alias(c) for c in _RATES])


@query(f"WITH {B.PREDS_SQL}, g AS (SELECT l_returnflag, q, count_if(resistant)::DOUBLE AS p, count_if(NOT resistant)::DOUBLE AS n FROM preds GROUP BY ALL), w AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY l_returnflag ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) SELECT l_returnflag, {sql6('sum(p * (below + n / 2)) / (sum(p) * sum(n))')} AS auroc FROM w GROUP BY 1")
def auroc(spark, d):
    """AG16."""
    return R.auroc(B.preds(spark, d).select("l_returnflag", F.col("q").alias("score"), "resistant"), ["l_returnflag"], "score", "resistant").select("l_returnflag", r6(F.col("auroc")).alias("auroc"))


_RES = f"{B.PREDS_SQL}, e AS (SELECT l_returnflag AS species, l_linenumber AS drug, abs(log2(pred) - log2(lab_upper)) AS r FROM preds WHERE lab_lower > 0 AND lab_upper < 'infinity'::DOUBLE)"


def _residuals(spark, d):
    return B.preds(spark, d).filter((F.col("lab_lower") > 0) & (F.col("lab_upper") < mic.INF)).select(F.col("l_returnflag").alias("species"), F.col("l_linenumber").alias("drug"), F.abs(F.log2("pred") - F.log2("lab_upper")).alias("r"))


@query(f"WITH {_RES} SELECT species, drug, list_sort(list(r))[CAST(least(ceil((count(*) + 1) * 0.9::DOUBLE), count(*)) AS BIGINT)] AS q, count(*) AS n FROM e GROUP BY ALL")
def conformal_quantile(spark, d):
    """AG18."""
    return R.conformal_quantile(_residuals(spark, d), ["species", "drug"], "r", 0.9)


@query(f"WITH {_RES}, p AS (SELECT species, drug, list_sort(list(r))[CAST(least(ceil((count(*) + 1) * 0.9::DOUBLE), count(*)) AS BIGINT)] AS q, count(*) AS n FROM e GROUP BY ALL), m AS (SELECT drug, list_sort(list(r))[CAST(least(ceil((count(*) + 1) * 0.9::DOUBLE), count(*)) AS BIGINT)] AS q, count(*) AS n FROM e GROUP BY ALL), a AS (SELECT list_sort(list(r))[CAST(least(ceil((count(*) + 1) * 0.9::DOUBLE), count(*)) AS BIGINT)] AS q FROM e) SELECT species, p.drug, CASE WHEN p.n >= 1500 THEN p.q WHEN m.n >= 2000 THEN m.q ELSE a.q END AS q, p.n AS n_exact, CASE WHEN p.n >= 1500 THEN 'pair' WHEN m.n >= 2000 THEN 'drug' ELSE 'global' END AS source FROM p JOIN m ON p.drug = m.drug, a".replace("1500", "500").replace("2000", "500"))
def conformal_fallback(spark, d):
    """AG19."""
    return R.conformal_fit(_residuals(spark, d), "species", "drug", "r", 0.9, 500)


@query(f"""WITH {B.PREDS_SQL}, t AS (SELECT l_returnflag AS species, count_if(resistant) AS nr, count_if(NOT resistant) AS ns FROM preds GROUP BY 1 HAVING count_if(resistant) >= 20 AND count_if(NOT resistant) >= 20),
g AS (SELECT species, nr, ns, i, i / 200::DOUBLE AS x FROM t, range(0, 201) AS r(i)),
c AS (SELECT g.species, g.nr, g.ns, g.i, g.x, (SELECT count(*) FROM preds p WHERE p.l_returnflag = g.species AND resistant AND floor(p.p * 200 + 1e-9) >= g.i) AS ra, (SELECT count(*) FROM preds p WHERE p.l_returnflag = g.species AND NOT resistant AND ceil(p.p * 200 - 1e-9) <= g.i) AS sb FROM g),
f AS (SELECT species, max(nr) AS n_resistant, max(ns) AS n_susceptible, coalesce(min(CASE WHEN ra <= 0.01::DOUBLE * nr THEN x END), 1.01::DOUBLE) AS a, coalesce(max(CASE WHEN sb <= 0.03::DOUBLE * ns THEN x END), -0.01::DOUBLE) AS b FROM c GROUP BY 1)
SELECT species, {sql6('CASE WHEN b >= a THEN (a + b) / 2 ELSE a END')} AS active_min, {sql6('CASE WHEN b >= a THEN (a + b) / 2 - 1e-9 ELSE b END')} AS inactive_max, n_resistant, n_susceptible FROM f""")
def threshold_grid(spark, d):
    """AG22."""
    t = R.thresholds(B.preds(spark, d).withColumnRenamed("l_returnflag", "species"), ["species"], "p", "resistant")
    return t.select("species", r6(F.col("active_min")).alias("active_min"), r6(F.col("inactive_max")).alias("inactive_max"), "n_resistant", "n_susceptible")


@query(f"""WITH {B.PREDS_SQL}, folds AS (SELECT *, l_orderkey % 5 AS fold FROM preds), k AS (SELECT unnest([0, 1, 2, 3, 4]) AS held),
t AS (SELECT held, l_returnflag, count_if(resistant) AS nr, {sql6('avg(CASE WHEN resistant THEN p END)')} AS mean_p FROM k JOIN folds ON fold <> held GROUP BY ALL) SELECT held, l_returnflag, nr, mean_p FROM t""")
def loo_fold_refit(spark, d):
    """AG25: each row goes to the four fits that do not hold it out, so one pass fits all folds."""
    rows = B.preds(spark, d).withColumn("held", F.explode(F.array_except(F.array(*map(F.lit, range(5))), F.array((F.col("l_orderkey") % 5).cast("int")))))
    return rows.groupBy("held", "l_returnflag").agg(F.count_if("resistant").alias("nr"), r6(F.avg(F.when(F.col("resistant"), F.col("p")))).alias("mean_p"))


_CURVE = [("R", 0.1, 0.05), ("R", 0.5, 0.4), ("R", 0.9, 0.95), ("A", 0.2, 0.1), ("A", 0.8, 0.9)]


@query(f"WITH {B.PREDS_SQL}, curve(sp, cx, cy) AS (VALUES " + ", ".join(f"('{a}', {x}::DOUBLE, {y}::DOUBLE)" for a, x, y in _CURVE) + f"), s AS (SELECT *, lead(cx) OVER (PARTITION BY sp ORDER BY cx) AS nx, lead(cy) OVER (PARTITION BY sp ORDER BY cx) AS ny, row_number() OVER (PARTITION BY sp ORDER BY cx) = 1 AS first FROM curve) SELECT l_orderkey, l_linenumber, {sql6('CASE WHEN p <= cx OR nx IS NULL THEN cy ELSE cy + (ny - cy) * (p - cx) / (nx - cx) END')} AS y FROM preds LEFT JOIN s ON sp = l_returnflag AND (first OR p >= cx) AND (nx IS NULL OR p < nx)")
def calibrated_interp(spark, d):
    """AG21."""
    curve = spark.createDataFrame(_CURVE, "l_returnflag string, cx double, cy double")
    return R.interpolate(B.preds(spark, d).select("l_orderkey", "l_linenumber", "l_returnflag", "p"), curve, ["l_returnflag"], "p").select("l_orderkey", "l_linenumber", r6(F.col("y")).alias("y"))


_LEVEL = "CASE WHEN p < 0.02 THEN 'very_likely_inactive' WHEN p < 0.1 THEN 'probably_inactive' WHEN p < 0.3 THEN 'leans_inactive' WHEN p < 0.7 THEN 'unclear' WHEN p < 0.9 THEN 'leans_active' WHEN p < 0.98 THEN 'probably_active' ELSE 'very_likely_active' END"


@query(f"WITH {B.PREDS_SQL}, g AS (SELECT l_returnflag, {_LEVEL} AS level, count(*) AS n, avg(p) AS mean_p, avg((NOT resistant)::INTEGER) AS observed FROM preds GROUP BY ALL) SELECT l_returnflag, level, n, {sql6('n / sum(n) OVER (PARTITION BY l_returnflag)')} AS share, {sql6('mean_p')} AS mean_p, {sql6('observed')} AS observed FROM g")
def confidence_levels(spark, d):
    """PR34, AG24."""
    g = B.preds(spark, d).groupBy("l_returnflag", mic.confidence_level(F.col("p")).alias("level")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg((~F.col("resistant")).cast("double")).alias("observed"))
    share = F.col("n") / F.sum("n").over(W.partitionBy("l_returnflag"))
    return g.select("l_returnflag", "level", "n", r6(share).alias("share"), r6(F.col("mean_p")).alias("mean_p"), r6(F.col("observed")).alias("observed"))


_CALL = "c AS (SELECT *, CASE WHEN high <= 0.5 THEN 'likely_active' WHEN low > 2 THEN 'likely_inactive' ELSE 'uncertain' END AS call FROM preds)"


def _called(spark, d):
    none = F.lit(None).cast("double")
    return B.preds(spark, d).withColumn("c", mic.active_call(F.col("low"), F.col("high"), F.col("p"), F.lit(0.5), F.lit(2.0), none, none)).withColumn("call", F.col("c.call")).withColumn("margin", F.col("c.margin"))


@query(f"WITH {B.PREDS_SQL}, {_CALL} SELECT l_orderkey, l_linenumber, call, CASE WHEN call = 'likely_active' THEN CAST(greatest(0, round(log2(0.5::DOUBLE) - log2(high))) AS INTEGER) ELSE -1 END AS margin FROM c")
def call_band_rule(spark, d):
    """PR35."""
    return _called(spark, d).select("l_orderkey", "l_linenumber", "call", F.coalesce("margin", F.lit(-1)).alias("margin"))


@query(f"WITH {B.PREDS_SQL}, {_CALL} SELECT l_returnflag, l_linestatus, {sql6("avg(CASE WHEN lab_sir = 'R' THEN (call = 'likely_active')::INTEGER END)")} AS vme, {sql6("avg(CASE WHEN lab_sir = 'S' THEN (call = 'likely_inactive')::INTEGER END)")} AS me, {sql6("avg((call <> 'uncertain')::INTEGER)")} AS committed, {sql6("avg(CASE WHEN call <> 'uncertain' THEN ((call = 'likely_active') = (lab_sir = 'S'))::INTEGER END)")} AS correct, count(*) AS n FROM c WHERE lab_sir <> 'I' GROUP BY ALL")
def calls_report(spark, d):
    """AG23."""
    c = _called(spark, d).filter("lab_sir <> 'I'")
    rate = lambda of, given=F.lit(True): r6(F.avg(F.when(given, of.cast("double"))))
    call, lab = F.col("call"), F.col("lab_sir")
    return c.groupBy("l_returnflag", "l_linestatus").agg(rate(call == "likely_active", lab == "R").alias("vme"), rate(call == "likely_inactive", lab == "S").alias("me"), rate(call != "uncertain").alias("committed"), rate((call == "likely_active") == (lab == "S"), call != "uncertain").alias("correct"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {B.PREDS_SQL}, {_CALL}, r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber % 3, CASE WHEN call = 'likely_active' THEN greatest(0, round(log2(0.5::DOUBLE) - log2(high))) ELSE 0 END DESC, p DESC, l_linenumber) AS place FROM c WHERE call = 'likely_active') SELECT * FROM r")
def rank_active(spark, d):
    """SO2."""
    w = W.partitionBy("l_orderkey").orderBy(F.col("l_linenumber") % 3, F.coalesce("margin", F.lit(0)).desc(), F.col("p").desc(), "l_linenumber")
    return _called(spark, d).filter("call = 'likely_active'").select("l_orderkey", "l_linenumber", F.row_number().over(w).cast("long").alias("place"))


# quality --------------------------------------------------------------------------------------------------------------

@query("WITH r AS (SELECT c_custkey, CAST(c_custkey % 1000 AS INTEGER) AS n_contigs, c_acctbal AS total_length, 5000::DOUBLE AS expected, c_mktsegment AS species, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN 'x' ELSE c_mktsegment END AS m, (c_custkey % 13) / 200::DOUBLE AS dist FROM customer) SELECT c_custkey, CASE WHEN n_contigs = 0 THEN 'download_failed' ELSE nullif(concat_ws(';', CASE WHEN n_contigs > 500 THEN 'too_fragmented' END, CASE WHEN abs(total_length / expected - 1) > 0.2 THEN 'wrong_genome_size' END, CASE WHEN m IS NULL THEN 'no_mash_result' END, CASE WHEN m <> species THEN 'species_mismatch' END, CASE WHEN dist > 0.05 THEN 'too_distant' END), '') END AS qc_fail_reason FROM r")
def qc_flags(spark, d):
    """DQ3."""
    k = F.col("c_custkey")
    r = table(spark, d, "customer").select("c_custkey", (k % 1000).cast("int").alias("n_contigs"), F.col("c_acctbal").alias("total_length"), F.lit(5000.0).alias("expected"), F.col("c_mktsegment").alias("species"), F.when(k % 7 == 0, None).when(k % 5 == 0, "x").otherwise(F.col("c_mktsegment")).alias("mash_species"), ((k % 13) / 200).alias("mash_distance"))
    return R.qc_flags(r).select("c_custkey", "qc_fail_reason")


@query("WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS c FROM e GROUP BY ALL), s AS (SELECT e.vec_id, c.label AS reference, sum((x - c) * (x - c)) AS s FROM e JOIN c ON e.i = c.i GROUP BY ALL) SELECT vec_id, arg_min(reference, struct_pack(a := floor(sqrt(s) * 1e6 + 0.5), b := reference)) AS nearest, floor(sqrt(min(s)) * 1e4 + 0.5) / 1e4 AS distance FROM s GROUP BY 1")
def nearest_reference(spark, d):
    """AG8: references are one row per label and coordinate."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "x"))
    c = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("c")).withColumnRenamed("label", "reference")
    s = e.join(c, "i").groupBy("vec_id", "reference").agg(F.sum((F.col("x") - F.col("c")) ** 2).alias("s"))
    g = s.groupBy("vec_id").agg(F.min_by("reference", F.struct(F.floor(F.sqrt("s") * 1e6 + 0.5), F.col("reference"))).alias("nearest"), F.min("s").alias("s"))
    return g.select("vec_id", "nearest", (F.floor(F.sqrt("s") * 1e4 + 0.5) / 1e4).alias("distance"))


@query("SELECT 'negative_price' AS rule, count_if(l_extendedprice < 0) AS n FROM lineitem UNION ALL SELECT 'high_discount', count_if(l_discount > 0.09) FROM lineitem UNION ALL SELECT 'unknown_flag', count_if(l_returnflag NOT IN ('A', 'N')) FROM lineitem")
def contract_violations(spark, d):
    """Counts of broken rules in one pass, as DQ1, DQ2, DQ7 and DQ9 report them."""
    return R.violations(table(spark, d, "lineitem"), {"negative_price": F.col("l_extendedprice") < 0, "high_discount": F.col("l_discount") > 0.09, "unknown_flag": ~F.col("l_returnflag").isin("A", "N")})


@query("SELECT c_custkey, c_mktsegment || '_' || CASE WHEN c_nationkey % 3 = 0 THEN 'SOLO_S' || c_custkey ELSE split_part('PDS' || c_nationkey || '.1', '.', 1) END AS lineage FROM customer")
def lineage_ids(spark, d):
    """SO7."""
    return _lineages(spark, d).select(F.col("genome").alias("c_custkey"), F.col("cluster").alias("lineage"))


def _lineages(spark, d):
    from susceptra.operators import splits

    c = table(spark, d, "customer")
    sample = F.concat(F.lit("S"), F.col("c_custkey").cast("string")).alias("biosample")
    snp = c.filter("c_nationkey % 3 > 0").select(sample, F.concat(F.lit("PDS"), F.col("c_nationkey").cast("string"), F.lit(".1")).alias("snp_cluster"))
    return splits.lineage_ids(c.select(F.col("c_custkey").alias("genome"), F.col("c_mktsegment").alias("species"), sample), snp)


@query()
def lineage_splits(spark, d):
    """SO5, SO6, AG14: whole lineages to the test set until each drug has R and S there, the rest to five folds; tests replay it."""
    from susceptra.operators import splits

    labels = table(spark, d, "orders").select(F.col("o_custkey").alias("genome"), F.col("o_orderstatus").alias("drug"), F.when(F.col("o_orderkey") % 2 == 0, "R").otherwise("S").alias("sir"))
    return splits.make_splits(_lineages(spark, d), labels, ["F", "O"], seed=7).select("genome", "cluster", "split", "fold")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def recent_jobs(spark, d):
    """SO3."""
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate").orderBy(F.col("o_orderdate").desc(), "o_orderkey").limit(100)


@query("SELECT o_orderkey FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':7'), o_orderkey LIMIT 500")
def pilot_sample(spark, d):
    """SO4: a seeded sample of fixed size is the feature."""
    return table(spark, d, "orders").select("o_orderkey").orderBy(F.md5(F.concat(F.col("o_orderkey").cast("string"), F.lit(":7"))), "o_orderkey").limit(500)


@query("SELECT c_nationkey, c_custkey, CAST(floor((row_number() OVER (PARTITION BY c_nationkey ORDER BY md5(CAST(c_custkey AS VARCHAR)), c_custkey) - 1) / 16) AS BIGINT) AS batch FROM customer")
def species_batches(spark, d):
    """SO8."""
    w = W.partitionBy("c_nationkey").orderBy(F.md5(F.col("c_custkey").cast("string")), "c_custkey")
    return table(spark, d, "customer").select("c_nationkey", "c_custkey", F.floor((F.row_number().over(w) - 1) / 16).alias("batch"))


@query()
def report_json(spark, d):
    """Nested report as JSON."""
    c = _called(spark, d).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "call", "margin"))).alias("drugs"))
    return c.select("l_orderkey", F.to_json(F.struct(F.col("l_orderkey").alias("sample"), "drugs")).alias("report"))


# splits, models and extensions ----------------------------------------------------------------------------------------

def _clusters(spark, d):
    c = table(spark, d, "customer")
    return c.groupBy(F.concat_ws("_", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("cluster")).agg(F.count(F.lit(1)).alias("n"))


@query()
def greedy_split(spark, d):
    """SO5."""
    from susceptra.operators.splits import greedy_test_clusters

    return greedy_test_clusters(_clusters(spark, d), seed=7)


@query("""WITH RECURSIVE c AS (SELECT c_mktsegment || '_' || c_nationkey AS cluster, count(*) AS n FROM customer GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY n DESC, cluster) AS i FROM c),
r AS (SELECT CAST(0 AS BIGINT) AS i, [0::BIGINT, 0, 0, 0, 0] AS load, CAST(NULL AS VARCHAR) AS cluster, CAST(NULL AS BIGINT) AS n, CAST(NULL AS BIGINT) AS fold
  UNION ALL SELECT o.i, list_transform(range(1, 6), lambda j: e.load[j] + CASE WHEN j = e.f THEN o.n ELSE 0 END), o.cluster, o.n, e.f - 1 FROM (SELECT *, CAST(list_position(load, list_min(load)) AS BIGINT) AS f FROM r) e JOIN o ON o.i = e.i + 1)
SELECT cluster, n, CAST(fold AS INTEGER) AS fold FROM r WHERE i > 0""")
def lpt_folds(spark, d):
    """SO6; in SQL by recursion over the clusters in order."""
    from susceptra.operators.splits import lpt_fold

    return lpt_fold(_clusters(spark, d), 5)


@query()
def censored_nll(spark, d):
    """ML1."""
    from susceptra.ml.calibration import censored_nll as nll

    rows = B.preds(spark, d).select(F.col("l_returnflag").alias("drug"), F.log2("pred").alias("mu"), F.lit(1.0).alias("sigma"), mic.log2_bound(F.col("lab_lower")).alias("lower"), mic.log2_bound(F.col("lab_upper")).alias("upper"))
    return nll(rows, "drug")


#: Least labels spread by one link a round; twelve are more than any path between parts and suppliers needs.
_SPREAD_SQL = ", ".join(f"l{i + 1} AS MATERIALIZED (SELECT a AS node, min(l{i}.label) AS label FROM both_ways JOIN l{i} ON l{i}.node = b GROUP BY 1)" for i in range(12))
_COMPONENTS_SQL = f"""WITH e AS (SELECT DISTINCT l_partkey * 2 AS a, l_suppkey * 2 + 1 AS b FROM lineitem), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT a, a FROM e UNION SELECT b, b FROM e),
l0 AS (SELECT DISTINCT a AS node, a AS label FROM both_ways), {_SPREAD_SQL} SELECT node, label AS component FROM l12"""


@query(_COMPONENTS_SQL)
def components_single_linkage(spark, d):
    """EX1: parts and suppliers linked by any line."""
    return _components(table(spark, d, "lineitem"))


@query(_COMPONENTS_SQL)
def components_whole(spark, d):
    """EX1 under its older name; tests hold it against plain Python."""
    return _components(table(spark, d, "lineitem"))


def _components(lines):
    return connected_components(lines.select((F.col("l_partkey") * 2).alias("a"), (F.col("l_suppkey") * 2 + 1).alias("b")))


@query(f"WITH {B.HITS_SQL}, p AS (SELECT symbol, md5(list_aggregate(list_sort(list_distinct(list(genome_id))), 'string_agg', ',')) AS pattern FROM hits GROUP BY 1) SELECT pattern, count(*) AS members, min(symbol) AS first FROM p GROUP BY 1")
def pattern_collapse(spark, d):
    """EX2."""
    p = B.hits(spark, d).groupBy("symbol").agg(F.md5(F.array_join(F.array_sort(F.collect_set("genome_id")), ",")).alias("pattern"))
    return p.groupBy("pattern").agg(F.count(F.lit(1)).alias("members"), F.min("symbol").alias("first"))


@query("WITH p AS (SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS profile, avg(o_totalprice) AS v FROM orders GROUP BY 1) SELECT profile, count(*) AS n, floor(median(v) * 1e4 + 0.5) / 1e4 AS mid FROM p GROUP BY 1")
def profile_lookup_median(spark, d):
    """EX4, AG35."""
    p = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("profile"), F.avg("o_totalprice").alias("v"))
    return p.groupBy("profile").agg(F.count(F.lit(1)).alias("n"), (F.floor(F.median("v") * 1e4 + 0.5) / 1e4).alias("mid"))


@query("SELECT o_orderkey, l_linenumber, c_mktsegment FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey AND n_regionkey = 1")
def training_join(spark, d):
    """EX5."""
    n = table(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    c = table(spark, d, "customer").join(n, "c_nationkey").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    o = table(spark, d, "orders").join(c, "o_custkey").select("o_orderkey", "c_mktsegment")
    return table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "l_linenumber", "c_mktsegment")
