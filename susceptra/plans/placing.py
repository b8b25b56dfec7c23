"""Queries that place partial sequences on donors; SQL joins by plain ranges where the operators use bins."""

from __future__ import annotations

from pyspark.sql import functions as F

from susceptra.operators import candidates
from susceptra.plans.bridge import table
from susceptra.plans.catalogue import query, r6, sql6

PROBES, WIDTH, LENGTH = 4, 100, 1000


def _lines(spark, d):
    o, l = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "lineitem")  # noqa: E741
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("query"), F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"), F.col("l_linenumber").cast("long").alias("i"), F.col("l_quantity").cast("long").alias("q"), "l_linestatus", "l_discount")


_LINES_SQL = "x AS (SELECT o_custkey AS query, l_suppkey AS s, l_partkey AS p, CAST(l_linenumber AS BIGINT) AS i, CAST(l_quantity AS BIGINT) AS q, l_linestatus, l_discount FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"

_PROBE_SQL = f"""WITH {_LINES_SQL},
r AS (SELECT *, s % 4 AS ref, p % {PROBES} AS probe, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand, 1600 + 100 * (s % 4) AS n, q % 8 AS qs, {WIDTH} - i % 5 AS qe FROM x),
t AS (SELECT *, (query * 31 + ref * 17) % n + 300 * probe + qs + i % 3 AS f FROM r),
h AS (SELECT query, ref, ref // 2 AS donor, n, strand, probe, ((60 + q) / 110::DOUBLE) AS identity, (qe - qs) / {WIDTH}::DOUBLE AS coverage, f - qs AS start, f + (qe - qs) + ({WIDTH} - qe) AS "end", {WIDTH} - (qe - qs) AS clip, f AS ts, f + qe - qs AS te FROM t WHERE (qe - qs) * 2 >= {WIDTH}),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, ref, strand, probe ORDER BY identity * coverage DESC, ts, te) AS k FROM h) WHERE k = 1),
c AS (SELECT query, ref, donor, n, strand, count(*) AS placed, avg(identity) AS mi, min(identity) AS li, avg(coverage) AS mc, max(CASE WHEN probe = 0 THEN start END) AS a, max(CASE WHEN probe = {PROBES - 1} THEN "end" END) AS z,
  max(CASE WHEN probe = 0 THEN clip END) AS ac, max(CASE WHEN probe = {PROBES - 1} THEN clip END) AS zc FROM b GROUP BY ALL),
d AS (SELECT *, sum(placed) OVER (PARTITION BY query, ref) AS strands, ((z - a) % n + n) % n AS span, ((a - z) % n + n) % n AS missing, {LENGTH} * 0.35::DOUBLE / 0.65::DOUBLE AS expected FROM c),
e AS (SELECT *, placed / {PROBES}::DOUBLE * mi * mc AS score FROM d WHERE a IS NOT NULL AND z IS NOT NULL AND ac <= {WIDTH // 10} AND zc <= {WIDTH // 10} AND span BETWEEN {LENGTH // 2} AND {LENGTH * 3 // 2} AND missing >= 0.25::DOUBLE * expected AND missing <= 2.5::DOUBLE * expected),
f AS (SELECT *, row_number() OVER (PARTITION BY query, donor ORDER BY score DESC, ref, strand) AS k FROM e)
SELECT query, donor, ref, strand, a AS start, z AS "end", missing, {sql6('score + 1e-9::DOUBLE')} AS score, {sql6('placed / strands::DOUBLE + 1e-9::DOUBLE')} AS strand_share, {sql6(f'span / {LENGTH}::DOUBLE + 1e-9::DOUBLE')} AS span_ratio, {sql6('missing / expected + 1e-9::DOUBLE')} AS missing_ratio, {sql6('(ac + zc) / 200::DOUBLE + 1e-9::DOUBLE')} AS clip_share, {sql6('li + 1e-9::DOUBLE')} AS least_identity FROM f WHERE k = 1"""


@query(_PROBE_SQL)
def probe_candidates(spark, d):
    """ML13: four probes of every customer's sequence on four references, both strands."""
    r = _lines(spark, d).withColumn("ref", F.col("s") % 4).withColumn("probe", F.col("p") % PROBES).withColumn("strand", F.when(F.col("l_linestatus") == "O", "+").otherwise("-")).withColumn("n", 1600 + 100 * F.col("ref"))
    r = r.withColumn("qs", F.col("q") % 8).withColumn("qe", WIDTH - F.col("i") % 5).withColumn("f", F.pmod(F.col("query") * 31 + F.col("ref") * 17, F.col("n")) + 300 * F.col("probe") + F.col("qs") + F.col("i") % 3)
    size, back = F.col("qe") - F.col("qs"), F.col("strand") == "-"
    hits = r.select("query", "probe", "ref", "strand", F.lit(WIDTH).alias("qlen"), "qs", "qe", F.when(back, F.col("n") - F.col("f") - size).otherwise(F.col("f")).alias("ts"), F.when(back, F.col("n") - F.col("f")).otherwise(F.col("f") + size).alias("te"), (60 + F.col("q")).alias("matches"), F.lit(110).alias("block"))
    references = spark.range(4).select(F.col("id").alias("ref"), F.floor(F.col("id") / 2).alias("donor"), (1600 + 100 * F.col("id")).alias("n"))
    # as in the SQL, customers that orders name need not be in their own table
    queries = table(spark, d, "orders").select(F.col("o_custkey").alias("query")).distinct().withColumn("length", F.lit(LENGTH).cast("long"))
    out = candidates.probe_placements(hits, references, queries, PROBES, WIDTH, decimals=None)
    return out.select("query", "donor", "ref", "strand", "start", "end", "missing", *[r6(F.col(c) + 1e-9).alias(c) for c in ("score", "strand_share", "span_ratio", "missing_ratio", "clip_share", "least_identity")])


CLIP, DRIFT, SPAN = 300, 120, 3000

_HITS_SQL = f"""{_LINES_SQL},
h0 AS (SELECT query, s % 3 AS donor, CASE WHEN p % 2 = 0 THEN '+' ELSE '-' END AS strand, (['full', 'left', 'right'])[i % 3 + 1] AS part, p * 7 % 2500 AS qs, p * 7 % 2500 + 200 + 5 * q AS qe, 5000 + 700 * (s % 3) AS n, 0.8::DOUBLE + l_discount AS identity, q, i FROM x),
h AS (SELECT *, (query * 13 + qs + i * 17 % 60) % n AS ts, (query * 13 + qs + i * 17 % 60) % n + qe - qs + q % 3 AS te, {SPAN} AS length, {SPAN} * 40 / 60::DOUBLE AS expected, 0.5::DOUBLE + donor / 10::DOUBLE AS containment FROM h0),
m AS (SELECT *, least(25000, greatest({CLIP}, expected * 0.2::DOUBLE)) AS mc FROM h),
lf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, donor, strand ORDER BY qs, identity DESC, qe - qs DESC, ts, te) AS k FROM m WHERE part <> 'full' AND qs <= mc) WHERE k <= 12),
rt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, donor, strand ORDER BY length - qe, identity DESC, qe - qs DESC, ts, te) AS k FROM m WHERE part <> 'full' AND length - qe <= mc) WHERE k <= 12),
p0 AS (SELECT a.query, a.donor, a.strand, a.n, a.length, a.expected, a.containment, a.mc, a.qs AS aqs, a.qe AS aqe, b.qs AS bqs, b.qe AS bqe, ((a.ts - a.qs) % a.n + a.n) % a.n AS st, ((b.te + b.length - b.qe) % a.n + a.n) % a.n AS en FROM lf a JOIN rt b USING (query, donor, strand)),
p1 AS (SELECT *, ((en - st) % n + n) % n AS span, ((st - en) % n + n) % n AS missing FROM p0),
pr AS (SELECT * FROM p1 WHERE missing > 0 AND span BETWEEN 0.5::DOUBLE * length AND 1.5::DOUBLE * length AND missing >= 0.05::DOUBLE * expected AND missing <= 4 * expected),
ed AS (SELECT DISTINCT query, donor, strand, n, length, mc, st, en, span FROM pr),
co AS (SELECT e.query, e.donor, e.strand, e.st, e.en, h.part, h.qs, h.qe, h.identity FROM ed e JOIN h USING (query, donor, strand)
  WHERE ((h.ts - e.st) % e.n + e.n) % e.n <= e.span + e.mc AND abs(((h.ts - e.st) % e.n + e.n) % e.n - h.qs) <= greatest({DRIFT}, 0.15::DOUBLE * e.length)),
al AS (SELECT query, donor, strand, -1 AS st, -1 AS en, part, qs, qe, identity FROM h UNION ALL SELECT * FROM co),
pt AS (SELECT DISTINCT query, donor, strand, st, en, unnest([qs, qe]) AS v FROM al),
sg AS (SELECT *, lead(v) OVER (PARTITION BY query, donor, strand, st, en ORDER BY v) AS w FROM pt),
bs AS (SELECT s.query, s.donor, s.strand, s.st, s.en, s.v, s.w, max(a.identity) AS best FROM sg s JOIN al a ON a.query = s.query AND a.donor = s.donor AND a.strand = s.strand AND a.st = s.st AND a.en = s.en AND a.qs <= s.v AND a.qe >= s.w WHERE s.w IS NOT NULL GROUP BY ALL),
qu AS (SELECT query, donor, strand, st, en, sum(w - v)::DOUBLE AS covered, sum((w - v) * best) AS weighted FROM bs GROUP BY ALL),
op AS (SELECT pr.*, 0.4::DOUBLE * containment + 0.4::DOUBLE * coalesce(covered, 0) / length + 0.2::DOUBLE * coalesce(weighted, 0) / greatest(1, coalesce(covered, 0)) - 0.08::DOUBLE * abs(ln(missing / expected)) - 0.1::DOUBLE * (aqs / expected + (length - bqe) / expected) AS score, covered
  FROM pr LEFT JOIN qu USING (query, donor, strand, st, en)),
o1 AS (SELECT query, donor, strand, st, en, missing, max(score) AS score, max(coalesce(covered, 0) / length) AS coverage FROM op GROUP BY ALL),
o2 AS (SELECT *, least(count(*) OVER (PARTITION BY query, donor, strand), 20) / 20::DOUBLE AS options, row_number() OVER (PARTITION BY query, donor, strand ORDER BY score DESC, st, en) AS k FROM o1),
rs AS (SELECT 'length_right' AS method, query, donor, strand, n, length, expected, containment, (((te + length - qe) % n + n) % n) AS en, ((((te + length - qe) % n + n) % n) + 2000) % n AS st, 1 + (length - qe) / expected AS clips FROM rt WHERE k <= 2 AND 2000 < n
  UNION ALL SELECT 'length_left', query, donor, strand, n, length, expected, containment, (((((ts - qs) % n + n) % n) - 2000) % n + n) % n, ((ts - qs) % n + n) % n, qs / expected + 1 FROM lf WHERE k <= 2 AND 2000 < n),
r1 AS (SELECT method, rs.query, rs.donor, rs.strand, rs.st, rs.en, 2000 AS missing, 0.4::DOUBLE * containment + 0.4::DOUBLE * covered / length + 0.2::DOUBLE * weighted / greatest(1, covered) - 0.1::DOUBLE * clips AS score, covered / length AS coverage, coalesce(c.options, 0) AS options
  FROM rs JOIN qu ON qu.query = rs.query AND qu.donor = rs.donor AND qu.strand = rs.strand AND qu.st = -1 LEFT JOIN (SELECT query, donor, strand, max(options) AS options FROM o2 GROUP BY ALL) c ON c.query = rs.query AND c.donor = rs.donor AND c.strand = rs.strand),
un AS (SELECT 'anchored' AS method, query, donor, strand, st, en, missing, score, coverage, options FROM o2 WHERE k <= 3 UNION ALL SELECT * FROM r1),
dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, donor, strand, en, missing ORDER BY score DESC, method, st) AS c FROM un) WHERE c = 1)"""


@query(f"""WITH {_HITS_SQL} SELECT query, donor, strand, method, st AS start, en AS "end", CAST(missing AS BIGINT) AS missing, {sql6('score + 1e-9::DOUBLE')} AS score, {sql6('coverage + 1e-9::DOUBLE')} AS coverage, options FROM dd""")
def anchored_candidates(spark, d):
    """ML9, ML10, JN16: every customer's sequence on three donors, both strands; anchored ends and rescue by length."""
    x = _lines(spark, d).withColumn("donor", F.col("s") % 3).withColumn("n", 5000 + 700 * F.col("donor")).withColumn("qs", F.col("p") * 7 % 2500).withColumn("qe", F.col("qs") + 200 + 5 * F.col("q"))
    x = x.withColumn("ts", F.pmod(F.col("query") * 13 + F.col("qs") + F.col("i") * 17 % 60, F.col("n")))
    part = F.element_at(F.array(F.lit("full"), F.lit("left"), F.lit("right")), (F.col("i") % 3 + 1).cast("int"))
    hits = x.select("query", "donor", F.when(F.col("p") % 2 == 0, "+").otherwise("-").alias("strand"), part.alias("part"), "qs", "qe", "ts", (F.col("ts") + F.col("qe") - F.col("qs") + F.col("q") % 3).alias("te"), (0.8 + F.col("l_discount")).alias("identity"))
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("query"))
    donors = spark.range(3).select(F.col("id").alias("donor"), (5000 + 700 * F.col("id")).alias("n"), (0.5 + F.col("id") / 10).alias("containment"))
    queries = customers.select("query", F.lit(SPAN).cast("long").alias("length"), F.lit(60).alias("percent"))
    out = candidates.anchored(hits, customers.join(F.broadcast(donors)), queries, least_clip=CLIP, drift=DRIFT)
    return out.select("query", "donor", "strand", "method", "start", "end", "missing", r6(F.col("score") + 1e-9).alias("score"), r6(F.col("coverage") + 1e-9).alias("coverage"), "options")
