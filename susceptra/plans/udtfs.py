"""Queries that call the table functions from SQL, and checks of whole files."""

from __future__ import annotations

from pyspark.sql import functions as F

from susceptra.functions import tables
from susceptra.plans.bridge import table
from susceptra.plans.catalogue import query
from susceptra.sources import uploads

_LINES_SQL = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM documents WHERE text IS NOT NULL)"


@query(f"""WITH {_LINES_SQL}, r AS (SELECT doc_id, place // 4 AS n, string_agg(regexp_replace(translate(line, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[ \\t\\r\\f\\v]', '', 'g'), '' ORDER BY place) AS s FROM l WHERE place % 4 > 0 AND NOT starts_with(line, '>') GROUP BY ALL)
SELECT CAST(doc_id AS VARCHAR) AS file, 'record ' || n AS header, md5(s) AS digest FROM r WHERE s <> ''""")
def fasta_table_function(spark, d):
    """2.13, SC9: every fourth line of a document as a header, the others as sequence, by PARTITION BY and ORDER BY."""
    tables.register(spark)
    lines = table(spark, d, "documents").filter("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("file"), F.posexplode(F.split("text", "\n")).alias("place", "text"))
    lines = lines.select("file", "place", F.when(F.col("place") % 4 == 0, F.concat(F.lit("> record "), (F.floor(F.col("place") / 4)).cast("string"), F.lit(" "))).otherwise(F.col("text")).alias("line")).filter("place % 4 = 0 OR NOT startswith(line, '>')")
    lines.createOrReplaceTempView("fasta_lines")
    return spark.sql("SELECT file, header, md5(sequence) AS digest FROM fasta_records(TABLE(fasta_lines) PARTITION BY file ORDER BY place)")


_CS_SQL = """p AS (SELECT l_orderkey AS k, l_linenumber AS i, CAST(l_quantity AS INTEGER) AS q FROM lineitem),
t AS (SELECT *, (['*', '+', '-'])[i % 3 + 1] AS sign, CASE i % 3 WHEN 0 THEN 1 ELSE 1 + q % 2 END AS size FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY i, ':' || q || sign || repeat('x', size)) AS r FROM t),
e AS (SELECT k, 2 * r AS o, ':' AS sign, q AS size FROM r UNION ALL SELECT k, 2 * r + 1, sign, size FROM r)"""


@query(f"""WITH {_CS_SQL} SELECT k, CAST(row_number() OVER w - 1 AS INTEGER) AS number, sign, CAST(size AS INTEGER) AS size, CAST(coalesce(sum(CASE WHEN sign <> '+' THEN size END) OVER b, 0) AS INTEGER) AS target,
  CAST(coalesce(sum(CASE WHEN sign <> '-' THEN size END) OVER b, 0) AS INTEGER) AS query FROM e WINDOW w AS (PARTITION BY k ORDER BY o), b AS (PARTITION BY k ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def cs_table_function(spark, d):
    """2.13, AG33: an order's lines as one difference string, taken apart again with places in target and query."""
    tables.register(spark)
    q = F.col("l_quantity").cast("int")
    odd = F.col("l_linenumber") % 3
    edit = F.when(odd == 0, "*ag").when(odd == 1, F.concat(F.lit("+"), F.expr("repeat('c', 1 + CAST(l_quantity AS INT) % 2)"))).otherwise(F.concat(F.lit("-"), F.expr("repeat('t', 1 + CAST(l_quantity AS INT) % 2)")))
    part = F.struct("l_linenumber", F.concat(F.lit(":"), q.cast("string"), edit).alias("part"))
    strings = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_join(F.sort_array(F.collect_list(part))["part"], "").alias("cs"))
    strings.createOrReplaceTempView("cs_strings")
    return spark.sql("SELECT k, e.number, e.sign, e.size, e.target, e.query FROM cs_strings, LATERAL cs_events(cs) AS e")


_NAMES = (".fasta", ".fna", ".txt", ".fa.gz", "", ".FA")


@query(f"""WITH f AS (SELECT 'u/g' || doc_id || (['{"', '".join(_NAMES)}'])[doc_id % 6 + 1] AS path, doc_id % 6 AS kind, CASE doc_id % 3 WHEN 0 THEN chr(10) || '  ' || chr(10) || '>' WHEN 1 THEN '>' ELSE '' END || coalesce(text, '') AS t FROM documents),
g AS (SELECT *, octet_length(encode(t)) AS size FROM f),
h AS (SELECT *, CASE WHEN kind IN (2, 4) THEN 'extension' WHEN size > 2000 THEN 'too_large' WHEN kind = 3 AND size > 0 THEN 'bad_gzip' WHEN NOT starts_with(regexp_replace(t, '^([ \t\f\v]*[\n\r])*', ''), '>') THEN 'not_fasta' END AS reason FROM g)
SELECT path, CASE reason WHEN 'extension' THEN 415 WHEN 'too_large' THEN 413 WHEN 'bad_gzip' THEN 422 WHEN 'not_fasta' THEN 422 ELSE 200 END AS status, reason, kind = 3 AS packed, CAST(CASE WHEN reason = 'bad_gzip' THEN 0 ELSE size END AS BIGINT) AS size FROM h""")
def upload_acceptance(spark, d):
    """DQ8: documents as files of six kinds of names, a third of them with blank lines in front."""
    lead = F.when(F.col("doc_id") % 3 == 0, "\n  \n>").when(F.col("doc_id") % 3 == 1, ">").otherwise("")
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("doc_id") % 6 + 1).cast("int"))
    files = table(spark, d, "documents").select(F.concat(F.lit("u/g"), F.col("doc_id").cast("string"), name).alias("path"), F.concat(lead, F.coalesce("text", F.lit(""))).cast("binary").alias("content"))
    return uploads.upload_checks(files.select("path", F.length("content").cast("long").alias("length"), "content"), 2000)
