"""The subpackage's queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from susceptra.llm import clusters, licenses, linededup, mixing, ngramrules, order_minhash, pieces, quality, repair, simhash, sql, urlfilter, warc, webp
from susceptra.llm.text import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded_digests(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprint_pairs(table(spark, sf_dir, "documents"))


def op5_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.digests(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_conversations(table(spark, sf_dir, "conversations"))


def op12_annulus_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(table(spark, sf_dir, "embeddings"))


def op13_ngram_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramrules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_mix_sources, op2_sentencepiece, op3_license_scan, op4_order_minhash, op5_webp_media, op6_quality, op7_line_dedup, op8_url_filter, op9_warc, op10_simhash, op11_conversation_repair, op12_annulus_clusters, op13_ngram_rules)
    return {f.__name__: f for f in made}


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         (CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS v
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM s),
w AS (SELECT *, CASE (n - 1) % 3 WHEN 0 THEN 5::DOUBLE WHEN 1 THEN 2::DOUBLE ELSE 1::DOUBLE END AS w, (source_size * 3)::DOUBLE AS cap FROM n),
l AS (SELECT *, cap / w AS full_at,
        (CAST(sum(source_size) OVER () AS BIGINT)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY cap / w, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT arg_min(level, struct_pack(a := full_at, b := n)) AS level FROM l WHERE level <= full_at),
t AS (SELECT source, source_size, least(cap, coalesce(f.level, 0::DOUBLE) * w) AS target FROM l LEFT JOIN f ON true),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
r AS (SELECT d.doc_id, d.size, d.v, p.source_size, p.target, p.whole, d.source, target - (whole * source_size)::DOUBLE AS goal
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
c AS (SELECT *, CASE WHEN goal > 0 AND size > 0 THEN CAST(sum(CASE WHEN goal > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY v, doc_id NULLS FIRST, size) AS BIGINT) END AS upto FROM r),
g AS (SELECT *, coalesce(upto <= goal, false) AS one, coalesce(max(CASE WHEN upto <= goal THEN upto END) OVER (PARTITION BY source), 0) AS got FROM c),
k AS (SELECT *, goal > 0 AND size > 0 AND NOT one AND size <= goal - got AS may FROM g),
h AS (SELECT *, CAST(sum(CASE WHEN may THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY v, doc_id NULLS FIRST, size) AS BIGINT) AS more,
        CAST(sum(CASE WHEN may THEN size ELSE 0 END) OVER (PARTITION BY source, v, doc_id, size) AS BIGINT) AS tied FROM k)
SELECT doc_id, size, source_size, target, size * (whole + CASE WHEN one OR (may AND 2 * more - tied <= 2 * (goal - got)) THEN 1 ELSE 0 END) AS taken FROM h
"""

URL_SQL = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM u),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM r),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
m AS (SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN host <> '' AND list_bool_or(list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1),
      lambda i: md5(array_to_string(string_split(host, '.')[i:], '.')) LIKE '0%' OR array_to_string(string_split(host, '.')[i:], '.') IN
      ('ads-track.example.org', 'casino-win.example.org', 'cheap-pills.example.com', 'free-bets.example.com', 'spam-farm.example.org'))) THEN 'block'
    ELSE 'allow' END AS verdict
FROM m
"""


#: Digests in hexadecimal are turned into base 32 by their 160 bits, five at a time.
WARC_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS raw, sha1(encode(coalesce(html, ''))) AS hex FROM pages),
b AS (SELECT page_id, octet_length(raw) AS payload_bytes, hex, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((('0x' || substr(hex, CAST((i * 5) // 4 + 1 AS INTEGER), 2))::BIGINT >> CAST(3 - (i * 5) % 4 AS BIGINT)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest FROM p),
h AS (SELECT hex, min(page_id) AS head, count(*) AS n FROM b GROUP BY hex)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN n > 1 AND head IS NOT NULL AND page_id IS DISTINCT FROM head THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n > 1 AND page_id IS DISTINCT FROM head THEN head END AS refers_to FROM b JOIN h USING (hex)
"""


def oracle_sql() -> dict[str, str]:
    """Where SQL can say it; the other operators are tested against brute force, round trips or held-out rows in tests/llm."""
    return {"op1_mix_sources": MIX_SQL, "op8_url_filter": URL_SQL, "op9_warc": WARC_SQL, "op11_conversation_repair": sql.REPAIR_SQL, "op12_annulus_clusters": sql.cluster_sql()}
