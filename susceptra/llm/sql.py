"""DuckDB SQL of the repair and clustering queries, put together from their repeated parts."""

from __future__ import annotations

#: A path in the search: nine digits of cost, the audit, chr(1), the repaired lines. No path is '~', which sorts last.
NOTHING = "'000000000' || chr(1)"


def _arc(path: str, cost: str, label: str, line: str = "''") -> str:
    return (f"CASE WHEN {path} = '~' THEN '~' ELSE lpad(CAST(CAST(substr({path}, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({path}, 10, instr({path}, chr(1)) - 10) || '{label}' "
            f"|| substr({path}, instr({path}, chr(1))) || {line} END")


def _inserted(i: str) -> str:
    """The step's paths with what may be inserted before the next row: states 0 nothing, s system, u user, a assistant."""
    user, assistant = "'user:' || chr(10)", "'assistant:' || chr(10)"
    return (f"SELECT {i}, p0, ps, u1 AS pu, least(pa, {_arc('u1', '5', 'I', assistant)}) AS pa FROM "
            f"(SELECT *, least(pu, {_arc('p0', '5', 'I', user)}, {_arc('ps', '5', 'I', user)}, {_arc('pa', '5', 'I', user)}) AS u1 FROM steps)")


def _row_arcs() -> str:
    own = "n.role || ':' || n.text || chr(10)"
    keep = lambda path, initial: f"CASE WHEN n.first = '{initial}' AND NOT n.goes THEN {_arc('c.' + path, 'n.more', 'K', own)} ELSE '~' END"
    rerole = lambda path, role: f"CASE WHEN NOT n.goes THEN {_arc('c.' + path, '(n.more + 1)', 'R', chr(39) + role + ':' + chr(39) + ' || n.text || chr(10)')} ELSE '~' END"
    drop = lambda path: _arc("c." + path, "2", "D")
    to_user = ", ".join(f(p, x) for p in ("p0", "ps", "pa") for f, x in ((keep, "u"), (rerole, "user")))
    return (f"SELECT c.conv_key, c.i + 1 AS i, {drop('p0')} AS p0, least({drop('ps')}, {keep('p0', 's')}) AS ps, least({drop('pu')}, {to_user}) AS pu, "
            f"least({drop('pa')}, {keep('pu', 'a')}, {rerole('pu', 'assistant')}) AS pa FROM closed c JOIN n ON n.conv_key = c.conv_key AND n.i = c.i + 1")


REPAIR_SQL = rf"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END)) AS t),
raw AS (SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), 'null') AS conv_key, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
bytes AS (SELECT raw.*, list_concat([4294967295::BIGINT], list_transform(string_split(name, ''), lambda c: ascii(c)::BIGINT)) AS b FROM raw),
hit AS (SELECT bytes.*, xor(list_reduce(b, lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295::BIGINT) % 20 AS fault FROM bytes, crc),
d AS (SELECT conv_key, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM hit, (SELECT unnest(range(2)) AS copy) WHERE fault <> 0 AND (copy = 0 OR fault = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_key ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM d),
k AS (SELECT *, substr(role, 1, 1) AS first, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS t, row_number() OVER (PARTITION BY conv_key, role, text ORDER BY i) AS seen,
  lag(substr(role, 1, 1)) OVER (PARTITION BY conv_key ORDER BY i) AS before FROM o),
f AS (SELECT *, CASE WHEN t = '' THEN 1 WHEN seen > 1 THEN 2 WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM k),
n AS (SELECT conv_key, i, role, text, first, fault IN (1, 2) AS goes, CASE WHEN fault = 3 THEN 5 ELSE 0 END AS more FROM f),
steps AS (
  SELECT DISTINCT conv_key, CAST(0 AS BIGINT) AS i, {NOTHING} AS p0, '~' AS ps, '~' AS pu, '~' AS pa FROM n
  UNION ALL
  SELECT * FROM (WITH closed AS ({_inserted('conv_key, i')}) {_row_arcs()})),
ends AS ({_inserted('conv_key, i')}),
counts AS (SELECT conv_key, CAST(count(*) AS BIGINT) AS rows, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
  count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (before IS NOT NULL AND before || first NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_key),
best AS (SELECT c.*, least(e.p0, e.pa) AS path FROM counts c JOIN ends e ON e.conv_key = c.conv_key AND e.i = c.rows)
SELECT r.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(CAST(substr(path, 1, 9) AS BIGINT), 0) AS cost, coalesce(substr(path, 10, instr(path, chr(1)) - 10), '') AS audit,
  sha256(coalesce(regexp_replace(substr(path, instr(path, chr(1)) + 1), '\n$', ''), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv_key FROM raw) r LEFT JOIN best b USING (conv_key)
"""


def cluster_sql(k: int = 8, rounds: int = 10, seed: str = "3:") -> str:
    """One pair of CTEs a round: the nearest centroid of each vector, and the floors of the means."""
    parts = [f"""
v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
r AS (SELECT x, row_number() OVER (ORDER BY sha256('{seed}' || coalesce(CAST(vec_id AS VARCHAR), '')), x) - 1 AS c FROM v),
m0 AS (SELECT CAST(c AS INTEGER) AS c, x FROM r WHERE c < {k}),
dims AS (SELECT unnest(range(1, 65)) AS j)"""]
    near = "SELECT v.rid, v.vec_id, v.x, m.c, m.x AS mean, CAST(list_sum(list_transform(list_zip(v.x, m.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, {m} m"
    first = "SELECT rid, vec_id, x, c, mean, d FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY d, c) AS n FROM ({near})) WHERE n = 1"
    for i in range(rounds):
        parts.append(f"""
a{i} AS ({first.format(near=near.format(m=f'm{i}'))}),
s{i} AS (SELECT c, j, CAST(sum(x[j]) AS BIGINT) AS s, CAST(count(*) AS BIGINT) AS n FROM a{i}, dims GROUP BY c, j),
g{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS x FROM s{i} GROUP BY c),
m{i + 1} AS MATERIALIZED (SELECT m.c, coalesce(g.x, m.x) AS x FROM m{i} m LEFT JOIN g{i} g USING (c))""")
    parts.append(f"\nz AS ({first.format(near=near.format(m=f'm{rounds}'))})")
    return "WITH " + ",".join(parts) + """
SELECT vec_id, c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(mean, ',')) AS centroid_sha256 FROM z
"""
