"""DuckDB SQL for the queries that SQL can express on whole tables.

The others are held against brute force in the tests: op1 needs a vocabulary
file, op3 a parser, op4 an iterated estimate, op8 and op10 the regular
expressions of another engine.
"""

from __future__ import annotations

from prismal.llm import linededup, mixing, urlfilter

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _number(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


MIXING = f"""
WITH d AS (SELECT doc_id, source, coalesce('=' || source, '') AS src, CAST(len({_WORDS}) AS BIGINT) AS size, {_number("'mix/' || coalesce(CAST(doc_id AS VARCHAR), 'null')")} AS turn FROM documents),
s AS (SELECT source, src, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY 1, 2),
w AS (SELECT *, {mixing.CAP} * source_size AS cap, CAST(CASE i % 3 WHEN 0 THEN {mixing.WEIGHTS[0]} WHEN 1 THEN {mixing.WEIGHTS[1]} ELSE {mixing.WEIGHTS[2]} END AS BIGINT) AS wt FROM s),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / wt, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) / CAST(sum(wt) OVER (ORDER BY cap / wt, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lvl, CAST((sum(source_size) OVER () + {mixing.BLOCK // 2}) // {mixing.BLOCK} AS BIGINT) AS house FROM w),
t AS (SELECT *, least(CAST(cap AS DOUBLE), (max(lvl) OVER ()) * wt) AS target FROM l),
q AS (SELECT src, count(*) AS quota FROM (SELECT src, house, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, i) AS place FROM t, LATERAL (SELECT unnest(range(house)) AS k) WHERE target > 0) WHERE place <= house GROUP BY 1),
p AS (SELECT d.*, t.source_size, t.target, coalesce(q.quota, 0) AS quota, d.turn % greatest(1, CAST(ceil(t.source_size / {mixing.SHARD_WORDS}::DOUBLE) AS BIGINT)) AS shard FROM d JOIN t USING (src) LEFT JOIN q USING (src)),
h AS (SELECT src, shard, quota, CAST(sum(size) AS BIGINT) AS total FROM p GROUP BY 1, 2, 3),
hq AS (SELECT src, shard, count(*) AS n FROM (SELECT src, shard, quota, row_number() OVER (PARTITION BY src ORDER BY total::DOUBLE / (2 * k + 1) DESC, shard) AS place FROM h, LATERAL (SELECT unnest(range(quota)) AS k) WHERE total > 0) WHERE place <= quota GROUP BY 1, 2),
x AS (SELECT p.doc_id, p.src, p.shard, p.size, p.source_size, p.target, h.total, coalesce(hq.n, 0) AS n, greatest(1, (h.total + {mixing.BLOCK - 1}) // {mixing.BLOCK}) AS b, CAST(sum(p.size) OVER (PARTITION BY p.src, p.shard ORDER BY p.turn, p.doc_id, p.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM p JOIN h ON h.src = p.src AND h.shard = p.shard LEFT JOIN hq ON hq.src = p.src AND hq.shard = p.shard),
y AS (SELECT *, least({mixing.CAP}, n // b) AS base, CASE WHEN n // b < {mixing.CAP} THEN n % b ELSE 0 END AS extra, {_number("'mix/' || src || '/' || CAST(shard AS VARCHAR)")} % b AS o FROM x),
z AS (SELECT *, unnest([e, e - size]) AS pos, unnest([1, -1]) AS sign FROM y),
v AS (SELECT *, pos // {mixing.BLOCK} AS j, pos % {mixing.BLOCK} AS inside FROM z)
SELECT doc_id, size, source_size, target, CAST(any_value(base) * size + sum(sign * (((j * extra + o) // b - o // b) * {mixing.BLOCK} + (((j + 1) * extra + o) // b - (j * extra + o) // b) * inside)) AS BIGINT) AS taken
FROM v GROUP BY doc_id, src, size, source_size, target, e
"""

_TRIM = r"regexp_replace(l, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"
LINES = f"""
WITH d AS (SELECT doc_id, source, string_split(text, chr(10)) AS ls, row_number() OVER () AS k FROM documents),
x AS (SELECT k, doc_id, source, l, i, {_TRIM} AS t FROM (SELECT k, doc_id, source, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM d)),
pages AS (SELECT coalesce(source, '') AS h, source IS NULL AS none, count(*) AS n FROM d GROUP BY 1, 2),
bad AS (SELECT h, none, t FROM (SELECT coalesce(source, '') AS h, source IS NULL AS none, t, count(DISTINCT k) AS m FROM x WHERE t <> '' GROUP BY 1, 2, 3) JOIN pages USING (h, none) WHERE m >= {linededup.MIN_PAGES} AND m > n * {linededup.MAX_SHARE}::DOUBLE),
y AS (SELECT x.*, bad.t IS NOT NULL AS gone FROM x LEFT JOIN bad ON bad.h = coalesce(source, '') AND bad.none = (source IS NULL) AND bad.t = x.t)
SELECT d.doc_id, d.source, coalesce(len(d.ls), 0) AS n_lines, coalesce(count(*) FILTER (WHERE gone), 0) AS n_dropped, CASE WHEN d.ls IS NOT NULL THEN sha256(coalesce(string_agg(y.l, chr(10) ORDER BY y.i) FILTER (WHERE NOT gone), '')) END AS kept_sha256
FROM d LEFT JOIN y USING (k) GROUP BY d.k, d.doc_id, d.source, d.ls
"""

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w, row_number() OVER () AS k FROM documents),
x AS (SELECT k, i, array_to_string(w[i : i + 34], ' ') AS win FROM (SELECT k, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
hit AS (SELECT k, i FROM x JOIN (SELECT win FROM x GROUP BY win HAVING count(*) > 1) USING (win)),
gone AS (SELECT DISTINCT k, i + j AS p FROM hit, range(35) t(j)),
kept AS (SELECT k, string_agg(v, ' ' ORDER BY p) AS t, count(*) AS n FROM (SELECT k, unnest(w) AS v, generate_subscripts(w, 1) AS p FROM d) ANTI JOIN gone USING (k, p) GROUP BY k)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (k)
"""

NEAR = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 85 * (p.n + q.n - i)),
e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
cl(id, k) AS (SELECT doc_id, doc_id FROM d UNION SELECT e2.b, cl.k FROM cl JOIN e2 ON e2.a = cl.id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.k AS component_id, d.doc_id = m.k AS kept FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(k) AS k FROM cl GROUP BY id) m ON m.id = d.doc_id
"""

SQL = {"op2_mixing": MIXING, "op5_url_filter": urlfilter.ORACLE, "op6_line_dedup": LINES, "op7_substring_dedup": SUBSTRINGS, "op9_near_dedup": NEAR}
