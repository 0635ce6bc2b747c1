"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations


def _mix(turns: int = 6) -> str:
    """Each turn takes, in order, what fits up to the first document that doesn't, then the one nearest to what is missing."""
    rounds = ""
    for k in range(turns):
        gap = f"SELECT source, any_value(rest) - coalesce(sum(size) FILTER (hit), 0) AS gap FROM {{}}{k} GROUP BY source"
        order = "PARTITION BY d.source ORDER BY key, doc_id, size, rid ROWS UNBOUNDED PRECEDING"
        rounds += f""",
f{k} AS ({gap.format('d')}),
p{k} AS (SELECT rid, sum(size) OVER ({order}) <= gap AS fits FROM d{k} d JOIN f{k} f ON f.source IS NOT DISTINCT FROM d.source WHERE NOT hit AND size <= gap),
e{k} AS (SELECT * REPLACE (hit OR rid IN (SELECT rid FROM p{k} WHERE fits) AS hit) FROM d{k}),
g{k} AS ({gap.format('e')}),
c{k} AS (SELECT rid FROM (SELECT rid, row_number() OVER (PARTITION BY d.source ORDER BY abs(gap - size), key, doc_id, rid) AS rn FROM e{k} d JOIN g{k} g ON g.source IS NOT DISTINCT FROM d.source WHERE NOT hit AND abs(gap - size) < abs(gap)) WHERE rn = 1),
d{k + 1} AS (SELECT * REPLACE (hit OR rid IN (SELECT rid FROM c{k}) AS hit) FROM e{k})"""
    return f"""WITH base AS (SELECT row_number() OVER () AS rid, doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss FROM base GROUP BY source),
wt AS (SELECT *, 2.0::DOUBLE * ss AS cap, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS w FROM src),
ord AS (SELECT *, row_number() OVER o AS j, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_w FROM wt WINDOW o AS (ORDER BY cap / w, source)),
lvl AS (SELECT min_by(((SELECT sum(ss) FROM src) * 1.5::DOUBLE - before) / left_w, j) AS l FROM ord WHERE cap >= w * (((SELECT sum(ss) FROM src) * 1.5::DOUBLE - before) / left_w)),
goal AS (SELECT source, ss, least(cap, w * l) AS target, CASE WHEN ss > 0 THEN CAST(floor(least(cap, w * l) / ss) AS BIGINT) ELSE 0 END AS copies0 FROM wt, lvl),
g AS (SELECT *, target - copies0 * ss AS rest FROM goal),
u AS (SELECT rid, doc_id, base.source, size, rest, ss, (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM base JOIN g ON g.source IS NOT DISTINCT FROM base.source WHERE size > 0 AND rest > 0),
k AS (SELECT *, u / (1 - u) / (rest / ss / (1 - rest / ss) * sqrt(size)) AS key FROM u),
d0 AS (SELECT *, false AS hit FROM k){rounds}
SELECT base.doc_id, base.size, g.ss AS source_size, target, CASE WHEN base.size > 0 THEN copies0 + CASE WHEN coalesce(hit, false) THEN 1 ELSE 0 END ELSE 0 END * base.size AS taken, CASE WHEN base.size > 0 THEN copies0 + CASE WHEN coalesce(hit, false) THEN 1 ELSE 0 END ELSE 0 END AS copies
FROM base JOIN g ON g.source IS NOT DISTINCT FROM base.source LEFT JOIN d{turns} d ON d.rid = base.rid"""


EMBEDDINGS = """WITH RECURSIVE v AS (SELECT row_number() OVER () AS k, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT k, vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.k AS a, b.k AS b FROM ok a JOIN ok b ON a.k <> b.k AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT k, k AS t FROM v UNION SELECT r.k, p.b FROM r JOIN p ON p.a = r.t),
c AS (SELECT r.k, min(v.vec_id) AS component_id FROM r JOIN v ON v.k = r.t GROUP BY r.k),
n AS (SELECT a AS k, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM v JOIN c USING (k) LEFT JOIN n USING (k)"""

_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_KEYS = r"""(?i:pwd|credential|access_key|auth_key|conn_string)["'']?\x20*[:=]\x20*["'']?"""
_WIDER = r"gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{20,}|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}|(?i:bearer)\x20+[A-Za-z0-9+/_.=-]{20,}|" + _KEYS + r"[A-Za-z0-9+/_.=-]{16,}|[a-z]{2,12}://[A-Za-z0-9._-]{1,64}:[A-Za-z0-9._%+!-]{8,}@"
_LEAD = r"^(?:(?i:bearer)\x20+|" + _KEYS + r"|[a-z]{2,12}://[A-Za-z0-9._-]{1,64}:)|@$"
_PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|changeme|redacted|your[_-]|xxxx|12345678|abcdefgh|deadbeef"


def _secrets() -> str:
    kinds = [("assign", _ASSIGN), ("access", "AKIA[A-Z0-9]{14,}"), ("hex", "[0-9a-f]{16,}"), ("wider", _WIDER)]
    parts = " UNION ALL ".join(
        f"SELECT rid, doc_id, source, {k} AS kind, unnest(range(1, len(m) + 1)) AS i, m, regexp_split_to_array(text, '{rx}') AS gap FROM (SELECT *, regexp_extract_all(text, '{rx}') AS m FROM t)" for k, (_, rx) in enumerate(kinds)
    )
    name = "['assign', 'access', 'hex', 'wider'][kind + 1]"
    told = f"string_agg({name} || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop)"
    return f"""WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, source FROM documents), s AS ({parts}),
x AS (SELECT rid, doc_id, source, kind, m[i] AS hit, CAST(list_sum(list_transform(gap[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0) AS BIGINT) AS start FROM s),
y AS (SELECT *, start + length(hit) AS stop, CASE kind WHEN 0 THEN regexp_extract(hit, '{_ASSIGN}', 2) WHEN 3 THEN regexp_replace(hit, '{_LEAD}', '', 'g') ELSE hit END AS secret FROM x),
z AS (SELECT * FROM y WHERE CASE kind WHEN 0 THEN length(secret) >= 12 WHEN 1 THEN length(hit) >= 18 WHEN 2 THEN length(hit) >= 16 ELSE true END),
o AS (SELECT secret, count(DISTINCT coalesce(source, chr(0))) AS owners, count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), chr(0))) AS repos, NOT regexp_matches(secret, '{_PLACEHOLDER}') AND len(list_distinct(string_split(secret, ''))) >= 6 AS drawn FROM z GROUP BY secret),
w AS (SELECT z.*, owners, repos, drawn AND owners < 3 AND repos < 25 AS live FROM z JOIN o USING (secret) WHERE kind < 3 OR (drawn AND owners < 3 AND repos < 25)),
a AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, coalesce({told.replace(', stop)', ', stop) FILTER (kind < 3)')}, '') AS base, {told} AS spans, count(*) FILTER (live) AS n_live, max(owners) AS max_owners, max(repos) AS max_repositories FROM w GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(max_owners, 0) AS max_owners, coalesce(max_repositories, 0) AS max_repositories FROM t LEFT JOIN a USING (rid)"""


def _codes(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Books b and assignments a of each round; the least of distance * entries + entry gives the nearest entry, the first of equals."""
    near = f"min(list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - b.v[i]) * (p.v[i] - b.v[i])))::HUGEINT * {entries} + e) AS m"
    steps = ""
    for k in range(rounds + 1):
        steps += f""",
a{k} AS MATERIALIZED (SELECT rid, part, (m % {entries})::INT AS e, (m // {entries})::BIGINT AS far FROM (SELECT rid, part, {near} FROM p JOIN b{k} b USING (part) GROUP BY rid, part))"""
        if k < rounds:
            steps += f""",
s{k} AS (SELECT part, e, list(mean ORDER BY j) AS v FROM (SELECT part, e, j, floor(sum(v[j])::DOUBLE / count(*))::BIGINT AS mean FROM a{k} JOIN p USING (rid, part), range(1, (SELECT w // {parts} + 1 FROM width)) AS t(j) GROUP BY part, e, j) GROUP BY part, e),
b{k + 1} AS MATERIALIZED (SELECT b.part, b.e, coalesce(s.v, b.v) AS v FROM b{k} b LEFT JOIN s{k} s ON s.part = b.part AND s.e = b.e)"""
    return f"""WITH raw AS (SELECT row_number() OVER () AS rid, vec_id, label, CAST(embedding AS DOUBLE[]) AS c FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0),
width AS (SELECT (max(len(c)) + {parts - 1}) // {parts} * {parts} AS w FROM raw),
k AS MATERIALIZED (SELECT rid, vec_id, label, list_resize(list_transform(c, lambda y: floor(256 * y)::BIGINT), w, 0::BIGINT) AS x FROM raw, width),
p AS MATERIALIZED (SELECT rid, part, x[part * (len(x) // {parts}) + 1 : (part + 1) * (len(x) // {parts})] AS v FROM k, range({parts}) AS t(part)),
b0 AS MATERIALIZED (SELECT part, e, v FROM p JOIN (SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS e FROM k QUALIFY e < {entries}) USING (rid)){steps},
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b{rounds}),
r AS (SELECT rid, string_agg(format('{{:02x}}', e), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM a{rounds} GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN r USING (rid), h"""


ORACLE = {"op1_mix": _mix(), "op5_embeddings": EMBEDDINGS, "op7_secrets": _secrets(), "op13_codes": _codes()}
