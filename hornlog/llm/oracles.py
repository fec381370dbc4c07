"""DuckDB SQL that gives the same rows as the queries that SQL can express."""

from __future__ import annotations

from .url_filters import LIMIT, LONG_SUFFIXES, RULES, Z

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = f"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_WORDS = "regexp_extract_all({0}, '[^\\x20\\x09-\\x0D]+')"

DECONTAMINATE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS w FROM documents),
b AS (SELECT item_id, {_TERMS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, s, s + least(len(w), 10) - 1), ' ') AS t
       FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(s) WHERE len(w) > 0),
ln AS (SELECT DISTINCT n FROM bw),
dl AS (SELECT rid, w, n FROM d, ln),
dw AS (SELECT rid, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS t FROM dl, unnest(range(1, len(w) - n + 2)) AS u(s)),
hits AS (SELECT DISTINCT rid, s, n, item_id FROM dw JOIN bw USING (n, t)),
cover AS (SELECT rid, count(DISTINCT p) AS n_hit FROM hits, unnest(range(s, s + n)) AS u(p) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS i FROM hits WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (rid) LEFT JOIN items USING (rid)
"""

NEAR = """
WITH RECURSIVE d AS (SELECT doc_id, {words} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, s, s + 3), ' ') AS x FROM d, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS u(s) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 80 * (na.n + nb.n - common)),
s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, s.b FROM r JOIN s ON r.y = s.a),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
""".replace("{words}", _WORDS.format(_LOWER.format("coalesce(text, '')")))

SUBSTRING = """
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
x AS (SELECT doc_id, s, sha256(array_to_string(list_slice(w, s, s + 49), ' ')) AS h FROM d, unnest(range(1, len(w) - 48)) AS u(s)),
m AS (SELECT h, min(doc_id) AS least FROM x GROUP BY h),
g AS (SELECT DISTINCT doc_id, s + k AS p FROM x JOIN m USING (h), unnest(range(0, 50)) AS u(k) WHERE doc_id > least),
r AS (SELECT doc_id, list(p) AS gone FROM g GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_select(w, list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i))) END, ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
""".replace("{words}", _WORDS.format("coalesce(text, '')"))


def _urls() -> str:
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN" for _, h, p in ordered]
    rule = " ".join(f"{f} '{h}{p}'" for f, (_, h, p) in zip(fits, ordered, strict=True))
    verdict = " ".join(f"{f} '{v}'" for f, (v, _, _) in zip(fits, ordered, strict=True))
    long = ", ".join(f"'{s}'" for s in LONG_SUFFIXES)
    last = lambda k: f"array_to_string(string_split(host, '.')[-{k}:], '.')"
    over = "sum((y - n * p) * (y - n * p) - n * p * (1 - p)) / nullif(sum(n * (n - 1) * p * (1 - p)), 0)"
    strength = lambda table: f"(SELECT (1 - r) / r FROM (SELECT least(0.99, greatest(1e-3, coalesce({over}, 1e-3))) AS r FROM {table}))"
    return f"""
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
f AS (SELECT page_id, coalesce({_LOWER.format("regexp_extract(rest, '^[^/?#]*', 0)")}, '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM a),
k AS (SELECT *, CASE WHEN {last(2)} IN ({long}) THEN {last(3)} ELSE {last(2)} END AS domain, CASE WHEN {last(2)} IN ({long}) THEN {last(2)} ELSE {last(1)} END AS suffix FROM f),
i AS (SELECT DISTINCT page_id, regexp_extract(path, '/([0-9]{{1,18}})[^0-9/]*/?$', 1) AS doc FROM f),
l AS (SELECT doc_id, max(CAST(coalesce(quality = 0, false) OR coalesce(toxic = 1, false) AS INTEGER)) AS bad FROM labels GROUP BY doc_id),
o AS (SELECT page_id, max(bad) AS bad FROM i JOIN l ON doc <> '' AND TRY_CAST(doc AS BIGINT) = doc_id GROUP BY page_id),
h AS (SELECT host, domain, suffix, CAST(count(bad) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS y FROM k LEFT JOIN o USING (page_id) GROUP BY ALL),
dm AS (SELECT domain, suffix, sum(n) AS n, sum(y) AS y FROM h GROUP BY ALL),
sx AS (SELECT suffix, sum(n) AS n, sum(y) AS y FROM dm GROUP BY ALL),
s1 AS (SELECT *, (SELECT (coalesce(sum(y), 0) + 0.5) / (coalesce(sum(n), 0) + 1.0) FROM sx) AS p FROM sx),
s2 AS (SELECT suffix, (y + m * p) / (n + m) AS p FROM s1, (SELECT {strength("s1")} AS m)),
d1 AS (SELECT domain, n, y, p FROM dm JOIN s2 USING (suffix)),
d2 AS (SELECT domain, (y + m * p) / (n + m) AS p FROM d1, (SELECT {strength("d1")} AS m)),
h1 AS (SELECT host, n, y, p FROM h JOIN d2 USING (domain)),
h2 AS (SELECT host, y + m * p AS a, n - y + m * (1 - p) AS b FROM h1, (SELECT {strength("h1")} AS m)),
h3 AS (SELECT host, a / (a + b) - {Z} * sqrt(a * b / ((a + b + 1) * (a + b) * (a + b))) AS lower FROM h2)
SELECT page_id, host, path, CASE {rule} END AS rule, coalesce(CASE {verdict} END, CASE WHEN lower > {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
FROM f LEFT JOIN h3 USING (host)
"""


ORACLE = {"op1_decontaminate": DECONTAMINATE, "op3_url_filters": _urls(), "op5_near_duplicates": NEAR, "op6_substring_dedup": SUBSTRING}
