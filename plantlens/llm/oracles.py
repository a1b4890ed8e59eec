"""SQL twins of those queries of this subpackage that SQL can express."""

from __future__ import annotations

from plantlens.llm import quality, url_filter

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

MINHASH = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS x FROM d),
n AS (SELECT doc_id, count(x) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 80 * (a.n + b.n - c)),
both_ AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
reach AS (SELECT u AS doc_id, u AS node FROM both_ UNION SELECT r.doc_id, b.v FROM reach r JOIN both_ b ON b.u = r.node),
comp AS (SELECT doc_id, min(node) AS c FROM reach GROUP BY doc_id)
SELECT doc_id, n AS n_shingles, coalesce(c, doc_id) AS component_id, doc_id = coalesce(c, doc_id) AS kept FROM n LEFT JOIN comp USING (doc_id)"""

QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
pos AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS tri FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, tri) AS k FROM pos) WHERE k > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id),
lines AS (SELECT doc_id, host, text, line, {_WORDS.format("line")} AS lw FROM (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d)),
worded AS (SELECT doc_id, host, text, line, len(lw) AS k, array_to_string(list_transform(lw, lambda x: {_LOWER.format('x')}), ' ') AS norm FROM lines WHERE len(lw) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM worded GROUP BY doc_id),
hosts AS (SELECT host, count(DISTINCT text) AS docs FROM d GROUP BY host),
often AS (SELECT w.host, norm FROM worded w JOIN hosts h ON h.host = w.host GROUP BY w.host, norm, docs HAVING count(DISTINCT text) > {quality.LEAST_DOCUMENTS} AND count(DISTINCT text) > docs * CAST({quality.SHARE} AS DOUBLE)),
gone AS (SELECT doc_id, CAST(sum(k) AS BIGINT) AS removed_words FROM worded JOIN often USING (host, norm) GROUP BY doc_id),
c AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed_words, 0) AS removed_words
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, removed_words > CAST({quality.MOST_REMOVED} AS DOUBLE) * n_words AS depleted FROM c)
SELECT *, NOT base_failed AND NOT depleted AS kept FROM f"""


def _rule_case(column: str) -> str:
    order = sorted(url_filter.RULES, key=lambda r: (-len(r.text), r.action != "block", r.text))
    fits = " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, column)}'" for r in order)
    return f"CASE {fits} END"


def _rounds() -> str:
    step = "r{0} AS (SELECT kind, host, sum(rank) AS rank FROM (SELECT kind, host, rank * (1 - {1}) AS rank FROM r0 UNION ALL SELECT r.kind, dst, rank * part * {1} FROM r{2} r JOIN steps s ON s.kind = r.kind AND s.host = r.host) GROUP BY kind, host)"
    return ",\n".join(step.format(i, f"CAST({url_filter.DAMPING} AS DOUBLE)", i - 1) for i in range(1, url_filter.ROUNDS + 1))


URLS = f"""
WITH u AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, html, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
ruled AS (SELECT page_id, host, path, {_rule_case('text')} AS rule, {_rule_case('action')} AS action FROM h),
links AS (SELECT host AS src, dst, count(*) AS w FROM (SELECT DISTINCT page_id, host, {_LOWER.format("dst")} AS dst FROM (SELECT page_id, host, unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']?\\s*(?:[a-z]+:)?//([^/"''?#>\\s]+)', 1)) AS dst FROM h)) WHERE host <> '' AND host <> dst GROUP BY host, dst),
known AS (SELECT host FROM h WHERE host <> '' UNION SELECT dst FROM links),
edges AS (SELECT src, dst, CAST(sum(w) AS DOUBLE) AS w FROM (SELECT src, dst, w FROM links UNION ALL SELECT host, substr(host, instr(host, '.') + 1), 1 FROM known WHERE len(string_split(host, '.')) >= 3) GROUP BY src, dst),
both_ AS (SELECT 'trust' AS kind, src AS host, dst, w FROM edges UNION ALL SELECT 'distrust', dst, src, w FROM edges),
steps AS (SELECT kind, host, dst, w / sum(w) OVER (PARTITION BY kind, host) AS part FROM both_),
seeds AS (SELECT CASE action WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) AS w FROM ruled WHERE rule IS NOT NULL GROUP BY 1, 2),
r0 AS (SELECT kind, host, w / sum(w) OVER (PARTITION BY kind) AS rank FROM seeds),
{_rounds()},
t AS (SELECT host, coalesce(sum(rank) FILTER (WHERE kind = 'trust'), 0) AS trust, coalesce(sum(rank) FILTER (WHERE kind = 'distrust'), 0) AS distrust FROM r{url_filter.ROUNDS} GROUP BY host)
SELECT page_id, ruled.host, path, rule, coalesce(action, CASE WHEN distrust > {url_filter.BLOCK_SHARE} * (trust + distrust) THEN 'block' ELSE 'allow' END) AS verdict, round(coalesce(trust, 0), 9) AS trust, round(coalesce(distrust, 0), 9) AS distrust
FROM ruled LEFT JOIN t ON t.host = ruled.host"""

ORACLE_SQL = {"op4_minhash_dedup": MINHASH, "op6_url_filter": URLS, "op7_quality_rules": QUALITY}
