"""SQL counterparts of the queries that SQL can express."""

from __future__ import annotations

from .queries import MIN_SITES, SPAM_HOST, URL_RULES
from .quality_rules import NON_SYMBOLS, SPACES, LineRules


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


LINES = f"""
WITH l AS (
  SELECT doc_id, source, pos, x, trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS x,
               generate_subscripts(string_split(text, chr(10)), 1) AS pos
        FROM documents)),
b AS (SELECT line, min(struct_pack(d := doc_id, p := pos)) AS first
      FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
k AS (SELECT l.*, b.line IS NOT NULL AND struct_pack(d := l.doc_id, p := l.pos) <> b.first AS gone
      FROM l LEFT JOIN b ON l.line = b.line),
t AS (SELECT doc_id, coalesce(string_agg(x, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS cleaned,
             count(*) FILTER (WHERE line <> '') AS n_lines, count(*) FILTER (WHERE gone) AS n_removed
      FROM k GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN coalesce(n_removed, 0) = 0 THEN d.text ELSE cleaned END AS text,
       coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id
"""

PAGES = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""


def _quality() -> str:
    rules = LineRules()
    spaces = _quoted(SPACES)
    solid = lambda c: f"length(regexp_replace({c}, {spaces}, '', 'g'))"
    passes = (
        f"regexp_matches(x, {_quoted(rules.closing)}) AND NOT regexp_matches(x, {_quoted(rules.navigation)}) "
        f"AND NOT regexp_matches(x, {_quoted(rules.boilerplate)})"
    )
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), {spaces}), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM d),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2]) AS n FROM i),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY doc_id),
c AS (SELECT d.doc_id, len(w) AS n_words, {solid('text')} AS word_chars,
             length(regexp_replace(text, {_quoted(NON_SYMBOLS)}, '', 'g')) AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(lines) AS n_lines,
             coalesce({solid(f"array_to_string(list_filter(lines, lambda x: {passes}), chr(10))")}, 0) AS kept_chars
      FROM d LEFT JOIN r ON d.doc_id = r.doc_id)
SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed,
       NOT (n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words)
       AND kept_chars >= {rules.min_kept_share} * word_chars AS kept
FROM c
"""


def _urls() -> str:
    arms = []
    for host, path, verdict in sorted(URL_RULES, key=lambda r: -len(r[0] + r[1])):
        fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
        arms.append((fits, host + path, verdict))
    rule = " ".join(f"WHEN {fits} THEN '{name}'" for fits, name, _ in arms)
    verdict = " ".join(f"WHEN {fits} THEN '{v}'" for fits, _, v in arms)
    return f"""
WITH u AS (SELECT page_id, lower(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')) AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
SELECT page_id, host, path, CASE {rule} END AS rule,
       CASE {verdict} WHEN regexp_matches(host, '{SPAM_HOST}') THEN 'block' ELSE 'allow' END AS verdict
FROM u
"""


def llm_oracles() -> dict[str, str]:
    return {"op1_line_dedup": LINES, "op5_warc": PAGES, "op7_quality_rules": _quality(), "op10_url_filter": _urls()}
