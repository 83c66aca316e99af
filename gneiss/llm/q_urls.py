"""Query op12: every page's URL against five rules and the vocabulary."""

from gneiss.llm.common import table
from gneiss.llm.urls import SEVERAL, SOFT, STRICT, judged

# The rules of the query.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op12_url_filters(spark, sf_dir):
    return judged(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).drop("url")


QUERIES = {"op12_url_filters": op12_url_filters}

_TERMS = ", ".join(f"('{t}', {w})" for terms, w in ((STRICT, SEVERAL), (SOFT, 1)) for t in terms)
_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)

ORACLES = {
    "op12_url_filters": rf"""
WITH p AS (
  SELECT page_id, row_number() OVER () AS n,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path,
         ' ' || replace(regexp_replace(translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' ', '  ') || ' ' AS words
  FROM pages
), r AS (SELECT * FROM (VALUES {_RULES}) AS t(verdict, h, start)),
t AS (SELECT weight, ' ' || replace(term, ' ', '  ') || ' ' AS term FROM (VALUES {_TERMS}) AS t(term, weight)),
ruled AS (
  SELECT n, arg_max(h || start, length(h || start)) AS rule, arg_max(verdict, length(h || start)) AS verdict
  FROM p JOIN r ON (p.host = h OR suffix(p.host, '.' || h)) AND starts_with(p.path, start) GROUP BY n
), found AS (
  SELECT n, weight, term, (length(words) - length(replace(words, term, ''))) // length(term) AS hits FROM p JOIN t ON contains(words, term)
), counted AS (
  SELECT n, CAST(sum(hits) FILTER (weight = {SEVERAL}) AS BIGINT) AS strict_hits, CAST(sum(hits) FILTER (weight = 1) AS BIGINT) AS soft_hits, count(*) FILTER (weight = 1) AS soft_terms FROM found GROUP BY n
)
SELECT page_id, host, path, rule, coalesce(ruled.verdict, CASE WHEN coalesce(strict_hits, 0) > 0 OR coalesce(soft_terms, 0) >= {SEVERAL} THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(strict_hits, 0) AS strict_hits, coalesce(soft_hits, 0) AS soft_hits, coalesce(soft_terms, 0) AS soft_terms
FROM p LEFT JOIN ruled USING (n) LEFT JOIN counted USING (n)
"""
}
