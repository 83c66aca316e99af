"""Query op4: the rule ledger of all documents under the base and the full policy, and what leaving out one rule would free."""

from pyspark.sql import functions as F

from gneiss.llm.common import materialise, table
from gneiss.llm.quality_rules import BASE_POLICY, POLICY, ledger, verdict, with_ablation


def op4_quality_rules(spark, sf_dir):
    rows = with_ablation(materialise(ledger(table(spark, sf_dir, "documents")), "ledger"), POLICY)
    base = ~verdict(BASE_POLICY)
    return rows.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & verdict(POLICY)).alias("kept"),
        F.col("failed").alias("failed_bits"), "freed_by", "n_freed",
    )


QUERIES = {"op4_quality_rules": op4_quality_rules}

ORACLES = {
    "op4_quality_rules": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines
  FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1
), rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(regexp_extract_all(text, '[A-Z]')) AS BIGINT) AS n_capitals,
         CAST(len(regexp_extract_all(text, '!')) AS BIGINT) AS n_exclamations,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id
), f AS (
  SELECT *, CAST((CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN 10 * n_dup_lines > 5 * n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 16 ELSE 0 END)
    + (CASE WHEN 2 * n_capitals > word_chars THEN 32 ELSE 0 END) + (CASE WHEN 4 * n_exclamations > n_words THEN 64 ELSE 0 END) AS BIGINT) AS failed_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits, rule AS freed_by,
       CASE WHEN rule IS NOT NULL THEN count(*) OVER (PARTITION BY failed_bits) END AS n_freed
FROM f LEFT JOIN (VALUES (1, 'too_short'), (2, 'repetition'), (4, 'symbols'), (8, 'line_copies'), (16, 'word_length'), (32, 'capitals'), (64, 'exclamations')) r(bit, rule) ON bit = failed_bits
"""
}
