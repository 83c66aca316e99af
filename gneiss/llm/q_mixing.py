"""Query op2: all documents mixed to source weights 5, 2, 1, with the slots of the schedule that take them."""

from gneiss.llm.common import table
from gneiss.llm.mixing import SourceMix


def op2_mixing(spark, sf_dir):
    return SourceMix(table(spark, sf_dir, "documents")).taken


QUERIES = {"op2_mixing": op2_mixing}

ORACLES = {
    "op2_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substring(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight
  FROM sized GROUP BY source
), o AS (
  SELECT *, 3 * source_size AS top, CAST(sum(source_size) OVER () AS BIGINT) AS total,
         CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
         sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM s
), held AS (
  SELECT *, top <= weight * rest / weights AS held FROM o
), t AS (
  SELECT source, source_size,
         CASE WHEN held THEN CAST(top AS DOUBLE)
              ELSE weight * (total - coalesce(CAST(sum(top) FILTER (WHERE held) OVER () AS BIGINT), 0)) / (sum(weight) FILTER (WHERE NOT held) OVER ()) END AS target
  FROM held
), p AS (
  SELECT row_number() OVER (ORDER BY t.source NULLS LAST, d.h, d.size) AS row, d.doc_id, d.size, t.source, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS quota,
         CAST(sum(d.size) OVER (PARTITION BY t.source ORDER BY d.h, d.size ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS start
  FROM sized d JOIN t ON t.source IS NOT DISTINCT FROM d.source
), q AS (
  SELECT *, row_number() OVER w - 1 AS sid, count(*) OVER () AS k, CAST(ceil(quota / 256) AS BIGINT) AS need, CAST(floor(CAST(sum(quota) OVER w AS DOUBLE) / CAST(sum(quota) OVER () AS DOUBLE) * 2147483648) AS BIGINT) AS hi
  FROM (SELECT DISTINCT source, quota FROM p) WINDOW w AS (ORDER BY source NULLS LAST ROWS UNBOUNDED PRECEDING)
), stretch AS (
  SELECT *, coalesce(lag(hi) OVER (ORDER BY source NULLS LAST), 0) AS lo FROM q
), n AS (
  SELECT CAST(ceil(sum(size) / 256) AS BIGINT) AS n FROM sized
), points AS (
  SELECT slot, (slot % 2147483648) * 1327217885 % 2147483648 AS u FROM (SELECT unnest(range(n)) AS slot FROM n)
), ranked AS (
  SELECT source, need, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM points JOIN stretch ON u >= lo AND u < hi
), slots AS (
  SELECT source, slot, rank FROM ranked WHERE rank < need
  UNION ALL
  SELECT source, n + rank * k + sid AS slot, rank FROM (
    SELECT s.source, k, sid, unnest(range(coalesce(got, 0), need)) AS rank FROM stretch s LEFT JOIN (SELECT source, count(*) AS got FROM ranked GROUP BY 1) r ON r.source IS NOT DISTINCT FROM s.source
  ), n
), cut AS (
  SELECT row, source, a, z, unnest(range(a // 256, (z - 1) // 256 + 1)) AS rank FROM (
    SELECT row, source, turn * source_size + start AS a, least(turn * source_size + start + size, quota) AS z
    FROM p, (SELECT unnest([0, 1, 2]) AS turn) WHERE size > 0 AND turn * source_size + start < quota
  )
), taken AS (
  SELECT row, CAST(sum(least(z, (c.rank + 1) * 256) - greatest(a, c.rank * 256)) AS BIGINT) AS taken, min(slot) AS first_slot, count(*) AS n_slots
  FROM cut c JOIN slots s ON s.rank = c.rank AND s.source IS NOT DISTINCT FROM c.source GROUP BY row
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, first_slot, coalesce(n_slots, 0) AS n_slots FROM p LEFT JOIN taken USING (row)
"""
}
