"""Source, forcing and ensemble member of files that parts and suppliers describe; the SQL judges the pieces and reads no text."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.operators import experiment
from gneiss.sources.shared import dealt

QUERIES, ORACLES = {}, {}

FORCINGS = ["Nat", "Ant", "GHG", "SD", "SI", "Oz", "LU", "Vl", "BC"]
#: Attributes of a file a part in SQL that both engines run; size, type, brand and the words of the name choose their pieces.
FILES = """SELECT p_partkey AS file_id, p_size, p_type, noun, adj, CASE WHEN p_size % 9 = 8 THEN 'fx' ELSE 'mon' END AS frequency, p_type || '-ESM' AS model_id,
  CASE WHEN adj = 'hot' THEN '' WHEN adj = 'cold' THEN 'OTHER ' ELSE p_type || '-ESM ' END || CASE WHEN adj = 'old' THEN 'soon' ELSE '2011' END
   || ' atmosphere: ' || CASE WHEN noun = 'bolt' THEN '' ELSE 'AM3 ' END || CASE noun WHEN 'gear' THEN '' WHEN 'ring' THEN '(am3)' ELSE '(am3, T63L40)' END
   || CASE WHEN p_size % 4 = 0 THEN '; sea ice: ' || CASE WHEN p_size % 8 = 0 THEN 'SIM (sis)' ELSE 'SIM (a, b, c)' END ELSE '; ocean: MOM (mom4, tripolar)' END AS source,
  CASE p_size % 7 WHEN 0 THEN 'N/A' WHEN 1 THEN 'Nat, Ant(GHG and SD)' WHEN 2 THEN 'Nat Ant' WHEN 3 THEN 'Nat,Foo' WHEN 4 THEN 'Nat Foo' WHEN 5 THEN 'GHG' ELSE 'GHG (CO2 and N2O), LU' END AS forcing,
  CASE WHEN p_size % 5 = 0 THEN '0' WHEN p_size % 5 = 1 THEN '1x' ELSE CAST(p_size AS STRING) END AS realization FROM (SELECT p_partkey, p_size, p_type, split_part(p_name, ' ', 1) AS adj, split_part(p_name, ' ', 2) AS noun FROM {part}) p"""


def experiment_faults(spark, sf_dir):
    f = dealt(spark.sql(FILES.format(part=f"parquet.`{sf_dir}/part.parquet`")), ["file_id"])
    atts = f.unpivot("file_id", ["source", "model_id", "forcing", "frequency", "realization"], "att", "value")
    return experiment.experiment_faults(atts, FORCINGS)


QUERIES["experiment_faults"] = experiment_faults
ORACLES["experiment_faults"] = f"""WITH f AS ({FILES.format(part="part")})
 SELECT file_id, 'source' AS att, code FROM (
  SELECT file_id, CASE WHEN adj = 'hot' THEN '2_7b' WHEN adj = 'cold' THEN '2_7b' END AS code FROM f
  UNION ALL SELECT file_id, '2_7c' FROM f WHERE adj IN ('hot', 'old') UNION ALL SELECT file_id, '2_7d' FROM f WHERE noun = 'bolt'
  UNION ALL SELECT file_id, '2_7e' FROM f WHERE noun = 'gear' UNION ALL SELECT file_id, '2_7f' FROM f WHERE noun = 'ring' OR p_size % 8 = 4) WHERE code IS NOT NULL
 UNION ALL SELECT file_id, 'forcing', unnest(CASE p_size % 7 WHEN 2 THEN ['2_6b'] WHEN 3 THEN ['2_6a'] WHEN 4 THEN ['2_6a', '2_6b'] ELSE CAST([] AS VARCHAR[]) END) FROM f
 UNION ALL SELECT file_id, 'realization', CASE WHEN p_size % 5 = 1 THEN '2_5a' WHEN p_size % 5 = 0 THEN '2_5b' ELSE '2_5c' END FROM f WHERE p_size % 5 = 1 OR (p_size % 5 = 0 AND frequency <> 'fx') OR (p_size % 5 > 1 AND frequency = 'fx')"""
