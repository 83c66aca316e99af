"""Queries over directory structures and requirement tables: rule files are written from the part table and read by their readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gneiss.operators import drs
from gneiss.sources.shared import shared_folder
from gneiss.sources.tables import table
from gneiss.sources.vocabulary import requirements, vocabulary

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


def _file(spark, lines, name):
    """A text file of ``lines`` (a DataFrame of one column, or a list) in the shared folder."""
    at = f"{shared_folder(spark)}/rules-{uuid.uuid4().hex}/{name}"
    rows = lines if hasattr(lines, "write") else spark.createDataFrame([(x,) for x in lines], "value string")
    rows.coalesce(1).write.text(at)
    return at


VOCABULARY = """BEGIN: DRS
# directory structures (DS) and file names (FE)
  LONG-DS: <activity>/<product>/<institute>/<model>\\
           /<variable name>/<version number>
  SHORT-DS: <activity>/<institute>/<model>/<variable name>
  ANY-FE: <variable name>_<model>_<institute>_<season>.nc
  <activity>          = project_id
  <product>           = product     = output | output1
  <institute>         = institute_id
  <model>             = model_id
  <variable name>
  <version number>
END: DRS
DATA_VAR:
  VAR_TYPE=float
AUX_VAR:
  VAR_TYPE=double"""

#: A file a part in SQL that both engines run: what its attributes say, and its path and name, wrong for some sizes.
FILES = """SELECT p_partkey AS file_id, p_size, p_partkey % 2 AS short, split_part(p_name, ' ', 2) AS var, split_part(p_brand, '#', 2) AS inst, CASE WHEN p_size % 23 = 0 THEN '' ELSE split_part(p_brand, '#', 2) || '-' END || p_type AS model,
  CASE WHEN p_size % 3 = 0 THEN '/' ELSE '' END || 'data/' || CASE WHEN p_size % 4 = 0 THEN 'part' ELSE 'PART' END || '/' || CASE WHEN p_partkey % 2 = 1 THEN '' WHEN p_size % 17 = 0 THEN 'output9/' WHEN p_size % 17 = 1 THEN 'output1/' ELSE 'output/' END
   || CASE WHEN p_size % 11 = 0 THEN 'I' ELSE '' END || split_part(p_brand, '#', 2) || '/' || CASE WHEN p_size % 13 = 0 THEN '' ELSE CASE WHEN p_size % 23 = 0 THEN '' ELSE split_part(p_brand, '#', 2) || '-' END || p_type || '/' END
   || split_part(p_name, ' ', 2) || CASE WHEN p_partkey % 2 = 1 THEN '' WHEN p_size % 7 = 0 THEN '/latest' ELSE '/v' || p_size END AS path,
  CASE WHEN p_size % 5 = 0 THEN split_part(p_name, ' ', 1) ELSE split_part(p_name, ' ', 2) END || '_' || CASE WHEN p_size % 23 = 0 THEN '' ELSE split_part(p_brand, '#', 2) || '-' END || p_type
   || CASE WHEN p_size % 19 = 0 THEN '' ELSE '_' || split_part(p_brand, '#', 2) END || CASE WHEN p_size % 19 = 0 THEN '' WHEN p_size % 19 = 1 THEN '_DJF_x' ELSE '_DJF' END || '.nc' AS name FROM {part}"""


@query(f"""WITH f AS ({FILES.format(part="part")}),
 w AS (SELECT *, CASE WHEN p_size % 13 = 0 THEN NULL WHEN p_size % 11 = 0 THEN 'institute' WHEN short = 0 AND p_size % 17 = 0 THEN 'product' WHEN short = 0 AND p_size % 7 = 0 THEN 'version number' END AS bad FROM f)
 SELECT file_id, '1_2' AS code, CASE short WHEN 1 THEN 'SHORT-DS' ELSE 'LONG-DS' END AS encoding, CASE WHEN short = 0 AND p_size % 17 = 0 THEN 'product' ELSE bad END AS component FROM w WHERE bad IS NOT NULL
 UNION ALL SELECT file_id, '1_2', CASE WHEN short = 1 OR p_size % 11 > 0 THEN 'SHORT-DS' WHEN p_size % 7 > 0 THEN 'LONG-DS' ELSE 'LONG-DS' END, 'activity' FROM w WHERE p_size % 13 = 0
 UNION ALL SELECT file_id, '1_1', 'ANY-FE', CASE WHEN p_size % 5 = 0 THEN 'variable name' WHEN p_size % 19 = 0 THEN 'institute' END FROM f WHERE p_size % 5 = 0 OR p_size % 19 < 2
 UNION ALL SELECT file_id, '1_4', NULL, 'model' FROM f WHERE p_size % 23 = 0
 UNION ALL SELECT NULL, '7_3', 'ANY-FE', 'season'""")
def structure_faults(spark, sf_dir):
    """Paths, names and model names of files against a vocabulary file."""
    f = spark.sql(FILES.format(part=f"parquet.`{sf_dir}/part.parquet`"))
    att = lambda name, value: F.struct(F.lit(name).alias("att"), value.alias("value"))
    atts = f.select("file_id", F.inline(F.array(att("project_id", F.lit("PART")), att("product", F.lit("output")), att("institute_id", F.col("inst")), att("model_id", F.col("model")))))
    words = vocabulary(spark, _file(spark, VOCABULARY.split("\n"), "vocabulary.csv"))
    return drs.structure_faults(f, atts, words, "DRS", {"variable name": "var"}, {"model": "institute"})


#: The rows of a requirement table: a noun and a type, asked for as the smallest part of both has them; a type is a sheet.
REQUIRED = """SELECT p_type AS sheet, split_part(p_name, ' ', 2) AS entry, min(split_part(p_name, ' ', 1)) AS standard_name, 'the long name of ' || split_part(p_name, ' ', 2) || ' and of others' AS long_name,
  'K' || (min(p_size) % 3) AS units, CASE WHEN count(*) % 5 > 0 THEN 'time: mean' END AS cell_methods FROM {part} WHERE p_size > 25 GROUP BY p_type, split_part(p_name, ' ', 2)"""
VARIABLES = """SELECT p_partkey AS file_id, CASE WHEN p_size % 29 = 0 THEN 'fx' ELSE p_type END AS sheet, CASE WHEN p_size % 9 = 0 THEN upper(split_part(p_name, ' ', 2)) ELSE split_part(p_name, ' ', 2) END AS var, CASE WHEN p_size % 10 = 0 THEN 'double' ELSE 'float' END AS type,
  CASE WHEN p_size % 6 = 0 THEN 'auxiliary' ELSE 'data' END AS role, split_part(p_name, ' ', 1) AS standard_name,
  CASE WHEN p_size % 8 = 0 THEN 'The Long Name of ' || split_part(p_name, ' ', 2) || ' and of others' WHEN p_size % 8 = 1 THEN 'some text' WHEN p_size % 8 = 2 THEN NULL ELSE 'the lonng name of ' || split_part(p_name, ' ', 2) || ' and others' END AS long_name,
  'K' || (p_size % 3) AS units, CASE WHEN p_size % 7 = 0 THEN 'time:  mean ' WHEN p_size % 7 = 1 THEN 'time: sum' WHEN p_size % 7 > 2 THEN 'time: mean' END AS cell_methods FROM {part}"""


@query(f"""WITH v AS ({VARIABLES.format(part="part")}), r AS ({REQUIRED.format(part="part")}),
 j AS (SELECT v.*, r.entry, r.standard_name AS rs, r.units AS ru, r.cell_methods AS rc FROM v LEFT JOIN r ON r.sheet = v.sheet AND r.entry = lower(v.var))
 SELECT file_id, var, '3_1' AS code FROM j WHERE entry IS NULL AND role = 'data'
 UNION ALL SELECT file_id, var, '3_2' FROM j WHERE (role = 'data') = (type = 'double')
 UNION ALL SELECT file_id, var, '3_8' FROM j WHERE entry <> var
 UNION ALL SELECT file_id, var, '3_3' FROM j WHERE rs <> standard_name
 UNION ALL SELECT file_id, var, '3_4' FROM j WHERE entry IS NOT NULL AND (long_name IS NULL OR long_name = 'some text')
 UNION ALL SELECT file_id, var, '3_6' FROM j WHERE ru <> units
 UNION ALL SELECT file_id, var, '3_7' FROM j WHERE rc IS NOT NULL AND sheet <> 'fx' AND (cell_methods IS NULL OR cell_methods = 'time: sum')""")
def requirement_faults(spark, sf_dir):
    """Variables against a requirement file, sheet by sheet, and their types against a vocabulary file."""
    part = f"parquet.`{sf_dir}/part.parquet`"
    need = spark.sql(REQUIRED.format(part=part)).orderBy("sheet", "entry")
    cells = F.concat_ws(",", "entry", "standard_name", "long_name", "units", F.coalesce("cell_methods", F.lit("")))
    caption = F.concat(F.lit("Table:,"), F.col("sheet"), F.lit("\noutput variable name,standard name,long name,units,cell_methods\n"))
    lines = need.groupBy("sheet").agg(F.concat(F.first(caption), F.array_join(F.array_sort(F.collect_list(cells)), "\n")).alias("value")).select("value")
    asked = requirements(spark, _file(spark, lines, "requirements.csv"))
    types = vocabulary(spark, _file(spark, VOCABULARY.split("\n"), "vocabulary.csv"))
    return drs.requirement_faults(spark.sql(VARIABLES.format(part=part)), asked, types)
