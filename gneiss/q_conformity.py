"""Queries over conformity with project tables; requests, files and cells are derived from the part table."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.operators import conformity
from gneiss.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


#: A file a part: its variable is the brand, its one dimension the noun of the name. Requests are those of brand and noun.
FOUND = """SELECT p_partkey AS file_id, p_brand AS var, split_part(p_name, ' ', 2) AS name, split_part(p_name, ' ', 1) AS standard_name, p_name AS long_name, p_type AS axis,
  CASE WHEN p_size % 3 = 0 THEN 'K ' WHEN p_size % 3 = 1 THEN 'k' END AS units, 'double' AS type, CASE WHEN p_size % 2 = 0 THEN 'up' ELSE 'down' END AS positive,
  p_retailprice AS lo, p_retailprice + p_size AS hi FROM {part}"""
REQUESTED = """SELECT var, name || '_dim' AS dim, name AS out_name, min(standard_name) AS standard_name, CAST(NULL AS STRING) AS long_name, max(axis) AS axis,
  CASE WHEN count(*) % 4 > 0 THEN 'K' END AS units, CASE WHEN count(*) % 2 = 0 THEN 'double' ELSE 'float' END AS type, min(positive) AS positive,
  (min(lo) + max(lo)) / 2 AS valid_min, max(hi) - 10 AS valid_max FROM ({found}) GROUP BY var, name"""


@query(
    f"""WITH found AS ({FOUND.format(part="part")}), asked AS ({REQUESTED.format(found="SELECT * FROM found")}),
 j AS (SELECT v.file_id, v.var, r.dim, f.file_id AS there, r.standard_name AS rs, f.standard_name AS fs, r.axis AS ra, f.axis AS fa, r.units AS ru, f.units AS fu,
   r.type AS rt, f.type AS ft, r.positive AS rp, f.positive AS fp, valid_min, valid_max, lo, hi
   FROM (SELECT DISTINCT file_id, var FROM found) v JOIN asked r ON v.var = r.var LEFT JOIN found f ON f.file_id = v.file_id AND f.name = r.out_name)
 SELECT file_id, var, dim, '4_4b' AS code FROM j WHERE there IS NULL
 UNION ALL SELECT file_id, var, dim, '4_4c' FROM j WHERE there IS NOT NULL AND lower(trim(rs)) <> lower(trim(coalesce(fs, '')))
 UNION ALL SELECT file_id, var, dim, '4_4e' FROM j WHERE there IS NOT NULL AND lower(trim(ra)) <> lower(trim(coalesce(fa, '')))
 UNION ALL SELECT file_id, var, dim, '4_4f' FROM j WHERE there IS NOT NULL AND lower(trim(ru)) <> lower(trim(coalesce(fu, '')))
 UNION ALL SELECT file_id, var, dim, '4_4l' FROM j WHERE there IS NOT NULL AND lower(trim(rt)) <> lower(trim(coalesce(ft, '')))
 UNION ALL SELECT file_id, var, dim, '4_4m' FROM j WHERE there IS NOT NULL AND lower(trim(rp)) <> lower(trim(coalesce(fp, '')))
 UNION ALL SELECT file_id, var, dim, '4_4j' FROM j WHERE lo < valid_min
 UNION ALL SELECT file_id, var, dim, '4_4k' FROM j WHERE hi > valid_max"""
)
def dimension_conformity(spark, sf_dir):
    """Departures of each file's dimensions from those that the table requests for its variable."""
    found = spark.sql(FOUND.format(part=f"parquet.`{sf_dir}/part.parquet`"))
    asked = spark.sql(REQUESTED.format(found=FOUND.format(part=f"parquet.`{sf_dir}/part.parquet`")))
    return conformity.dimension_faults(found, asked, found)


@query("""WITH v AS (SELECT event_id, user_id AS file_id, event_type AS var FROM events), clim AS (SELECT DISTINCT user_id AS file_id, event_type AS var FROM events WHERE value > 40)
 SELECT event_id, file_id, var FROM v WHERE var <> 'error' AND NOT EXISTS (SELECT 1 FROM clim c WHERE c.file_id = v.file_id AND c.var = v.var)""")
def excluded_variables(spark, sf_dir):
    """Events, a user a file and a type a variable, without one type by name and those that a user's large values name."""
    e = table(spark, sf_dir, "events")
    atts = e.where("value > 40").select(F.col("user_id").alias("file_id"), F.lit("time").alias("var"), F.lit("climatology").alias("att"), F.col("event_type").alias("value"))
    return conformity.included(e.select("event_id", F.col("user_id").alias("file_id"), F.col("event_type").alias("var")), atts, ["error"])


@query("""SELECT l_orderkey, l_linenumber, CAST(floor(round(l_extendedprice * 100) / 256) * 256 AS BIGINT) AS cleared FROM lineitem""")
def cleared_bits(spark, sf_dir):
    """Prices in cents without their lowest eight bits."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", conformity.clear_low_bits(F.round(F.col("l_extendedprice") * 100), 8).alias("cleared"))


@query("""WITH c AS (SELECT p_partkey, p_size * 1.0 AS s, p_retailprice % 50 AS lat, p_partkey % 50 + 0.25 AS lon FROM part)
 SELECT p_partkey, lat > 0 AND lat < s AND lon > lat * 10 / s AND lon < 40 - lat * 30 / s AS inside FROM c WHERE lat <> 0""")
def point_in_cell(spark, sf_dir):
    """Whether a point lies in the triangle (0, 0), (0, 40), (size, 10) of its part."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 1.0).cast("double").alias("s"), (F.col("p_retailprice") % 50).alias("lat"), (F.col("p_partkey") % 50 + 0.25).cast("double").alias("lon"))
    lats, lons = F.array(F.lit(0.0), F.lit(0.0), F.col("s")), F.array(F.lit(0.0), F.lit(40.0), F.lit(10.0))
    at = (F.col("lat"), F.col("lon"), lats, lons)
    return p.where("lat <> 0").select("p_partkey", (conformity.inside(*at) & ~conformity.on_edge(*at)).alias("inside"))
