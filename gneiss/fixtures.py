"""The driver tables as archive models, with defects put in by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.sources.tables import attributes, table


def event_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station cells (var, day, event_id, user_id, v): NaN and fill values by event_id, day 7 constant, day 23 a thousandfold."""
    e = table(spark, sf_dir, "events")
    day = F.to_date("ts")
    v = (
        F.when(F.col("event_id") % 97 == 0, F.lit(float("nan")))
        .when(F.col("event_id") % 89 == 0, F.lit(1e20))
        .when(F.dayofmonth(day) == 7, 5.0)
        .when(F.dayofmonth(day) == 23, F.col("value") * 1000)
        .otherwise(F.col("value"))
    )
    return e.select(F.col("event_type").alias("var"), day.alias("day"), "event_id", "user_id", v.alias("v"))


EVENT_CELLS = """cells AS (
  SELECT event_type AS var, CAST(ts AS DATE) AS day, event_id, user_id,
         CASE WHEN event_id % 97 = 0 THEN CAST('nan' AS DOUBLE) WHEN event_id % 89 = 0 THEN 1e20
              WHEN day(CAST(ts AS DATE)) = 7 THEN 5.0 WHEN day(CAST(ts AS DATE)) = 23 THEN value * 1000 ELSE value END AS v
  FROM events)"""

RECORDS = (
    EVENT_CELLS
    + """, records AS (
  SELECT var, day, count(*) FILTER (WHERE ok) AS n, count(*) AS size, min(v) FILTER (WHERE ok) AS mn, max(v) FILTER (WHERE ok) AS mx,
         avg(v) FILTER (WHERE ok) AS ave, stddev_samp(v) FILTER (WHERE ok) AS std,
         count(*) FILTER (WHERE isnan(v)) AS nan_count, count(*) FILTER (WHERE v = 1e20) AS fill_count
  FROM (SELECT *, NOT isnan(v) AND v <> 1e20 AS ok FROM cells) GROUP BY var, day)"""
)


def file_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each (supplier, year): begin and end from shipments, a name whose dates are those of the year's months."""
    l = table(spark, sf_dir, "lineitem")
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1970-01-01").cast("date"))
    g = l.groupBy("l_suppkey", F.year("l_shipdate").alias("year")).agg(F.min(day).alias("begin"), F.max(day).alias("end"), F.count("*").alias("size"))
    # a file in ten reaches a year further than it should, one in seven is named by year alone
    end = F.when((F.col("l_suppkey") + F.col("year")) % 10 == 0, F.col("end") + 365).otherwise(F.col("end"))
    short = (F.col("l_suppkey") * 3 + F.col("year")) % 70 == 0
    d0 = F.concat(F.col("year").cast("string"), F.when(short, "").otherwise("01"))
    d1 = F.concat(F.col("year").cast("string"), F.when(short, "").otherwise("12"))
    return g.select("l_suppkey", "year", "begin", end.alias("end"), "size", d0.alias("d_beg"), d1.alias("d_end"), F.concat(F.lit("supp"), F.col("l_suppkey").cast("string"), F.lit("_"), d0, F.lit("-"), d1, F.lit(".nc")).alias("name"))


FILES = """files AS (
  SELECT l_suppkey, year, "begin", CASE WHEN (l_suppkey + year) % 10 = 0 THEN "end" + 365 ELSE "end" END AS "end", size,
         year || (CASE WHEN short THEN '' ELSE '01' END) AS d_beg, year || (CASE WHEN short THEN '' ELSE '12' END) AS d_end,
         'supp' || l_suppkey || '_' || year || (CASE WHEN short THEN '' ELSE '01' END) || '-' || year || (CASE WHEN short THEN '' ELSE '12' END) || '.nc' AS name
  FROM (SELECT l_suppkey, year(l_shipdate) AS year, (l_suppkey * 3 + year(l_shipdate)) % 70 = 0 AS short,
               min(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))) AS "begin", max(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))) AS "end", count(*) AS size
        FROM lineitem GROUP BY ALL))"""


def part_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, att, value): brand and type of each part; the type is missing for one in eleven."""
    p = table(spark, sf_dir, "part").withColumn("p_type", F.when(F.col("p_partkey") % 11 != 0, F.col("p_type")))
    return attributes(p, "p_partkey", ["p_brand", "p_type"]).where("value is not null")


PART_ATTS = """atts AS (
  SELECT p_partkey, 'p_brand' AS att, p_brand AS value FROM part
  UNION ALL SELECT p_partkey, 'p_type', p_type FROM part WHERE p_partkey % 11 <> 0)"""
