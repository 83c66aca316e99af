"""Queries over convention rules, a query a chapter: layouts derived from the part table, and SQL that restates the rules."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from gneiss.operators import conventions
from gneiss.sources.shared import dealt
from gneiss.sources.tables import table

QUERIES, ORACLES = {}, {}

#: A layout in SQL that both engines run: names, types and attributes of five variables a file depend on size, brand, price and key.
VARS = """SELECT p_partkey AS file_id, 'lon' AS var, 'double' AS type, 'lon' AS dims FROM {part} UNION ALL
SELECT p_partkey, 'lat', CASE WHEN p_size > 48 THEN 'string' ELSE 'double' END, 'lat' FROM {part} UNION ALL
SELECT p_partkey, 'time', 'double', 'time' FROM {part} UNION ALL
SELECT p_partkey, CASE WHEN p_size < 3 THEN 'time-bnds' ELSE 'time_bnds' END, 'double', CASE WHEN p_retailprice > 1500 THEN 'time' ELSE 'time,bnds' END FROM {part} UNION ALL
SELECT p_partkey, CASE WHEN p_size = 7 THEN 'LON' ELSE 'tas' END, CASE WHEN p_size % 2 = 0 THEN 'float' ELSE 'short' END,
       CASE WHEN p_size % 5 = 0 THEN 'lat,lon,time' WHEN p_size % 7 = 1 THEN 'time,lat,lat' ELSE 'time,lat,lon' END FROM {part}"""
DIMS = """SELECT p_partkey AS file_id, 'lon' AS dim, 10 AS size FROM {part} UNION ALL SELECT p_partkey, 'lat', 10 FROM {part} UNION ALL SELECT p_partkey, 'time', 10 FROM {part}
UNION ALL SELECT p_partkey, 'bnds', 2 FROM {part}"""
ATTS = """SELECT p_partkey AS file_id, 'lon' AS var, 'units' AS att, 'char' AS att_type, CASE WHEN p_size % 11 <> 0 THEN 'degrees_east' END AS value FROM {part} UNION ALL
SELECT p_partkey, 'lon', 'standard_name', 'char', 'longitude' FROM {part} UNION ALL
SELECT p_partkey, 'lon', 'axis', 'char', CASE WHEN p_size % 13 = 0 THEN 'Q' WHEN p_size % 13 = 1 THEN 'Y' ELSE 'X' END FROM {part} UNION ALL
SELECT p_partkey, 'lat', 'units', 'char', 'degrees_north' FROM {part} UNION ALL
SELECT p_partkey, 'lat', 'standard_name', 'char', CASE WHEN p_size % 17 <> 0 THEN 'latitude' END FROM {part} UNION ALL
SELECT p_partkey, 'lat', 'positive', 'char', CASE WHEN p_size % 19 = 0 THEN 'up' WHEN p_size % 19 = 1 THEN 'left' END FROM {part} UNION ALL
SELECT p_partkey, 'time', 'standard_name', 'char', 'time' FROM {part} UNION ALL
SELECT p_partkey, 'time', 'units', 'char', CASE WHEN p_size % 6 = 0 THEN 'days from 1850' WHEN p_size % 6 > 1 THEN 'days since 1850-01-01' END FROM {part} UNION ALL
SELECT p_partkey, 'time', 'bounds', 'char', CASE WHEN p_size % 9 = 0 THEN 'no_bnds' ELSE 'time_bnds' END FROM {part} UNION ALL
SELECT p_partkey, 'tas', 'standard_name', 'char', CASE WHEN p_size % 4 = 0 THEN 'air_temperature' WHEN p_size % 4 = 1 THEN 'air_temprature' WHEN p_size % 4 = 2 THEN 'air_temperature standard_eror' END FROM {part} UNION ALL
SELECT p_partkey, 'tas', 'units', 'char', CASE WHEN p_size % 3 = 0 THEN 'W m-2' ELSE 'K' END FROM {part} UNION ALL
SELECT p_partkey, 'tas', 'comment', CASE WHEN p_size % 10 = 3 THEN 'string' ELSE 'char' END, CASE WHEN p_size % 10 = 4 THEN ' ' ELSE p_name END FROM {part} UNION ALL
SELECT p_partkey, 'tas', 'coordinates', 'char', CASE WHEN p_size % 8 < 4 THEN p_brand || ' lat' END FROM {part} UNION ALL
SELECT p_partkey, 'tas', 'grid_mapping', 'char', CASE WHEN p_size % 8 = 6 THEN 'rotated_pole' END FROM {part} UNION ALL
SELECT p_partkey, 'tas', '_FillValue', 'float', '1e20' FROM {part} UNION ALL
SELECT p_partkey, 'tas', 'scale_factor', CASE WHEN p_size % 5 = 2 THEN 'double' ELSE 'float' END, CASE WHEN p_size % 5 > 1 THEN '0.1' END FROM {part} UNION ALL
SELECT p_partkey, 'tas', 'add_offset', 'float', CASE WHEN p_size % 5 > 1 THEN '1.0' END FROM {part} UNION ALL
SELECT p_partkey, 'tas', 'cell_measures', 'char', CASE WHEN p_size % 6 = 5 THEN 'areas: lon' WHEN p_size % 6 > 2 THEN 'area: areacella' END FROM {part} UNION ALL
SELECT p_partkey, 'tas', 'cf_role', 'char', CASE WHEN p_size % 12 = 0 THEN 'station' WHEN p_size % 12 = 1 THEN 'profile_id' END FROM {part} UNION ALL
SELECT p_partkey, '', 'Conventions', 'char', CASE WHEN p_size % 14 = 0 THEN 'CF1' WHEN p_size % 14 = 1 THEN 'CF-1.3' WHEN p_size % 14 > 2 THEN 'CF-1.6' END FROM {part} UNION ALL
SELECT p_partkey, '', 'featureType', 'char', CASE WHEN p_size % 15 = 0 THEN 'profile series' WHEN p_size % 15 = 1 THEN 'point' END FROM {part}"""
NAMES = [("longitude", "degree"), ("latitude", "degree"), ("time", "s"), ("air_temperature", "K")]


def _columns(select: str) -> list[str]:
    """The expressions of a select list: what commas outside of quotes and brackets part, without names behind ``AS``."""
    out, depth, quoted, word = [], 0, False, ""
    for c in select + ",":
        quoted ^= c == "'"
        depth += 0 if quoted else (c == "(") - (c == ")")
        if c == "," and not depth and not quoted:
            out.append(re.sub(r"\s+AS\s+\w+\s*$", "", word).strip())
            word = ""
        else:
            word += c
    return out


def _rows(part, union: str, names: list[str]):
    """A union of selects from the part table as one scan: every branch is an element of an array."""
    branches = [re.sub(r"^\s*SELECT\s+|\s+FROM \{part\}\s*$", "", x.strip()) for x in re.split(r"UNION ALL", union)]
    structs = [", ".join(f"'{n}', {e}" for n, e in zip(names, _columns(b)[1:], strict=True)) for b in branches]
    each = F.expr(f"inline(array({', '.join(f'named_struct({x})' for x in structs)}))")
    return part.select(F.col("p_partkey").alias("file_id"), each)


def _layout(spark, sf_dir):
    part = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name", "p_brand", "p_retailprice"), ["p_partkey"])
    vars_ = _rows(part, VARS, ["var", "type", "dims"]).withColumn("dims", F.split("dims", ","))
    atts, dims = _rows(part, ATTS, ["var", "att", "att_type", "value"]), _rows(part, DIMS, ["dim", "size"])
    return conventions.described(vars_, atts, dims.withColumn("size", F.col("size").cast("long")), spark.createDataFrame(NAMES, "name string, units string"))


_WITH = f"""WITH v AS ({VARS.format(part="part")}), t AS ({ATTS.format(part="part")}), a AS (SELECT * FROM t WHERE value IS NOT NULL),
 x AS (SELECT v.*, string_split(dims, ',') AS ds, {", ".join(f"max(a.value) FILTER (WHERE a.att = '{n}') AS {n.lower().strip('_')}, max(a.att_type) FILTER (WHERE a.att = '{n}') AS {n.lower().strip('_')}_type" for n in ("units", "standard_name", "axis", "positive", "bounds", "comment", "coordinates", "grid_mapping", "_FillValue", "scale_factor", "add_offset", "cell_measures", "cf_role"))}
  FROM v LEFT JOIN a ON a.file_id = v.file_id AND a.var = v.var GROUP BY v.file_id, v.var, v.type, v.dims),
 f AS (SELECT p_partkey AS file_id, max(a.value) FILTER (WHERE att = 'Conventions') AS conventions, max(a.value) FILTER (WHERE att = 'featureType') AS feature FROM part LEFT JOIN a ON a.file_id = p_partkey AND a.var = '' GROUP BY 1),
 names AS (SELECT file_id, list(var) AS names FROM v GROUP BY 1),
 y AS (SELECT x.*, names, CASE WHEN units = 'degrees_east' OR standard_name = 'longitude' THEN 'X' WHEN units = 'degrees_north' OR standard_name = 'latitude' THEN 'Y' WHEN standard_name = 'time' THEN 'T' END AS role FROM x JOIN names USING (file_id))"""


def _chapter(number, sql):
    def query(spark, sf_dir):
        return conventions.findings(_layout(spark, sf_dir), [number])

    QUERIES[f"conventions_chapter_{number}"] = query
    ORACLES[f"conventions_chapter_{number}"] = f"{_WITH} SELECT file_id, var, code FROM ({sql})"


_V, _F = "SELECT file_id, var, '{0}' AS code FROM y WHERE {1}", "SELECT file_id, '' AS var, '{0}' AS code FROM f WHERE {1}"


def _all(rules, files=()):
    return " UNION ALL ".join([_V.format(c, w) for c, w in rules] + [_F.format(c, w) for c, w in files])


_chapter(0, _all([("CF_0g", "trim(comment) = ''")]) + " UNION ALL SELECT file_id, '', 'CF_0b' FROM y GROUP BY file_id HAVING NOT bool_or(list_contains(ds, 'bnds'))")
_chapter(2, _all(
    [("CF_22a", "type = 'string'"), ("CF_22b", "comment_type = 'string'"), ("CF_23a", "var LIKE '%-%'"), ("CF_23b", "len([n for n in names if lower(n) = lower(var)]) > 1"), ("CF_24a", "len(list_distinct(ds)) < len(ds)"),
     ("CF_24b", "dims = 'lat,lon,time'"), ("CF_26a", "fillvalue_type <> type")],
    [("CF_261a", "conventions IS NULL"), ("CF_261b", "conventions = 'CF1'"), ("CF_261c", "conventions = 'CF-1.3'")],
))
_chapter(3, _all([
    ("CF_32a", "standard_name IS NULL AND NOT (var = 'time_bnds' AND EXISTS (SELECT 1 FROM y z WHERE z.file_id = y.file_id AND z.bounds = 'time_bnds'))"), ("CF_33a", "string_split(standard_name, ' ')[1] NOT IN ('longitude', 'latitude', 'time', 'air_temperature')"), ("CF_33b", "standard_name LIKE '% %'"),
    ("CF_33e", "standard_name = 'air_temperature' AND units <> 'K'"),
]))
_chapter(4, _all([
    ("CF_4a", "axis NOT IN ('X', 'Y', 'Z', 'T')"), ("CF_4b", "axis <> role"), ("CF_41b", "var IN ('lon', 'lat') AND units IS NULL"), ("CF_43a", "positive NOT IN ('up', 'down')"),
    ("CF_43b", "positive IS NOT NULL AND role <> 'Z'"), ("CF_44a", "var = 'time' AND units IS NULL"), ("CF_44b", "var = 'time' AND units NOT LIKE '% since %'"),
]))
_chapter(5, _all([("CF_5a", "len([c for c in string_split(coordinates, ' ') if NOT list_contains(names, c)]) > 0"), ("CF_56c", "NOT list_contains(names, grid_mapping)")]))
_chapter(7, _all([
    ("CF_71b", "var = 'time_bnds' AND len(ds) <> 2 AND EXISTS (SELECT 1 FROM y z WHERE z.file_id = y.file_id AND z.bounds = 'time_bnds')"), ("CF_71g", "bounds IS NOT NULL AND NOT list_contains(names, bounds)"),
    ("CF_72b", "cell_measures NOT LIKE 'area: %' AND cell_measures NOT LIKE 'volume: %'"), ("CF_72d", "cell_measures LIKE '%: %' AND NOT list_contains(names, string_split(cell_measures, ': ')[2])"),
]))
_chapter(8, _all([("CF_81a", "scale_factor_type <> add_offset_type"), ("CF_81b", "scale_factor_type = add_offset_type AND scale_factor_type <> type AND type NOT IN ('byte', 'short', 'int')")]))
_chapter(9, _all([("CF_9e", "cf_role NOT IN ('timeseries_id', 'profile_id', 'trajectory_id')")], [("CF_9a", "feature LIKE '% %'"), ("CF_9d", "feature <> 'point'")]))
