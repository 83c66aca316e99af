"""Roles of variables in files whose references the lines of orders draw."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.operators import roles
from gneiss.sources.tables import table

QUERIES, ORACLES = {}, {}

#: A file an order, a variable a line. Quantity, flag, discount and status give attributes, supplier and part the reference that a line
#: makes to another line (which may be missing, or itself), the tax its dimensions.
ATTS = """SELECT l_orderkey AS file_id, 'v' || l_linenumber AS var, CASE l_suppkey % 6 WHEN 0 THEN 'ancillary_variables' WHEN 1 THEN 'coordinates' WHEN 2 THEN 'bounds' WHEN 3 THEN 'formula_terms' WHEN 4 THEN 'cell_measures' ELSE 'grid_mapping' END AS att,
  CASE WHEN l_suppkey % 6 IN (3, 4) THEN 'x: v' ELSE 'v' END || (l_partkey % 7) AS value FROM {lineitem}
 UNION ALL SELECT l_orderkey, 'v' || l_linenumber, 'axis', 'X' FROM {lineitem} WHERE l_quantity > 40
 UNION ALL SELECT l_orderkey, 'v' || l_linenumber, 'positive', 'up' FROM {lineitem} WHERE l_returnflag = 'A'
 UNION ALL SELECT l_orderkey, 'v' || l_linenumber, 'cell_methods', 'time: mean' FROM {lineitem} WHERE l_returnflag = 'R'
 UNION ALL SELECT l_orderkey, 'v' || l_linenumber, CASE WHEN l_linestatus = 'F' THEN '_FillValue' ELSE 'missing_value' END, '1' FROM {lineitem} WHERE l_discount < 0.03"""
#: Text, and how many of the dimensions a, b, c, d; one with a dimension of its own name.
VARS = """SELECT l_orderkey AS file_id, 'v' || l_linenumber AS var, CASE WHEN l_quantity < 4 THEN 'char' ELSE 'double' END AS type,
  CASE WHEN l_tax < 0.01 THEN '' WHEN l_tax < 0.02 THEN 'v' || l_linenumber WHEN l_tax < 0.04 THEN 'a' WHEN l_tax < 0.06 THEN 'a,b' ELSE 'a,b,c,d' END AS dims{place} FROM {lineitem}"""


def variable_roles(spark, sf_dir):
    """The roles of lines; of lines that share order and number the first of the table gives the variable."""
    at = f"parquet.`{sf_dir}/lineitem.parquet`"
    place = ", struct(_metadata.file_path, _metadata.row_index) AS place"
    vars_ = spark.sql(VARS.format(lineitem=at, place=place)).withColumn("dims", F.when(F.col("dims") == "", F.array().cast("array<string>")).otherwise(F.split("dims", ",")))
    return roles.variable_roles(vars_, spark.sql(ATTS.format(lineitem=at)), "place")


QUERIES["variable_roles"] = variable_roles

_ROUNDS = 16
_ROUND = """e{k} AS MATERIALIZED (SELECT * FROM e{p} UNION SELECT r.file_id, r.name, r.att, CASE r.att WHEN 'ancillary_variables' THEN 1 ELSE -1 END, r.var FROM refs r
  LEFT JOIN (SELECT file_id, var, sum(side) AS s FROM e{p} GROUP BY 1, 2) s ON s.file_id = r.file_id AND s.var = r.var
  WHERE r.att IN ('coordinates', 'bounds', 'cell_measures', 'grid_mapping') OR (r.att = 'ancillary_variables' AND coalesce(s.s, 0) >= 0) OR (r.att = 'formula_terms' AND s.s < 0))"""

ORACLES["variable_roles"] = f"""
WITH v AS MATERIALIZED (SELECT file_id, var, any_value(type) AS type, any_value(CASE WHEN dims = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(dims, ',') END) AS dims FROM ({VARS.format(lineitem="lineitem", place="")}) GROUP BY 1, 2),
a AS MATERIALIZED ({ATTS.format(lineitem="lineitem")}),
refs AS MATERIALIZED (SELECT DISTINCT a.file_id, a.var, att, v.var AS name FROM a JOIN v ON v.file_id = a.file_id AND v.var = replace(a.value, 'x: ', '') WHERE att IN ('ancillary_variables', 'coordinates', 'bounds', 'formula_terms', 'cell_measures', 'grid_mapping') AND a.var <> v.var),
e0 AS MATERIALIZED (
 SELECT DISTINCT file_id, var, CASE att WHEN 'missing_value' THEN '_FillValue' ELSE att END AS kind, CASE WHEN att IN ('bounds', 'axis', 'positive') THEN -1 ELSE 1 END AS side, '' AS giver FROM a WHERE att <> 'formula_terms'
 UNION SELECT file_id, var, 'dimensions', 1, '' FROM v WHERE len(dims) > 2
 UNION SELECT v.file_id, v.var, 'part', -1, '' FROM v JOIN v w ON w.file_id = v.file_id AND len(v.dims) > 0 AND len(v.dims) < len(w.dims) AND list_has_all(w.dims, v.dims)
 UNION SELECT file_id, var, 'dimension', -1, '' FROM v WHERE list_contains(dims, var)
 UNION SELECT file_id, name, att, -1, var FROM refs WHERE att IN ('coordinates', 'bounds', 'cell_measures', 'grid_mapping')
), {", ".join(_ROUND.format(k=k, p=k - 1) for k in range(1, _ROUNDS))},
b AS (SELECT file_id, var, count(*) FILTER (WHERE side > 0) AS n_data, count(*) FILTER (WHERE side < 0) AS n_auxiliary FROM e{_ROUNDS - 1} GROUP BY 1, 2),
n AS (SELECT file_id, name AS var, list(DISTINCT att) AS kinds FROM refs GROUP BY 1, 2)
SELECT v.file_id, v.var, coalesce(n_data, 0) AS n_data, coalesce(n_auxiliary, 0) AS n_auxiliary,
 CASE WHEN n_auxiliary > n_data AND list_contains(kinds, 'bounds') THEN 'bounds' WHEN n_auxiliary > n_data AND list_contains(kinds, 'grid_mapping') THEN 'map' WHEN type = 'char' THEN 'label' WHEN v.dims = [v.var] THEN 'coordinate'
  WHEN n_auxiliary > n_data AND list_contains(kinds, 'formula_terms') THEN 'term' WHEN n_auxiliary > n_data AND list_contains(kinds, 'cell_measures') THEN 'measure' WHEN coalesce(n_data, 0) >= coalesce(n_auxiliary, 0) THEN 'data' ELSE 'auxiliary' END AS role
FROM v LEFT JOIN b ON b.file_id = v.file_id AND b.var = v.var LEFT JOIN n ON n.file_id = v.file_id AND n.var = v.var
"""
