"""Queries over cell methods: a text a part, put together of pieces that size, type, brand, name and key choose.

The SQL knows the pieces and judges by them; it reads no text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.operators import cellmethods
from gneiss.sources.shared import dealt

QUERIES, ORACLES = {}, {}

#: Pieces of a text in SQL that both engines run: names, method, condition, comment, further items, damage.
TEXTS = """SELECT *, CASE p_partkey % 17 WHEN 0 THEN ':' || cm WHEN 1 THEN replace(cm, ': ', ':') WHEN 2 THEN cm || ' (open' WHEN 3 THEN cm || ' lev:' ELSE cm END AS text FROM (
 SELECT *, names || ' ' || method || cond || note || more AS cm FROM (
  SELECT p_partkey, p_size, p_size % 8 AS a, CASE p_size % 8 WHEN 0 THEN 'time:' WHEN 1 THEN 'area:' WHEN 2 THEN 'lat: lon:' WHEN 3 THEN 'depth:' WHEN 4 THEN 'air_temperature:' WHEN 5 THEN 'reg:' WHEN 6 THEN 'lat:' ELSE 'surface: time:' END AS names,
   CASE p_type WHEN 'STANDARD' THEN 'mean' WHEN 'LARGE' THEN 'maximum' WHEN 'PROMO' THEN 'standard_deviation' WHEN 'SMALL' THEN 'point' WHEN 'MEDIUM' THEN 'average' ELSE 'sum' END AS method,
   CAST(split_part(p_brand, '#', 2) AS INT) % 12 AS c,
   CASE CAST(split_part(p_brand, '#', 2) AS INT) % 12 WHEN 1 THEN ' where land' WHEN 2 THEN ' where' WHEN 3 THEN ' where marsh' WHEN 4 THEN ' inside land' WHEN 5 THEN ' where typ' WHEN 6 THEN ' where lab' WHEN 7 THEN ' where land over sea'
    WHEN 8 THEN ' where land over typ2' WHEN 9 THEN ' where typ3' WHEN 10 THEN ' where v' WHEN 11 THEN ' where land over' ELSE '' END AS cond,
   split_part(p_name, ' ', 2) AS d,
   CASE split_part(p_name, ' ', 2) WHEN 'bolt' THEN ' (interval: 1 h)' WHEN 'gear' THEN ' (comment: by hand)' WHEN 'plate' THEN ' (comment: x interval: 1 h)' WHEN 'gizmo' THEN ' (interval: 1 foo)' WHEN 'anvil' THEN ' (sampled at noon)' WHEN 'rod' THEN ' (interval: 2 K comment:)' ELSE '' END AS note,
   split_part(p_name, ' ', 1) AS e,
   CASE split_part(p_name, ' ', 1) WHEN 'blue' THEN ' time: mean within days time: mean over days' WHEN 'old' THEN ' time: mean within years time: mean over days' WHEN 'new' THEN ' time: mean within days time: mean over days time: mean over years'
    WHEN 'large' THEN ' time: mean over days' WHEN 'cold' THEN ' time: mean within days time: sum over years time: mean over days' ELSE '' END AS more
  FROM {part}) x) y"""


def _texts(spark, sf_dir):
    return spark.sql(TEXTS.format(part=f"parquet.`{sf_dir}/part.parquet`"))


def _var(name, type, *dims):
    return F.struct(F.lit(name).alias("var"), F.lit(type).alias("type"), F.array(*[F.lit(d) for d in dims]).cast("array<string>").alias("dims"))


def cell_method_faults(spark, sf_dir):
    t = dealt(_texts(spark, sf_dir), ["p_partkey"])
    vars_ = t.select(
        F.col("p_partkey").alias("file_id"),
        F.inline(F.array(_var("time", "double", "time"), _var("lat", "double", "lat"), _var("lon", "double", "lon"), _var("v", "float", "time", "lat", "lon"), _var("reg", "char", "len"), _var("typ", "char", "len"),
                         _var("typ2", "char", "two", "len"), _var("typ3", "char", "len"), _var("lab", "char", "len"))),
    )
    lon = F.col("p_size") % 10 != 9
    att = lambda var, name, value: F.struct(F.lit(var).alias("var"), F.lit(name).alias("att"), value.alias("value"))
    kinds = [att(v, "standard_name", F.lit("area_type")) for v in ("typ", "typ2", "typ3")]
    atts = t.select(
        F.col("p_partkey").alias("file_id"),
        F.inline(F.array(*kinds, att("reg", "standard_name", F.lit("region")), att("lat", "standard_name", F.lit("latitude")), att("lat", "bounds", F.when(F.col("p_size") % 3 == 0, "lat_bnds")),
                         att("lon", "standard_name", F.when(lon, "longitude")), att("lon", "units", F.when(lon, "degrees_east")), att("time", "bounds", F.when(F.col("p_partkey") % 5 > 1, "time_bnds")),
                         att("time", "climatology", F.when(F.col("p_partkey") % 5 < 2, "clim_bnds")), att("v", "coordinates", F.when(F.col("p_size") < 26, "typ typ2 typ3 reg")),
                         att("v", "cell_methods", F.when(F.col("p_partkey") % 23 > 0, F.col("text"))))),
    )
    texts = t.select(F.col("p_partkey").alias("file_id"), F.inline(F.array(*[F.struct(F.lit(v).alias("var"), F.array(*[F.lit(x) for x in xs]).alias("texts")) for v, xs in (("typ", ["land"]), ("typ2", ["sea", "land"]), ("typ3", ["marsh "]))])))
    names = spark.createDataFrame([("air_temperature",), ("longitude",), ("latitude",)], "name string")
    return cellmethods.faults(vars_, atts, names, texts)


ORACLES["cell_method_faults"] = f"""
WITH t AS (SELECT *, p_partkey % 17 AS f, p_partkey % 5 < 2 AS clim, p_partkey % 23 = 0 AS untold, p_size % 10 <> 9 AS has_lon FROM ({TEXTS.format(part="part")}) z),
s AS (
 SELECT *, CASE d WHEN 'gear' THEN 'CF_732a' WHEN 'plate' THEN 'CF_732d' WHEN 'gizmo' THEN 'CF_732b' WHEN 'rod' THEN 'CF_732c' END AS note_code,
  CASE WHEN method = 'average' THEN 'CF_73d' WHEN c = 4 THEN 'CF_733a' WHEN a = 0 THEN NULL WHEN c IN (2, 11) THEN 'CF_733b' WHEN c = 3 THEN 'CF_733c' WHEN c IN (6, 10) THEN 'CF_733d'
   WHEN c = 8 THEN 'CF_733e' WHEN c = 9 THEN 'CF_733f' WHEN c = 5 AND p_size >= 26 THEN 'CF_5j' END AS item_code,
  CASE e WHEN 'blue' THEN 2 WHEN 'old' THEN 2 WHEN 'new' THEN 3 WHEN 'large' THEN 1 WHEN 'cold' THEN 3 ELSE 0 END + CASE WHEN a = 0 THEN 1 ELSE 0 END AS times,
  a <> 0 AND e IN ('blue', 'new') AS periods
 FROM t WHERE NOT untold
), whole AS (SELECT * FROM s WHERE f > 3)
SELECT p_partkey AS file_id, 'v' AS var, code FROM (
 SELECT p_partkey, CASE f WHEN 1 THEN 'CF_73a' WHEN 2 THEN 'CF_732e' ELSE 'CF_73b' END AS code FROM s WHERE f <= 3
 UNION ALL SELECT p_partkey, 'CF_731a' FROM whole WHERE a = 2 AND has_lon
 UNION ALL SELECT p_partkey, note_code FROM whole WHERE note_code IS NOT NULL
 UNION ALL SELECT p_partkey, 'CF_73c' FROM whole WHERE note_code IS NULL AND a IN (3, 7)
 UNION ALL SELECT p_partkey, item_code FROM whole WHERE note_code IS NULL AND item_code IS NOT NULL
 UNION ALL SELECT p_partkey, CASE WHEN times < 2 AND clim THEN 'CF_74a' WHEN times IN (2, 3) AND NOT periods THEN 'CF_74d' WHEN times IN (2, 3) AND NOT clim THEN 'CF_74e' END FROM whole WHERE note_code IS NULL AND item_code IS NULL
 UNION ALL SELECT p_partkey, 'CF_73e' FROM whole WHERE note_code IS NULL AND item_code IS NULL AND method <> 'point' AND ((a = 1 AND (has_lon OR p_size % 3 > 0)) OR a IN (2, 5) OR (a = 6 AND p_size % 3 > 0))
 UNION ALL SELECT p_partkey, 'CF_734a' FROM whole WHERE note_code IS NULL AND item_code IS NULL AND method <> 'point' AND a = 1 AND NOT has_lon
) WHERE code IS NOT NULL
UNION ALL SELECT p_partkey, '', 'CF_74b' FROM t WHERE untold AND clim
"""
QUERIES["cell_method_faults"] = cell_method_faults


def cell_method_items(spark, sf_dir):
    """Every item of the undamaged texts, as the fold reads it."""
    t = _texts(spark, sf_dir).where("p_partkey % 17 > 3").withColumn("items", cellmethods.items("text"))
    i = t.select(F.col("p_partkey").alias("file_id"), F.posexplode("items").alias("pos", "item"))
    w = F.col("item.words")
    return i.select(
        "file_id", "pos", F.array_join("item.names", " ").alias("names"), F.get(w, F.lit(0)).alias("method"), *[cellmethods.after(w, m).alias(f"{m}_") for m in ("where", "over", "within")], F.array_join("item.comments", " ").alias("comments")
    )


ORACLES["cell_method_items"] = f"""
WITH t AS (SELECT * FROM ({TEXTS.format(part="part")}) z WHERE p_partkey % 17 > 3)
SELECT p_partkey AS file_id, 0 AS pos, replace(names, ':', '') AS names, method, CASE WHEN c IN (2) THEN '' WHEN c IN (1, 7, 8, 11) THEN 'land' WHEN c = 3 THEN 'marsh' WHEN c = 5 THEN 'typ' WHEN c = 6 THEN 'lab' WHEN c = 9 THEN 'typ3' WHEN c = 10 THEN 'v' END AS where_,
 CASE c WHEN 7 THEN 'sea' WHEN 8 THEN 'typ2' WHEN 11 THEN '' END AS over_, NULL AS within_, trim(note) AS comments FROM t
UNION ALL SELECT p_partkey, m.pos, 'time', m.method, NULL, m.over_, m.within_, '' FROM t JOIN (VALUES ('blue', 1, 'mean', NULL, 'days'), ('blue', 2, 'mean', 'days', NULL), ('old', 1, 'mean', NULL, 'years'), ('old', 2, 'mean', 'days', NULL),
 ('new', 1, 'mean', NULL, 'days'), ('new', 2, 'mean', 'days', NULL), ('new', 3, 'mean', 'years', NULL), ('large', 1, 'mean', 'days', NULL), ('cold', 1, 'mean', NULL, 'days'), ('cold', 2, 'sum', 'years', NULL), ('cold', 3, 'mean', 'days', NULL)) m(e, pos, method, over_, within_) ON m.e = t.e
"""
QUERIES["cell_method_items"] = cell_method_items
