"""One fault a file: every convention rule against files of which each breaks one rule.

A sound layout is changed in one place; which one depends on a part's size and brand, so that each part is a file. The SQL lists
what the conventions say about each change; sound files have no findings.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.operators import conventions
from gneiss.sources.shared import dealt
from gneiss.sources.tables import table

VARS = [
    ("time", "double", "time"), ("time_bnds", "double", "time,bnds"), ("lev", "double", "lev"), ("rlat", "double", "rlat"), ("rlon", "double", "rlon"), ("lat", "double", "rlat,rlon"), ("lon", "double", "rlat,rlon"),
    ("rotated_pole", "char", ""), ("areacella", "double", "rlat,rlon"), ("ps", "double", "time,rlat,rlon"), ("tas", "float", "time,lev,rlat,rlon"), ("quality", "byte", "time,lev,rlat,rlon"),
]
DIMS = [("time", 10), ("bnds", 2), ("lev", 5), ("rlat", 20), ("rlon", 30)]
ATTS = [
    ("time", "standard_name", "char", "time"), ("time", "units", "char", "days since 1850-01-01"), ("time", "axis", "char", "T"), ("time", "bounds", "char", "time_bnds"), ("time", "calendar", "char", "standard"),
    ("lev", "standard_name", "char", "air_pressure"), ("lev", "units", "char", "hPa"), ("lev", "axis", "char", "Z"), ("lev", "positive", "char", "down"),
    ("rlat", "standard_name", "char", "grid_latitude"), ("rlat", "units", "char", "degrees"), ("rlat", "axis", "char", "Y"), ("rlon", "standard_name", "char", "grid_longitude"), ("rlon", "units", "char", "degrees"), ("rlon", "axis", "char", "X"),
    ("lat", "standard_name", "char", "latitude"), ("lat", "units", "char", "degrees_north"), ("lon", "standard_name", "char", "longitude"), ("lon", "units", "char", "degrees_east"),
    ("rotated_pole", "grid_mapping_name", "char", "rotated_latitude_longitude"), ("areacella", "standard_name", "char", "cell_area"), ("areacella", "units", "char", "m2"), ("ps", "standard_name", "char", "surface_air_pressure"), ("ps", "units", "char", "Pa"),
    ("tas", "standard_name", "char", "air_temperature"), ("tas", "units", "char", "K"), ("tas", "coordinates", "char", "lon lat"), ("tas", "grid_mapping", "char", "rotated_pole"), ("tas", "cell_measures", "char", "area: areacella"),
    ("tas", "ancillary_variables", "char", "quality"), ("tas", "cell_methods", "char", "time: mean"), ("tas", "_FillValue", "float", "1e20"), ("quality", "long_name", "char", "quality of tas"), ("quality", "flag_values", "byte", "1, 2, 4"),
    ("quality", "flag_meanings", "char", "good fair bad"), ("", "Conventions", "char", "CF-1.6"),
]
NAMES = [
    ("time", "s"), ("air_pressure", "Pa"), ("grid_latitude", "degree"), ("grid_longitude", "degree"), ("latitude", "degree"), ("longitude", "degree"), ("cell_area", "m2"), ("surface_air_pressure", "Pa"), ("air_temperature", "K"),
    ("atmosphere_sigma_coordinate", "1"), ("height", "m"), ("number_of_counts", "1"),
]


def att(var, name, value, kind="char"):
    return ("att", var, name, kind, value)


def var(name, kind, dims):
    return ("var", name, kind, dims)


#: Changes of the sound layout (a value or dims of None takes the row out) and what is found then.
FAULTS = [
    ([], []),
    ([("dim", "spare", 3)], [("", "CF_0b")]),
    ([att("tas", "comment", " ")], [("tas", "CF_0g")]),
    ([var("tas", "string", "time,lev,rlat,rlon"), att("tas", "_FillValue", None)], [("tas", "CF_22a")]),
    ([att("tas", "comment", "text", "string")], [("tas", "CF_22b")]),
    ([var("2m-tas", "float", "time,lev,rlat,rlon"), att("2m-tas", "long_name", "t")], [("2m-tas", "CF_23a")]),
    ([att("tas", "my-note", "x")], [("tas", "CF_23a")]),
    ([var("TAS", "float", "time,lev,rlat,rlon"), att("TAS", "long_name", "t")], [("tas", "CF_23b"), ("TAS", "CF_23b")]),
    ([var("areacella", "double", "rlat,rlat")], [("areacella", "CF_24a")]),
    ([var("ps", "double", "rlat,time,rlon")], [("ps", "CF_24b")]),
    ([att("tas", "valid_min", "1.0", "float"), att("tas", "valid_max", "1e30", "float")], [("tas", "CF_251a")]),
    ([att("tas", "valid_range", "0 1e30", "float")], [("tas", "CF_251a")]),
    ([att("", "Conventions", None)], [("", "CF_261a")]),
    ([att("", "Conventions", "CF1")], [("", "CF_261b")]),
    ([att("", "Conventions", "CF-1.3")], [("", "CF_261c")]),
    ([att("tas", "_FillValue", "1e20", "double")], [("tas", "CF_26a")]),
    ([att("tas", "long_name", "5", "int")], [("tas", "CF_26b")]),
    ([att("quality", "valid_min", "1", "char")], [("quality", "CF_26a"), ("quality", "CF_26c")]),
    ([att("tas", "units", "level"), att("tas", "standard_name", None), att("tas", "long_name", "t")], [("tas", "CF_31a")]),
    ([att("quality", "long_name", None)], [("quality", "CF_32a")]),
    ([att("tas", "standard_name", "air_temprature")], [("tas", "CF_33a")]),
    ([att("tas", "standard_name", "air_temperature standard_eror")], [("tas", "CF_33b")]),
    ([att("tas", "standard_name", "air_temperature standard_error x")], [("tas", "CF_33c")]),
    ([att("tas", "standard_name", "air_temperature number_of_observations")], [("tas", "CF_33d")]),
    ([att("tas", "units", "W m-2")], [("tas", "CF_33e")]),
    ([att("lat", "units", "m")], [("lat", "CF_33e")]),
    ([att("tas", "ancillary_variables", "quality gone")], [("tas", "CF_34a")]),
    ([att("quality", "flag_meanings", "good fair")], [("quality", "CF_35a")]),
    ([att("quality", "flag_meanings", None)], [("quality", "CF_35d")]),
    ([att("quality", "flag_values", "1, 2, 2", "byte")], [("quality", "CF_35e")]),
    ([att("quality", "flag_values", None), att("quality", "flag_masks", "1, 0, 4", "byte")], [("quality", "CF_35f")]),
    ([att("quality", "flag_meanings", "good fa,ir bad")], [("quality", "CF_35g")]),
    ([att("quality", "flag_masks", "1, 1, 4", "byte")], [("quality", "CF_35i")]),
    ([att("rlon", "axis", "E")], [("rlon", "CF_4a"), ("rlon", "CF_4b")]),
    ([att("rlon", "axis", "Y")], [("rlon", "CF_4b")]),
    ([att("rlon", "units", None)], [("rlon", "CF_41b")]),
    ([att("rlon", "standard_name", None), att("rlon", "long_name", "x")], [("rlon", "CF_41c")]),
    ([att("lev", "positive", "left")], [("lev", "CF_43a")]),
    ([att("ps", "positive", "up")], [("ps", "CF_43b")]),
    ([att("lev", "positive", None), att("lev", "units", "m"), att("lev", "standard_name", "height")], [("lev", "CF_43c")]),
    ([att("lev", "units", None), att("lev", "standard_name", None), att("lev", "long_name", "level")], [("lev", "CF_43d")]),
    ([att("lev", "standard_name", "atmosphere_sigma_coordinate"), att("lev", "units", "1")], [("lev", "CF_432a")]),
    ([att("lev", "standard_name", "atmosphere_sigma_coordinate"), att("lev", "units", "1"), att("lev", "formula_terms", "sigma lev ps ps")], [("lev", "CF_432c")]),
    ([att("lev", "standard_name", None), att("lev", "long_name", "level"), att("lev", "formula_terms", "sigma: lev ps: ps")], [("lev", "CF_432d")]),
    ([att("lev", "standard_name", "atmosphere_sigma_coordinate"), att("lev", "units", "1"), att("lev", "formula_terms", "sigma: lev ps: gone")], [("lev", "CF_432g")]),
    ([att("time", "units", None), att("time", "axis", None)], [("time", "CF_44a")]),
    ([att("time", "units", "days from 1850")], [("time", "CF_44b")]),
    ([att("time", "units", "days since 0-1-1")], [("time", "CF_44c")]),
    ([att("ps", "calendar", "noleap")], [("ps", "CF_44d")]),
    ([att("time", "month_lengths", "31, 28, 31", "int")], [("time", "CF_441a")]),
    ([att("time", "leap_month", "2", "int")], [("time", "CF_441b")]),
    ([att("time", "leap_month", "13", "int"), att("time", "leap_year", "4", "int")], [("time", "CF_441c")]),
    ([att("tas", "coordinates", "lon gone")], [("tas", "CF_5a")]),
    ([var("ps", "double", "time,ps")], [("ps", "CF_5c")]),
    ([att("lat", "axis", "Y")], [("lat", "CF_5f")]),
    ([att("ps", "grid_mapping", "gone")], [("ps", "CF_56c")]),
    ([var("rotated_pole", "char", "rlon")], [("rotated_pole", "CF_56d")]),
    ([att("rotated_pole", "grid_mapping_name", None)], [("rotated_pole", "CF_56f")]),
    ([att("rotated_pole", "grid_mapping_name", "rotated")], [("rotated_pole", "CF_56g")]),
    ([var("lev", "double", "")], [("lev", "CF_57a")]),
    ([var("time_bnds", "double", "time")], [("time_bnds", "CF_71b"), ("", "CF_0b")]),
    ([var("time_bnds", "char", "time,bnds")], [("time_bnds", "CF_71c")]),
    ([var("time_bnds", "double", "bnds,time")], [("time_bnds", "CF_71d")]),
    ([att("time_bnds", "units", "hours since 1850-01-01")], [("time_bnds", "CF_71f")]),
    ([att("ps", "bounds", "gone")], [("ps", "CF_71g")]),
    ([att("time_bnds", "missing_value", "1e20", "double")], [("time_bnds", "CF_71h")]),
    ([att("time_bnds", "bounds", "ps")], [("time_bnds", "CF_71i"), ("ps", "CF_71d")]),
    ([att("tas", "cell_measures", "areas: areacella")], [("tas", "CF_72b")]),
    ([att("tas", "cell_measures", "area: gone")], [("tas", "CF_72d")]),
    ([att("tas", "cell_methods", "time: mean (interval: 1 h")], [("tas", "CF_732e")]),
    ([att("ps", "climatology", "time_bnds"), att("time", "bounds", None)], [("ps", "CF_74c"), ("time_bnds", "CF_71b")]),
    ([att("tas", "scale_factor", "0.1", "float"), att("tas", "add_offset", "1", "double")], [("tas", "CF_81a")]),
    ([att("tas", "add_offset", "1", "double")], [("tas", "CF_81b")]),
    ([att("quality", "scale_factor", "1", "short")], [("quality", "CF_81c")]),
    ([var("quality", "int", "time,lev,rlat,rlon"), att("quality", "flag_values", "1, 2, 4", "int"), att("quality", "scale_factor", "0.5", "float")], [("quality", "CF_81d")]),
    ([att("ps", "compress", "rlat rlon")], [("ps", "CF_82a")]),
    ([att("quality", "compress", "rlat gone")], [("quality", "CF_82b")]),
    ([att("", "featureType", "profile series")], [("", "CF_9a"), ("", "CF_9d")]),
    ([att("", "featureType", "grid")], [("", "CF_9d")]),
    ([att("tas", "featureType", "point")], [("tas", "CF_9b")]),
    ([att("", "cf_role", "profile_id")], [("", "CF_9c")]),
    ([att("tas", "cf_role", "station")], [("tas", "CF_9e")]),
    ([att("ps", "sample_dimension", "gone")], [("ps", "CF_932d")]),
    ([var("tas", None, None), var("quality", None, None), var("ps", None, None), var("areacella", None, None), var("lat", None, None), var("lon", None, None), var("rotated_pole", None, None)], [("", "CF_0f")]),
]


def layouts() -> tuple[list, list, list]:
    """The variables, attributes and dimensions of every changed layout, numbered."""
    vars_, atts, dims = [], [], []
    for m, (changes, _) in enumerate(FAULTS):
        v, a, d = {n: (t, ds) for n, t, ds in VARS}, {(n, x): (t, y) for n, x, t, y in ATTS}, dict(DIMS)
        for kind, *c in changes:
            if kind == "var":
                v[c[0]] = (c[1], c[2])
            elif kind == "att":
                a[c[0], c[1]] = (c[2], c[3])
            else:
                d[c[0]] = c[1]
        there = {n for n, (_, ds) in v.items() if ds is not None}
        vars_ += [(m, n, t, ds) for n, (t, ds) in v.items() if n in there]
        atts += [(m, n, x, t, y) for (n, x), (t, y) in a.items() if y is not None and (not n or n in there)]
        dims += [(m, n, size) for n, size in d.items()]
    return vars_, atts, dims


def convention_faults(spark, sf_dir):
    """All rules of all chapters in one pass over files of which each breaks one rule."""
    part = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand"), ["p_partkey"])
    brand = F.regexp_extract("p_brand", "[0-9]+", 0).cast("int")
    files = part.select(F.col("p_partkey").alias("file_id"), ((F.col("p_size") * 25 + brand) % len(FAULTS)).alias("m"))
    vars_, atts, dims = layouts()
    of = lambda rows, schema: files.join(F.broadcast(spark.createDataFrame(rows, f"m int, {schema}")), "m").drop("m")
    dims_of = F.when(F.col("dims") == "", F.array().cast("array<string>")).otherwise(F.split("dims", ","))
    d = conventions.described(
        of(vars_, "var string, type string, dims string").withColumn("dims", dims_of), of(atts, "var string, att string, att_type string, value string"), of(dims, "dim string, size long"), spark.createDataFrame(NAMES, "name string, units string")
    )
    return conventions.findings(d)


QUERIES = {"convention_faults": convention_faults}

_FOUND = ", ".join(f"({m}, '{v}', '{c}')" for m, (_, found) in enumerate(FAULTS) for v, c in found)

ORACLES = {
    "convention_faults": f"""SELECT p_partkey AS file_id, f.var, f.code FROM part
 JOIN (VALUES {_FOUND}) f(m, var, code) ON m = (p_size * 25 + CAST(split_part(p_brand, '#', 2) AS INT)) % {len(FAULTS)}"""
}
