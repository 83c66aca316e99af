"""Files of sampled features, of which each breaks one rule, and compressed indexes of lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.operators import sampling
from gneiss.sources.shared import dealt
from gneiss.sources.tables import table

QUERIES, ORACLES = {}, {}

# A contiguous ragged array of time series: counts of observations a station.
VARS = [
    ("lat", "double", "station", "coordinate", "Y"), ("lon", "double", "station", "coordinate", "X"), ("name", "char", "station,len", "label", None), ("count", "int", "station", "auxiliary", None),
    ("time", "double", "station,obs", "auxiliary", "T"), ("temp", "float", "station,obs", "data", None), ("land", "int", "land", "auxiliary", None),
]
DIMS = [("station", 3), ("obs", 12), ("len", 8), ("land", 4), ("row", 5), ("col", 4), ("depth", 6)]
ATTS = [("", "featureType", "timeSeries"), ("name", "cf_role", "timeseries_id"), ("count", "sample_dimension", "obs"), ("land", "compress", "row col")]
VALUES = [("count", 3), ("count", 4), ("count", 5), ("land", 1), ("land", 7), ("land", 19)]


def var(name, kind, dims, role="auxiliary", axis=None):
    return ("var", name, kind, dims, role, axis)


def att(name, key, value):
    return ("att", name, key, value)


_SCALAR = [var("lat", "double", "", "coordinate", "Y"), var("lon", "double", "", "coordinate", "X"), att("name", "cf_role", "timeseries_id")]
#: Changes of the sound layout (None takes a row out) and what is found then.
FAULTS = [
    ([], []),
    ([att("name", "cf_role", "profile_id")], [("", "CF_9f")]),
    ([att("", "featureType", "profile"), att("name", "cf_role", "profile_id")], [("", "CF_9g")]),
    ([att("name", "cf_role", None)], [("", "CF_9h")]),
    ([att("", "featureType", None)], [("", "CF_9i")]),
    ([att("", "featureType", None), var("time", "double", "obs", "auxiliary", "T")], [("", "CF_94a")]),
    ([("values", "count", [3, 4, 6])], [("count", "CF_932a")]),
    ([att("count", "sample_dimension", None), var("temp", "float", "obs", "data"), var("lat", "double", "", "coordinate", "Y"), var("lon", "double", "", "coordinate", "X"), var("time", "double", "obs", "auxiliary", "T")], [("count", "CF_932b")]),
    ([var("count", "double", "station")], [("count", "CF_932c")]),
    ([att("count", "sample_dimension", None), var("count", "int", "obs"), ("values", "count", [0, 0, 1, 2]), var("temp", "float", "obs", "data"), var("lat", "double", "", "coordinate", "Y"), var("lon", "double", "", "coordinate", "X"), var("time", "double", "obs", "auxiliary", "T")], [("count", "CF_932e")]),
    ([var("more", "int", "station"), att("more", "sample_dimension", "obs")], [("", "CF_932f")]),
    ([("values", "land", [0, 7])], [("land", "CF_82c")]),
    ([("values", "land", [1, 20])], [("land", "CF_82d")]),
    ([("values", "land", [1, 21])], [("land", "CF_82e")]),
    ([("values", "land", [-1, 7])], [("land", "CF_82e")]),
    ([*_SCALAR, var("time", "double", "obs", "auxiliary", "T"), var("temp", "float", "obs", "data")], []),
    ([att("", "featureType", "trajectory"), att("name", "cf_role", "trajectory_id"), var("lat", "double", "station,obs", "auxiliary", "Y"), var("lon", "double", "station,obs", "auxiliary", "X")], []),
    ([att("", "featureType", "profile"), att("name", "cf_role", "profile_id"), var("time", "double", "station", "auxiliary", "T"), var("z", "double", "depth", "auxiliary", "Z"), var("temp", "float", "station,depth", "data")], []),
    ([att("", "featureType", "timeSeriesProfile"), var("z", "double", "depth", "auxiliary", "Z"), var("temp", "float", "station,obs,depth", "data")], []),
    ([att("", "featureType", "point"), att("name", "cf_role", None), var("time", "double", "station", "auxiliary", "T"), var("temp", "float", "station", "data")], []),
    ([att("", "featureType", None), var("lat", "double", "row", "coordinate", "Y"), var("lon", "double", "col", "coordinate", "X"), var("temp", "float", "obs,row,col", "data"), var("time", "double", "obs", "auxiliary", "T")], []),
]


def _rows():
    vars_, atts, dims, values = [], [], [], []
    for m, (changes, _) in enumerate(FAULTS):
        v, a, x = {n: (t, ds, r, ax) for n, t, ds, r, ax in VARS}, {(n, k): y for n, k, y in ATTS}, {}
        for n, y in VALUES:
            x.setdefault(n, []).append(y)
        for kind, *c in changes:
            if kind == "var":
                v[c[0]] = tuple(c[1:])
            elif kind == "att":
                a[c[0], c[1]] = c[2]
            else:
                x[c[0]] = c[1]
        vars_ += [(m, n, *rest) for n, rest in v.items()]
        atts += [(m, n, k, y) for (n, k), y in a.items() if y is not None]
        dims += [(m, n, s) for n, s in DIMS]
        values += [(m, n, y) for n, ys in x.items() for y in ys]
    return vars_, atts, dims, values


def sampling_faults(spark, sf_dir):
    files = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand"), ["p_partkey"]).select(F.col("p_partkey").alias("file_id"), ((F.col("p_size") * 25 + F.regexp_extract("p_brand", "[0-9]+", 0).cast("int")) % len(FAULTS)).alias("m"))
    vars_, atts, dims, values = _rows()
    of = lambda rows, schema: files.join(F.broadcast(spark.createDataFrame(rows, f"m int, {schema}")), "m").drop("m")
    v = of(vars_, "var string, type string, dims string, role string, axis string").withColumn("dims", F.when(F.col("dims") == "", F.array().cast("array<string>")).otherwise(F.split("dims", ",")))
    return sampling.sampling_faults(v, of(atts, "var string, att string, value string"), of(dims, "dim string, size long"), of(values, "var string, value long"))


QUERIES["sampling_faults"] = sampling_faults
_FOUND = ", ".join(f"({m}, '{v}', '{c}')" for m, (_, found) in enumerate(FAULTS) for v, c in found)
ORACLES["sampling_faults"] = f"""SELECT p_partkey AS file_id, f.var, f.code FROM part
 JOIN (VALUES {_FOUND}) f(m, var, code) ON m = (p_size * 25 + CAST(split_part(p_brand, '#', 2) AS INT)) % {len(FAULTS)}"""


def decoded_indexes(spark, sf_dir):
    """Compressed indexes of lines as places in three dimensions."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") - 5).alias("index"))
    p = F.col("places")
    return sampling.decoded(l, [5, 6, 7], one_based=True).select("l_orderkey", "l_linenumber", p[0].alias("i"), p[1].alias("j"), p[2].alias("k"))


QUERIES["decoded_indexes"] = decoded_indexes
ORACLES["decoded_indexes"] = """SELECT l_orderkey, l_linenumber, CASE WHEN ok THEN x // 42 END AS i, CASE WHEN ok THEN x // 7 % 6 END AS j, CASE WHEN ok THEN x % 7 END AS k
 FROM (SELECT l_orderkey, l_linenumber, l_partkey - 6 AS x, l_partkey - 6 BETWEEN 0 AND 209 AS ok FROM lineitem)"""
