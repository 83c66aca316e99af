"""Discrete sampling geometries and compressed indexes: what kind of feature a file holds, and whether its counts and indexes fit its dimensions.

Layouts are judged in one row a file, which its few variables share. What index and count variables hold comes as long rows
(file_id, var, value) of any number and is aggregated before it meets the layout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Types of index variables.
INDEX_TYPES = ("byte", "short", "int", "int64")


def _rank(c: Column) -> Column:
    """The number of a coordinate's dimensions; null where there is none."""
    return F.when(c.isNotNull(), F.size(c["dims"]))


def guessed(x: Column, y: Column, z: Column, t: Column, data: Column) -> Column:
    """The feature types (lower case) that a data variable's dimensions and those of its coordinates point to; none if x and y do not share
    theirs, as on a grid. Each argument is a struct with ``dims``, or null."""
    px, pz, pt, d = _rank(x), _rank(z), _rank(t), F.size(data["dims"])
    at = lambda *ranks: (d == ranks[0]) & (px == ranks[1])
    flat, with_x = pz.isNull() | (pz == 0), F.coalesce(t["dims"] == x["dims"], F.lit(False))
    z_apart = F.coalesce((pz >= 1) & (z["dims"] != x["dims"]), F.lit(False))
    kinds = (
        F.when(at(1, 1) & with_x, F.array(F.lit("point"), F.lit("trajectory")))
        .when(at(1, 0) & (pt == 1) & flat, F.array(F.lit("timeseries")))
        .when(at(1, 0) & (pz == 1) & (pt.isNull() | (pt == 0)), F.array(F.lit("profile")))
        .when(at(2, 1) & with_x & z_apart, F.array(F.lit("profile"), F.lit("trajectoryprofile")))
        .when(at(2, 1) & ~with_x & pt.isin(1, 2) & ~z_apart, F.array(F.lit("timeseries")))
        .when(at(2, 2) & (pt == 2), F.array(F.lit("trajectory")))
        .when(at(2, 0) & (pt == 1) & pz.isin(1, 2), F.array(F.lit("timeseriesprofile")))
        .when(at(3, 1) & z_apart & pt.isin(1, 2), F.array(F.lit("timeseriesprofile")))
        .when(at(3, 2) & (pz == 3) & (pt == 2), F.array(F.lit("trajectoryprofile")))
    )
    return F.when(F.coalesce(x["dims"] == y["dims"], F.lit(False)), kinds)


def layouts(vars: DataFrame, atts: DataFrame, dims: DataFrame, values: DataFrame) -> DataFrame:
    """A row a file: ``vs`` array of its variables (var, type, dims, role, axis, their attributes, low, high and total of their values), ``sizes`` of its
    dimensions, ``feature`` its featureType."""
    kinds = ["cf_role", "sample_dimension", "instance_dimension", "compress"]
    own = atts.where(F.col("att").isin(*kinds) & F.col("value").isNotNull()).groupBy("file_id", "var").pivot("att", kinds).agg(F.min("value"))
    seen = values.where("value is not null").groupBy("file_id", "var").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.sum("value").alias("total"))
    v = vars.where("file_id is not null and var is not null").join(own, ["file_id", "var"], "left").join(seen, ["file_id", "var"], "left")
    by = v.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("var", "type", "dims", "role", "axis", *kinds, "low", "high", "total"))).alias("vs"))
    sizes = dims.where("dim is not null").dropDuplicates(["file_id", "dim"]).groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("dim", "size"))).alias("sizes"))
    feature = atts.where("var = '' and att = 'featureType' and value is not null").groupBy("file_id").agg(F.min("value").alias("feature"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    return by.join(sizes, "file_id", "left").join(feature, "file_id", "left").withColumn("sizes", F.coalesce("sizes", none))


def sampling_faults(vars: DataFrame, atts: DataFrame, dims: DataFrame, values: DataFrame) -> DataFrame:
    """(file_id, var, code) of files of sampled features; codes of files have an empty var.

    vars: (file_id, var, type, dims array, role, axis), role as of ``roles.variable_roles``, axis X, Y, Z, T or null; atts: (file_id, var, att, value);
    dims: (file_id, dim, size); values: (file_id, var, value) of index and count variables. 9f a cf_role of another feature type, 9g a featureType that the layout
    contradicts, 9h a label without cf_role (not of points), 9i a missing featureType (94a on orthogonal arrays); 932a counts that do not sum up
    to their dimension, 932b counts without sample_dimension, 932c either attribute on what is no index, 932e an index without
    instance_dimension, 932f several sample_dimension; 82c indexes from 0, 82d up to the size, 82e beyond. The guess is by the first
    data variable by name. Nulls say nothing; an empty table has no findings.
    """
    d = layouts(vars, atts, dims, values)
    first = lambda test: F.get(F.filter("vs", test), F.lit(0))
    axis = lambda a: first(lambda v: F.coalesce(v["axis"] == a, F.lit(False)))
    d = d.select("file_id", "vs", "sizes", F.lower("feature").alias("feature"), axis("X").alias("x"), axis("Y").alias("y"), axis("Z").alias("z"), axis("T").alias("t"), first(lambda v: F.coalesce(v["role"] == "data", F.lit(False))).alias("data"))
    d = d.withColumn("guess", guessed(F.col("x"), F.col("y"), F.col("z"), F.col("t"), F.col("data")))
    feature, none = F.col("feature"), F.array().cast("array<string>")
    stem = lambda v: F.lower(F.regexp_replace(v["cf_role"], "_id$", ""))
    point = (feature == "point") | F.coalesce(feature.isNull() & (F.get("guess", F.lit(0)) == "point"), F.lit(False))
    fits = F.exists("guess", lambda g: F.contains(g, feature) | F.contains(feature, g))
    rank = lambda c: F.coalesce(_rank(F.col(c)), F.lit(0))
    straight = (F.size("data.dims") > 1) & (rank("t") <= 1) & (rank("z") <= 1)
    of_file = F.array(
        F.when(feature.isNotNull() & F.exists("vs", lambda v: v["cf_role"].isNotNull() & ~F.contains(feature, stem(v))), "CF_9f"),
        F.when(feature.isNotNull() & F.col("guess").isNotNull() & ~fits, "CF_9g"),
        F.when(feature.isNotNull() & ~point & F.exists("vs", lambda v: (v["role"] == "label") & v["cf_role"].isNull()), "CF_9h"),
        F.when(feature.isNull() & F.col("guess").isNotNull(), F.when(straight, "CF_94a").otherwise("CF_9i")),
        F.when(F.size(F.filter("vs", lambda v: v["sample_dimension"].isNotNull())) > 1, "CF_932f"),
    )
    sampled = F.exists("vs", lambda v: v["sample_dimension"].isNotNull())
    instanced = F.exists("vs", lambda v: v["instance_dimension"].isNotNull())
    obs = F.when(F.size("data.dims") == 1, F.col("data.dims")[0])

    def of_var(v):
        index = v["type"].isin(*INDEX_TYPES)
        plain = index & (F.size(v["dims"]) == 1) & (F.get(v["dims"], F.lit(0)) != v["var"]) & v["sample_dimension"].isNull() & v["instance_dimension"].isNull() & v["compress"].isNull()
        size = F.col("sizes")[v["sample_dimension"]]
        room = F.aggregate(F.filter(F.split(F.trim(v["compress"]), " +"), lambda x: x != ""), F.lit(1).cast("long"), lambda a, x: a * F.col("sizes")[x])
        other = F.exists(F.map_entries("sizes"), lambda e: (e["key"] != obs) & (v["high"] < e["value"]))
        codes = F.array(
            F.when(v["sample_dimension"].isNotNull() & (v["total"] != size), "CF_932a"),
            F.when(~sampled & ~instanced & plain & (F.get(v["dims"], F.lit(0)) != obs) & (v["total"] == F.col("sizes")[obs]), "CF_932b"),
            F.when((v["sample_dimension"].isNotNull() | v["instance_dimension"].isNotNull()) & ~index, "CF_932c"),
            F.when(~sampled & ~instanced & plain & (F.get(v["dims"], F.lit(0)) == obs) & (v["low"] >= 0) & other, "CF_932e"),
            F.when(index & v["compress"].isNotNull() & (v["low"] == 0), "CF_82c"),
            F.when(index & v["compress"].isNotNull() & (v["high"] == room), "CF_82d"),
            F.when(index & v["compress"].isNotNull() & ((v["low"] < 0) | (v["high"] > room)), "CF_82e"),
        )
        return F.transform(F.array_compact(codes), lambda c: F.struct(v["var"].alias("var"), c.alias("code")))

    files = F.transform(F.array_compact(F.concat(of_file, none)), lambda c: F.struct(F.lit("").alias("var"), c.alias("code")))
    return d.select("file_id", F.inline(F.concat(files, F.flatten(F.transform("vs", of_var)))))


def decoded(indexes: DataFrame, sizes: list[int], one_based: bool = False) -> DataFrame:
    """``indexes`` (index, ...) with ``places``, the places in dimensions of these ``sizes`` that a compressed index stands for, the last running
    fastest; null for an index out of range."""
    rest, places = F.col("index") - (1 if one_based else 0), []
    room = 1
    for n in sizes:
        room *= n
    out = rest
    for n in reversed(sizes):
        places.append(F.pmod(out, F.lit(n)).cast("long"))
        out = F.floor(out / n)
    return indexes.withColumn("places", F.when((rest >= 0) & (rest < room), F.array(*reversed(places))))
