"""Conformity of files with the tables of their project: requested dimensions, excluded variables, changed low bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Codes of the attributes of a requested dimension.
DIMENSION_CODES = {"standard_name": "4_4c", "long_name": "4_4d", "axis": "4_4e", "units": "4_4f", "type": "4_4l", "positive": "4_4m"}
ABSENT, BELOW, ABOVE = "4_4b", "4_4j", "4_4k"


def dimension_faults(variables: DataFrame, requested: DataFrame, found: DataFrame) -> DataFrame:
    """(file_id, var, dim, code) of each departure of a variable's dimensions from the requested ones, each once.

    variables: (file_id, var). requested: (var, dim, out_name, valid_min, valid_max and the attributes of
    ``DIMENSION_CODES``), a row a dimension of a variable. found: (file_id, name, lo, hi and the same attributes), a row a
    dimension variable of a file with the least and greatest of its values.

    A dimension that no variable of the file is named after is 4_4b alone; otherwise each attribute is compared without
    regard to case and outer blanks. What the request leaves null isn't asked for; what the file lacks of the rest is a
    fault, except that values are judged only where the file has some. Variables that no row requests have no
    findings. Null keys meet nothing, so such a variable has none either; columns beyond these are ignored.
    """
    ours = [F.col(n).alias(f"_r_{n}") for n in DIMENSION_CODES]
    theirs = [F.col(n).alias(f"_f_{n}") for n in DIMENSION_CODES]
    asked = requested.select("var", "dim", F.col("out_name").alias("_name"), F.col("valid_min").alias("_min"), F.col("valid_max").alias("_max"), *ours)
    has = found.select("file_id", F.col("name").alias("_name"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.lit(True).alias("_there"), *theirs)
    pairs = variables.select("file_id", "var").distinct().join(asked, "var").where("file_id is not null").join(has, ["file_id", "_name"], "left")
    plain = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    faults = [F.when(F.col(f"_r_{n}").isNotNull() & (plain(f"_r_{n}") != plain(f"_f_{n}")), code) for n, code in DIMENSION_CODES.items()]
    faults += [F.when(F.col("_lo") < F.col("_min"), BELOW), F.when(F.col("_hi") > F.col("_max"), ABOVE)]
    codes = F.when(F.col("_there").isNull(), F.array(F.lit(ABSENT))).otherwise(F.array_compact(F.array(*faults)))
    return pairs.select("file_id", "var", "dim", F.explode(codes).alias("code")).distinct()


def included(variables: DataFrame, attributes: DataFrame, excluded: list[str] = ()) -> DataFrame:
    """``variables`` (file_id, var, ...) without those named in ``excluded`` and without the one that the climatology
    attribute of a file's time names. attributes: (file_id, var, att, value). Null names stay; an attribute without value names nothing."""
    clim = attributes.where("var = 'time' and att = 'climatology'").select("file_id", F.col("value").alias("var")).distinct()
    return variables.where(F.col("var").isNull() | ~F.col("var").isin(list(excluded))).join(clim, ["file_id", "var"], "left_anti").select(*variables.columns)


def clear_low_bits(value: Column, n: int) -> Column:
    """A whole number with its ``n`` lowest bits 0, so that records that differ in these only are equal; null stays null."""
    return F.shiftleft(F.shiftright(value.cast("long"), n), n)


def on_edge(lat: Column, lon: Column, lats: Column, lons: Column) -> Column:
    """Whether a point lies on an edge of the polygon of the vertices ``lats`` and ``lons``; nulls give null."""
    n = F.size(lats)

    def on(i):
        j = F.when(i == 0, n - 1).otherwise(i - 1)
        y, yj, x, xj = F.get(lats, i), F.get(lats, j), F.get(lons, i), F.get(lons, j)
        return ((xj - x) * (lat - y) == (lon - x) * (yj - y)) & lat.between(F.least(y, yj), F.greatest(y, yj)) & lon.between(F.least(x, xj), F.greatest(x, xj))

    return F.exists(F.sequence(F.lit(0), n - 1), on)


def inside(lat: Column, lon: Column, lats: Column, lons: Column) -> Column:
    """Whether a point lies in the polygon of the vertices ``lats`` and ``lons`` (arrays of one length), by the parity of the edges
    that a ray from it crosses. A point on an edge counts as lying a little to the north-east of it, so that it is in one of the cells side by side; numbers
    are multiplied only, so decimals are judged exactly. Polygons of fewer than three vertices hold nothing; nulls give null."""
    at = lambda a, i: F.get(a, i)
    n = F.size(lats)

    def crossed(i):
        j = F.when(i == 0, n - 1).otherwise(i - 1)
        y, yj, x, xj = at(lats, i), at(lats, j), at(lons, i), at(lons, j)
        # the ray goes north-east: what lies across it is the difference of the coordinates
        b, bj, at_b = y - x, yj - xj, lat - lon
        ahead = ((yj + xj) - (y + x)) * (at_b - b) - ((lat + lon) - (y + x)) * (bj - b)
        return ((b > at_b) != (bj > at_b)) & F.when(bj > b, ahead > 0).otherwise(ahead < 0)

    hits = F.size(F.filter(F.sequence(F.lit(0), n - 1), crossed))
    return F.when(n < 3, F.lit(False)).otherwise(hits % 2 == 1)
