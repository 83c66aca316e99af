"""Convention rules as column conditions over variables and files.

A layout is three long tables: ``vars`` (file_id, var, type, dims array), ``atts`` (file_id, var, '' if global, att, att_type,
value) and ``dims`` (file_id, dim, size). ``described`` brings the rows of a file together by one grouping and makes one row of each
variable with its attributes as maps and the names of its file beside it. Every rule is then a condition on such a row, so that all
rules of all chapters are one pass, and a chapter is a choice of rules. A file's names are few; no group grows with the archive.
No table but that of standard names is broadcast: Spark takes what is exploded from a small file for small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions.units import dimension
from gneiss.sources.shared import dealt

#: Rows of variables, attributes and dimensions that one task groups by file.
FILE_ROWS = 1_000_000
#: Modifiers of standard names, feature types, roles and grid mappings that the conventions know.
MODIFIERS = ("detection_minimum", "number_of_observations", "standard_error", "status_flag")
FEATURES = ("point", "timeSeries", "profile", "trajectory", "timeSeriesProfile", "trajectoryProfile")
ROLES = ("timeseries_id", "profile_id", "trajectory_id")
MAPPINGS = (
    "albers_conical_equal_area", "azimuthal_equidistant", "lambert_azimuthal_equal_area", "lambert_conformal_conic", "lambert_cylindrical_equal_area", "latitude_longitude", "mercator",
    "orthographic", "polar_stereographic", "rotated_latitude_longitude", "stereographic", "transverse_mercator", "vertical_perspective",
)
_WORDS = "filter(split({0}, '[ ]+'), x -> x <> '')"
_NAMES = "regexp_extract_all({0}, ':[ ]*([A-Za-z_][A-Za-z0-9_]*)(?![A-Za-z0-9_]*:)', 1)"
_RANGE = "try_cast(get(split(trim(a['valid_range']), '[ ,]+'), {0}) as double)"
#: The type of a packed variable's factors, null where there are two.
_FACTOR = "case when not coalesce(t['scale_factor'] <> t['add_offset'], false) then coalesce(t['add_offset'], t['scale_factor']) end"
_TIME_UNITS = r"^\\s*(year|month|day|hour|hr|minute|min|second|sec|s|h|d)s? +since +[0-9]{1,4}-[0-9]{1,2}-[0-9]{1,2}([T ][0-9]{1,2}(:[0-9]{2}(:[0-9]{2}(\\.[0-9]+)?)?)?)?( *(Z|UTC|[+-][0-9:]+))?\\s*$"

#: Rules of variables by code: an SQL condition on a row of ``described``; ``a`` is the map of values, ``t`` that of types.
VARIABLE_RULES = {
    "CF_0g": "exists(map_values(a), x -> trim(x) = '')",
    "CF_22a": "type = 'string'",
    "CF_22b": "exists(map_values(t), x -> x = 'string')",
    "CF_23a": "not var rlike '^[A-Za-z][A-Za-z0-9_]*$' or exists(map_keys(a), x -> not x rlike '^[A-Za-z_][A-Za-z0-9_]*$')",
    "CF_23b": "size(filter(file_vars, x -> lower(x) = lower(var))) > 1",
    "CF_24a": "size(array_distinct(dims)) < size(dims)",
    "CF_24b": "array_compact(transform(dims, d -> axes[d])) <> array_sort(array_compact(transform(dims, d -> axes[d])))",
    "CF_251a": f"exists(transform(array(a['_FillValue'], a['missing_value']), x -> try_cast(x as double)), x -> x between {_RANGE.format(0)} and {_RANGE.format(1)} or x between try_cast(a['valid_min'] as double) and try_cast(a['valid_max'] as double))",
    "CF_26a": "exists(array('_FillValue', 'missing_value', 'valid_min', 'valid_max'), x -> t[x] <> type)",
    "CF_26b": "exists(array('units', 'standard_name', 'long_name', 'cell_methods', 'coordinates'), x -> t[x] not in ('char', 'string'))",
    "CF_26c": "exists(array('scale_factor', 'add_offset', 'valid_min', 'valid_max'), x -> t[x] in ('char', 'string'))",
    "CF_31a": "a['units'] in ('level', 'layer', 'sigma_level')",
    "CF_32a": "a['standard_name'] is null and a['long_name'] is null and bounded is null and not array_contains(mappings, var) and a['grid_mapping_name'] is null and a['compress'] is null and type not in ('char', 'string')",
    "CF_33a": "a['standard_name'] is not null and not known_name",
    "CF_33b": f"size({_WORDS.format('a[\'standard_name\']')}) = 2 and not array_contains(array{MODIFIERS}, get({_WORDS.format('a[\'standard_name\']')}, 1))",
    "CF_33c": f"size({_WORDS.format('a[\'standard_name\']')}) > 2",
    "CF_33d": f"get({_WORDS.format('a[\'standard_name\']')}, 1) = 'number_of_observations' and coalesce(a['units'], '') <> '1'",
    "CF_33e": "known_name and size(split(trim(a['standard_name']), ' ')) = 1 and not coalesce(same_units, true)",
    "CF_34a": f"exists({_WORDS.format('a[\'ancillary_variables\']')}, x -> not array_contains(file_vars, x))",
    "CF_35a": f"(a['flag_values'] is not null and size(split(a['flag_values'], ', *')) <> size({_WORDS.format('a[\'flag_meanings\']')})) or (a['flag_masks'] is not null and size(split(a['flag_masks'], ', *')) <> size({_WORDS.format('a[\'flag_meanings\']')}))",
    "CF_35d": "(a['flag_values'] is not null or a['flag_masks'] is not null) and a['flag_meanings'] is null",
    "CF_35e": "size(array_distinct(split(a['flag_values'], ', *'))) < size(split(a['flag_values'], ', *'))",
    "CF_35f": "exists(split(a['flag_masks'], ', *'), x -> try_cast(x as double) = 0)",
    "CF_35g": f"exists({_WORDS.format('a[\'flag_meanings\']')}, x -> not x rlike '^[A-Za-z0-9_.+@-]+$')",
    "CF_35i": "a['flag_values'] is not null and a['flag_masks'] is not null and exists(zip_with(split(a['flag_values'], ', *'), split(a['flag_masks'], ', *'), (v, m) -> (try_cast(v as bigint) & try_cast(m as bigint)) <> try_cast(v as bigint)), x -> x)",
    "CF_4a": "upper(a['axis']) not in ('X', 'Y', 'Z', 'T')",
    "CF_4b": "upper(a['axis']) <> role",
    "CF_41b": "role in ('X', 'Y') and is_coord and a['units'] is null",
    "CF_41c": "is_coord and a['standard_name'] is null and (var in ('rlon', 'rlat') or upper(a['axis']) in ('X', 'Y') and a['units'] rlike '^degrees?$')",
    "CF_43a": "lower(a['positive']) not in ('up', 'down')",
    "CF_43b": "a['positive'] is not null and not role <=> 'Z'",
    "CF_43c": "role = 'Z' and is_coord and a['positive'] is null and not coalesce(a['units'] in ('Pa', 'hPa', 'bar', 'mbar'), false)",
    "CF_43d": "role = 'Z' and is_coord and a['units'] is null",
    "CF_432a": "a['standard_name'] rlike '^(atmosphere|ocean)_.*_coordinate$' and a['formula_terms'] is null",
    "CF_432c": r"not a['formula_terms'] rlike '^([A-Za-z0-9_]+: *[A-Za-z0-9_]+ *)+$'",
    "CF_432d": "a['formula_terms'] is not null and a['standard_name'] is null",
    "CF_432g": f"exists({_NAMES.format('a[\'formula_terms\']')}, x -> not array_contains(file_vars, x))",
    "CF_44a": "role = 'T' and is_coord and a['units'] is null",
    "CF_44b": f"role = 'T' and is_coord and not a['units'] rlike '{_TIME_UNITS}'",
    "CF_44c": "role = 'T' and a['units'] rlike 'since +0+-'",
    "CF_44d": "not role <=> 'T' and (a['calendar'] is not null or a['month_lengths'] is not null or a['leap_year'] is not null)",
    "CF_441a": "size(split(a['month_lengths'], ', *')) <> 12",
    "CF_441b": "a['leap_month'] is not null and a['leap_year'] is null",
    "CF_441c": "not try_cast(a['leap_month'] as int) between 1 and 12",
    "CF_5a": f"exists({_WORDS.format('a[\'coordinates\']')}, x -> not array_contains(file_vars, x))",
    "CF_5c": "size(dims) > 1 and array_contains(dims, var)",
    "CF_5f": "a['axis'] is not null and size(dims) > 1",
    "CF_56c": "a['grid_mapping'] is not null and not array_contains(file_vars, a['grid_mapping'])",
    "CF_56d": "a['grid_mapping_name'] is not null and size(dims) > 0",
    "CF_56f": "array_contains(mappings, var) and a['grid_mapping_name'] is null",
    "CF_56g": f"not array_contains(array{MAPPINGS}, a['grid_mapping_name'])",
    "CF_57a": "size(dims) = 0 and array_contains(map_keys(sizes), var)",
    "CF_71b": "bounded is not null and size(dims) <> size(bounded.dims) + 1",
    "CF_71c": "bounded is not null and type in ('char', 'string')",
    "CF_71d": "bounded is not null and size(dims) = size(bounded.dims) + 1 and slice(dims, 1, size(bounded.dims)) <> bounded.dims",
    "CF_71f": "bounded is not null and a['units'] <> bounded.units",
    "CF_71g": "exists(array(a['bounds'], a['climatology']), x -> not array_contains(file_vars, x))",
    "CF_71h": "bounded is not null and (a['_FillValue'] is not null or a['missing_value'] is not null)",
    "CF_71i": "bounded is not null and (a['bounds'] is not null or a['climatology'] is not null)",
    "CF_72b": "not a['cell_measures'] rlike '^(area|volume): '",
    "CF_72d": f"exists({_NAMES.format('a[\'cell_measures\']')}, x -> not array_contains(file_vars, x))",
    "CF_732e": "size(regexp_extract_all(a['cell_methods'], '\\\\(', 0)) <> size(regexp_extract_all(a['cell_methods'], '\\\\)', 0))",
    "CF_74c": "a['climatology'] is not null and not role <=> 'T'",
    "CF_81a": "t['scale_factor'] <> t['add_offset']",
    "CF_81b": f"{_FACTOR} <> type and type not in ('byte', 'short', 'int')",
    "CF_81c": f"{_FACTOR} <> type and {_FACTOR} not in ('float', 'double')",
    "CF_81d": f"{_FACTOR} = 'float' and type = 'int'",
    "CF_82a": "a['compress'] is not null and type not in ('byte', 'short', 'int')",
    "CF_82b": f"exists({_WORDS.format('a[\'compress\']')}, x -> not array_contains(map_keys(sizes), x))",
    "CF_9b": "a['featureType'] is not null",
    "CF_9e": f"not array_contains(array{ROLES}, a['cf_role'])",
    "CF_932d": "a['sample_dimension'] is not null and not array_contains(map_keys(sizes), a['sample_dimension'])",
}

#: Rules of files by code: conditions on a row of ``files``; ``g`` is the map of global attributes.
FILE_RULES = {
    "CF_0b": "size(array_except(map_keys(sizes), flatten(all_dims))) > 0",
    "CF_0f": "not any_data",
    "CF_261a": "g['Conventions'] is null",
    "CF_261b": "not g['Conventions'] rlike 'CF-1[.][0-9]+'",
    "CF_261c": "g['Conventions'] rlike 'CF-1[.]3([^0-9]|$)'",
    "CF_9a": "size(filter(split(g['featureType'], '[ ]+'), x -> x <> '')) > 1",
    "CF_9c": "g['cf_role'] is not null or g['instance_dimension'] is not null or g['sample_dimension'] is not null",
    "CF_9d": f"not array_contains(array{FEATURES}, g['featureType'])",
}

#: Evidence that row ``r`` of a file's ``vs`` is a data variable, and that it is not: what attributes and dimensions it has, and which
#: variables name it or have all its dimensions beside others. A variable with as much of the one as of the other is data.
_DATA = " + ".join(
    [f"int(r.a['{x}'] is not null)" for x in ("ancillary_variables", "cell_measures", "cell_methods", "coordinates", "flag_values", "flag_masks", "grid_mapping")]
    + ["int(r.a['_FillValue'] is not null or r.a['missing_value'] is not null)", "int(size(r.dims) > 2)", "int(exists(vs, o -> o.a['ancillary_variables'] <=> r.var))"]
)
_AUX = " + ".join(
    [f"int(r.a['{x}'] is not null)" for x in ("axis", "cf_role", "instance_dimension", "sample_dimension", "positive", "bounds", "climatology")]
    + [
        "int(exists(vs, o -> o.a['bounds'] <=> r.var or o.a['climatology'] <=> r.var))", "int(exists(vs, o -> array_contains(o.dims, r.var)))",
        f"int(exists(vs, o -> coalesce(array_contains({_WORDS.format('o.a[\'coordinates\']')}, r.var), false)))", "int(r.a['grid_mapping_name'] is not null or exists(vs, o -> o.a['grid_mapping'] <=> r.var))",
        "int(size(r.dims) > 0 and exists(vs, o -> size(r.dims) < size(o.dims) and size(array_except(r.dims, o.dims)) = 0))",
    ]
)


def chapter(code: str) -> int:
    """The chapter that a code belongs to: the first digit behind the mark."""
    return int(code.split("_")[1][0])


def described(vars: DataFrame, atts: DataFrame, dims: DataFrame, names: DataFrame) -> DataFrame:
    """A row of each variable: file_id, var, type, dims; ``a`` and ``t``, its attributes' values and types; ``file_vars``, ``sizes``,
    ``axes`` (place of a coordinate's axis in T, Z, Y, X by its name), ``mappings``, ``g`` of its file; ``role``, the axis that units,
    standard name or axis letter tell; ``is_coord``; ``bounded`` (dims, units) if it holds the bounds of another variable; ``known_name``
    and ``same_units`` by the table ``names`` (name, units) of standard names; ``first``, true in one row of each file. Repeated attributes
    count once, nulls not at all."""
    one = lambda df, name, *columns: df.select("file_id", F.struct(*columns).alias(name))
    v = one(vars.where("file_id is not null and var is not null"), "v", "var", "type", "dims")
    x = one(atts.where("file_id is not null and var is not null and att is not null and value is not null"), "x", "var", "att", "value", "att_type")
    rows = v.unionByName(x, True).unionByName(one(dims.where("file_id is not null and dim is not null"), "d", "dim", "size"), True)
    # a row a file; of repeated attributes and dimensions the least value counts
    f = dealt(rows, ["file_id"], FILE_ROWS).groupBy("file_id").agg(F.collect_list("v").alias("vs"), F.sort_array(F.collect_list("x")).alias("xs"), F.sort_array(F.collect_list("d")).alias("ds")).where("size(vs) > 0")
    least = lambda entries, same: F.filter(entries, lambda x, i: (i == 0) | ~same(x, F.get(entries, i - 1)))
    f = f.withColumn("xs", least(F.col("xs"), lambda x, y: (x["var"] == y["var"]) & (x["att"] == y["att"]))).withColumn("ds", least(F.col("ds"), lambda x, y: x["dim"] == y["dim"]))
    pairs = lambda var, value: F.map_from_entries(F.transform(F.filter("xs", lambda x: x["var"] == var), lambda x: F.struct(x["att"].alias("att"), x[value].alias(value))))
    f = f.withColumn("vs", F.transform("vs", lambda v: F.struct(v["var"].alias("var"), v["type"].alias("type"), v["dims"].alias("dims"), pairs(v["var"], "value").alias("a"), pairs(v["var"], "att_type").alias("t"))))
    f = f.withColumn("g", pairs(F.lit(""), "value")).withColumn("sizes", F.map_from_entries("ds")).drop("xs", "ds")

    def placed(v):
        units, name, axis = (F.coalesce(v["a"][x], F.lit("")) for x in ("units", "standard_name", "axis"))
        role = (
            F.when(units.rlike("^degrees?_?(east|E)$") | name.isin("longitude", "grid_longitude", "projection_x_coordinate"), "X")
            .when(units.rlike("^degrees?_?(north|N)$") | name.isin("latitude", "grid_latitude", "projection_y_coordinate"), "Y")
            .when(units.rlike(" since ") | (name == "time"), "T")
            .when(name.rlike("^(air_pressure|height|depth|altitude|(atmosphere|ocean)_.*_coordinate)$"), "Z")
            .otherwise(F.upper(axis))
        )
        is_coord = (F.size(v["dims"]) == 1) & (F.get(v["dims"], F.lit(0)) == v["var"])
        return F.struct(*[v[c].alias(c) for c in ("var", "type", "dims", "a", "t")], F.when(role.isin("X", "Y", "Z", "T"), role).alias("role"), is_coord.alias("is_coord"))

    f = f.withColumn("vs", F.transform("vs", placed))
    place = lambda v: F.array_position(F.array(*[F.lit(x) for x in "TZYX"]), v["role"]).cast("int")
    holder = lambda v: F.coalesce(v["a"]["bounds"], v["a"]["climatology"])
    f = f.select(
        "file_id", "vs", "g", "sizes", F.array_distinct(F.transform("vs", lambda v: v["var"])).alias("file_vars"), F.array_compact(F.transform("vs", lambda v: v["dims"])).alias("all_dims"),
        F.map_from_entries(F.array_distinct(F.transform(F.filter("vs", lambda v: v["is_coord"] & v["role"].isNotNull()), lambda v: F.struct(v["var"].alias("var"), place(v).alias("place"))))).alias("axes"),
        F.array_distinct(F.array_compact(F.transform("vs", lambda v: v["a"]["grid_mapping"]))).alias("mappings"),
        F.transform(F.filter("vs", lambda v: holder(v).isNotNull()), lambda v: F.struct(holder(v).alias("of"), v["dims"].alias("dims"), v["a"]["units"].alias("units"))).alias("bounds"),
        F.expr(f"exists(vs, r -> {_DATA} >= {_AUX})").alias("any_data"),
    )
    bounded = lambda v: F.get(F.filter("bounds", lambda x: x["of"] == v["var"]), F.lit(0))
    d = f.select(*f.columns, F.posexplode_outer("vs").alias("at", "v")).select(*[c for c in f.columns if c not in ("vs", "bounds")], "v.*", (F.col("at") == 0).alias("first"), bounded(F.col("v")).alias("bounded"))
    table = names.groupBy(F.col("name").alias("_name")).agg(F.min("units").alias("_units")).withColumn("_powers", dimension(F.col("_units"))["powers"]).withColumn("_in", F.lit(True))
    # the same text, or else the same powers of base units
    same = F.when(F.col("a")["units"] == F.col("_units"), F.lit(True)).when(F.col("_in"), dimension(F.col("a")["units"])["powers"] == F.col("_powers"))
    d = d.join(F.broadcast(table), F.get(F.split(F.trim(F.col("a")["standard_name"]), " +"), F.lit(0)) == F.col("_name"), "left")
    return d.withColumn("known_name", F.coalesce("_in", F.lit(False))).withColumn("same_units", same).drop("_in", "_name", "_units", "_powers")


def findings(variables: DataFrame, chapters: list[int] | None = None) -> DataFrame:
    """(file_id, var, code): what ``described`` variables and their files break of the rules of ``chapters`` (all, if None). Codes of
    files have an empty var. A condition that is null does not fire."""
    chosen = lambda rules: {k: v for k, v in rules.items() if chapters is None or chapter(k) in chapters}
    fired = lambda rules: F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(F.expr(v), F.lit(k)) for k, v in rules.items()]))
    coded = lambda var, codes: F.transform(codes, lambda c: F.struct(var.alias("var"), c.alias("code")))
    found = coded(F.col("var"), fired(chosen(VARIABLE_RULES)))
    if chosen(FILE_RULES):
        found = F.concat(found, F.when(F.col("first"), coded(F.lit(""), fired(chosen(FILE_RULES)))).otherwise(F.array().cast("array<struct<var:string,code:string>>")))
    return variables.select("file_id", F.inline(found))
