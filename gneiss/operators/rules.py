"""Metadata rules as joins of long attribute tables with rule tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def consistency(base: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """(aux, att, code) of two cuts (keys.., aux, att, value): 8_4 aux missing, 8_5 aux new, 8_7 attribute missing, 8_6 new, 8_8 changed."""
    cols = [*keys, "aux", "att"]
    a = base.select(*cols, F.col("value").alias("va"), F.lit(True).alias("ina"))
    b = other.select(*cols, F.col("value").alias("vb"), F.lit(True).alias("inb"))
    aux_a, aux_b = base.select(*keys, "aux", F.lit(True).alias("auxa")).distinct(), other.select(*keys, "aux", F.lit(True).alias("auxb")).distinct()
    j = a.join(b, cols, "full").join(aux_a, [*keys, "aux"], "left").join(aux_b, [*keys, "aux"], "left")
    code = (
        F.when(F.col("auxb").isNull(), "8_4").when(F.col("auxa").isNull(), "8_5").when(F.col("inb").isNull(), "8_7").when(F.col("ina").isNull(), "8_6").when(~F.col("va").eqNullSafe(F.col("vb")), "8_8")
    )
    return j.withColumn("code", code).where("code is not null").select(*cols, "code")


#: Most rows of a rule table that becomes part of the plan.
MOST_RULES = 10_000


def requested(atts: DataFrame, required: DataFrame, owner: list[str]) -> DataFrame:
    """(owner, att, code): ``missing`` where an owner lacks a required attribute, ``unmatched`` where its value is not allowed.

    atts: (owner.., att, value); required: (att, allowed array, null: any value). An owner's required attributes are gathered in its row, and
    the rules are judged there; repeated attributes are judged each.
    """
    rows = required.select("att", "allowed").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} requirements")
    if not rows:
        return atts.select(*owner, "att", F.lit(None).cast("string").alias("code")).where("false")
    none = F.lit(None).cast("array<string>")
    names = sorted({r["att"] for r in rows if r["att"] is not None})
    rules = F.array(*[F.struct(F.lit(r["att"]).alias("att"), (none if r["allowed"] is None else F.array(*[F.lit(v) for v in r["allowed"]]).cast("array<string>")).alias("allowed")) for r in rows])
    held = atts.groupBy(*owner).agg(F.collect_list(F.when(F.col("att").isin(*names), F.struct("att", "value"))).alias("held_"))

    def judged(rule):
        mine = F.filter("held_", lambda x: x["att"] == rule["att"])
        fault = lambda v: F.struct(rule["att"].alias("att"), F.when(v.isNull(), "missing").when(rule["allowed"].isNotNull() & ~F.array_contains(rule["allowed"], v), "unmatched").alias("code"))
        return F.when(F.size(mine) == 0, F.array(fault(F.lit(None).cast("string")))).otherwise(F.transform(mine, lambda x: fault(x["value"])))

    return held.select(*owner, F.inline(F.filter(F.flatten(F.transform(rules, judged)), lambda x: x["code"].isNotNull())))


def encoding_faults(paths: DataFrame, id: str, parts: Column, encodings: DataFrame) -> DataFrame:
    """(id, enc, faults) of the encoding that fits each path best. encodings: (enc, pos, pattern): a part that is absent
    or does not fit is a fault; ties go to the smaller name. A path that fits no part of any encoding has all faults of
    the shortest one. Encodings are a rule table."""
    p = paths.select(id, F.posexplode(parts).alias("pos", "part"))
    e = encodings.groupBy("enc").agg(F.count("*").alias("size"))
    hit = p.join(encodings, "pos").where("part rlike pattern").groupBy(id, "enc").agg(F.count("*").alias("hits"))
    scored = hit.join(e, "enc").withColumn("faults", F.col("size") - F.col("hits"))
    w = Window.partitionBy(id).orderBy("faults", "enc")
    best = scored.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(id, "enc", "faults")
    short = e.orderBy("size", "enc").first()
    if short is None:
        return best
    all_ = paths.select(id).distinct().join(best, id, "left")
    return all_.select(id, F.coalesce("enc", F.lit(short["enc"])).alias("enc"), F.coalesce("faults", F.lit(short["size"])).alias("faults"))


def nearest_names(names: DataFrame, known: list[str], most: float = 0.25) -> DataFrame:
    """(name, nearest, distance) of distinct names that are not known but within ``most`` of their length of one that is.
    ``known`` is a rule table of fixed size; each name is compared with it in its own row."""
    table = F.array(*[F.lit(k) for k in sorted(known)])
    near = F.array_min(F.transform(table, lambda k: F.struct((F.levenshtein("name", k) / F.length("name")).alias("distance"), k.alias("nearest"))))
    n = names.select("name").where("length(name) > 0").distinct().where(~F.array_contains(table, F.col("name"))).withColumn("_n", near)
    return n.select("name", "_n.nearest", "_n.distance").where(F.col("distance") < most)


def array_tolerance(rows: DataFrame, a: str, b: str, tolerance: float) -> DataFrame:
    """``n_off``: elements of two arrays that differ by more; a missing element differs."""
    off = F.zip_with(a, b, lambda x, y: F.when(F.abs(x - y) <= tolerance, 0).otherwise(1))
    return rows.withColumn("n_off", F.aggregate(off, F.lit(0), lambda s, x: s + x))


def dangling_references(atts: DataFrame, vars: DataFrame, kinds: list[str]) -> DataFrame:
    """(file_id, var, att, name): names in reference attributes that are no variable of the file."""
    names = atts.where(F.col("att").isin(*kinds)).select("file_id", "var", "att", F.explode(F.regexp_extract_all("value", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)(?!\w*:)"), F.lit(1))).alias("name"))
    return names.join(vars.select("file_id", F.col("var").alias("name")).distinct(), ["file_id", "name"], "left_anti")


#: Standard names of dimensionless vertical coordinates and the terms their formulas need.
FORMULA_TERMS = {
    "atmosphere_ln_pressure_coordinate": "p0 lev",
    "atmosphere_sigma_coordinate": "sigma ps ptop",
    "atmosphere_hybrid_sigma_pressure_coordinate": "a b p0 ps|ap b ps",
    "atmosphere_hybrid_height_coordinate": "a b orog",
    "atmosphere_sleve_coordinate": "a b1 b2 ztop zsurf1 zsurf2",
    "ocean_sigma_coordinate": "sigma eta depth",
    "ocean_s_coordinate": "s eta depth a b depth_c",
    "ocean_sigma_z_coordinate": "sigma eta depth depth_c nsigma zlev",
    "ocean_double_sigma_coordinate": "sigma depth z1 z2 a href k_c",
}


def formula_terms(atts: DataFrame) -> DataFrame:
    """(file_id, var, missing, surplus) of vertical coordinates (var, standard_name, formula_terms) whose terms are not their
    formula's. Of several forms of a formula, which ``|`` parts, the one with the fewest faults is taken."""
    forms = lambda v: F.array(*[F.array(*[F.lit(t) for t in f.split()]) for f in v.split("|")])
    table = F.create_map(*[x for k, v in FORMULA_TERMS.items() for x in (F.lit(k), forms(v))])
    off = lambda f: F.size(F.array_except(f, has)) + F.size(F.array_except(has, f))
    has = F.regexp_extract_all("formula_terms", F.lit(r"(\w+):"), F.lit(1))
    need = F.array_min(F.transform(F.element_at(table, F.col("standard_name")), lambda f: F.struct(off(f).alias("off"), f.alias("form"))))["form"]
    d = atts.where(need.isNotNull()).select("file_id", "var", F.array_sort(F.array_except(need, has)).alias("missing"), F.array_sort(F.array_except(has, need)).alias("surplus"))
    return d.where("size(missing) + size(surplus) > 0")


#: Methods that the cell_methods grammar knows.
CELL_METHODS = ("point", "sum", "maximum", "median", "mid_range", "minimum", "mean", "mode", "standard_deviation", "variance", "range", "sum_of_squares", "root_mean_square")


def cell_methods(atts: DataFrame) -> DataFrame:
    """(file_id, var, dims, method, known, scope) of each ``dim: [dim:] method [where|over|within ...] [(comment)]`` entry."""
    entry = r"((?:\w+: ?)+)(\w+)((?: (?:where|over|within) \w+)*)"
    all_ = F.regexp_extract_all(F.regexp_replace("value", r"\([^)]*\)", ""), F.lit(entry), F.lit(0))
    e = atts.select("file_id", "var", F.posexplode(all_).alias("pos", "entry"))
    method = F.regexp_extract("entry", entry, 2)
    return e.select(
        "file_id", "var", "pos", F.regexp_extract_all("entry", F.lit(r"(\w+):"), F.lit(1)).alias("dims"), method.alias("method"), method.isin(*CELL_METHODS).alias("known"), F.trim(F.regexp_extract("entry", entry, 3)).alias("scope")
    )


def coordinate_roles(vars: DataFrame) -> DataFrame:
    """(file_id, var, role, weight, tie): the axis with most evidence, a point each for units, standard name and axis letter.

    vars: (file_id, var, units, standard_name, axis).
    """
    u, s, a = F.coalesce("units", F.lit("")), F.coalesce("standard_name", F.lit("")), F.coalesce("axis", F.lit(""))
    point = lambda c: F.when(c, 1).otherwise(0)
    roles = {
        "X": point(u.rlike("^degrees?(_east|_E|E)$")) + point(s.isin("longitude", "grid_longitude", "projection_x_coordinate")) + point(a == "X"),
        "Y": point(u.rlike("^degrees?(_north|_N|N)$")) + point(s.isin("latitude", "grid_latitude", "projection_y_coordinate")) + point(a == "Y"),
        "Z": point(u.rlike("^(Pa|hPa|bar|m|km|level|layer|sigma_level)$")) + point(s.rlike("^(air_pressure|height|depth|altitude|.*_coordinate)$") & ~s.rlike("^projection_")) + point(a == "Z"),
        "T": point(u.rlike("^[a-z]+ since ")) + point(s == "time") + point(a == "T"),
    }
    rows = F.array(*[F.struct(w.alias("weight"), F.lit(r).alias("role")) for r, w in roles.items()])
    best = F.array_max(rows)
    ties = F.size(F.filter(rows, lambda r: r["weight"] == best["weight"]))
    return vars.select("file_id", "var", best.alias("b"), ties.alias("t")).where("b.weight > 0").select("file_id", "var", "b.role", "b.weight", (F.col("t") > 1).alias("tie"))


def flag_faults(atts: DataFrame) -> DataFrame:
    """``code`` of flag attributes (flag_values, flag_masks arrays, flag_meanings): sizes differ, values repeat, a mask is 0, a value
    has bits outside its mask (outside_mask)."""
    words = F.size(F.filter(F.split("flag_meanings", " +"), lambda x: x != ""))
    code = (
        F.when(F.col("flag_values").isNotNull() & (F.size("flag_values") != words), "sizes")
        .when(F.col("flag_masks").isNotNull() & (F.size("flag_masks") != words), "sizes")
        .when(F.col("flag_values").isNotNull() & (F.size(F.array_distinct("flag_values")) < F.size("flag_values")), "repeated")
        .when(F.exists(F.coalesce("flag_masks", F.array().cast("array<int>")), lambda x: x == 0), "zero_mask")
        .when(F.exists(F.zip_with("flag_values", "flag_masks", lambda v, m: v.bitwiseAND(m) != v), lambda x: x), "outside_mask")
    )
    return atts.withColumn("code", code).where("code is not null")


def packing_faults(vars: DataFrame) -> DataFrame:
    """``code`` of packed variables (type, scale_type, offset_type): the factors' types differ, or the packed type is no integer."""
    packed = F.col("scale_type").isNotNull() | F.col("offset_type").isNotNull()
    code = F.when(F.col("scale_type") != F.col("offset_type"), "factor_types").when(packed & ~F.col("type").isin("byte", "short", "int"), "packed_type")
    return vars.withColumn("code", code).where("code is not null")


def ragged_faults(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """Files whose ragged arrays' counts do not add up to the sample dimension. counts: (file_id, count); sizes: (file_id, size)."""
    return counts.groupBy("file_id").agg(F.sum("count").alias("total")).join(sizes, "file_id").where("total <> size")


def changed_variables(files: DataFrame, series: list[str], order: str, vars: str) -> DataFrame:
    """(series, order, var, code): 3_14 a variable of the file before is missing, 3_15 one is new. ``vars`` is an array."""
    before = F.lag(vars).over(Window.partitionBy(*series).orderBy(order))
    f = files.withColumn("_b", before).where("_b is not null")
    gone = F.transform(F.array_except("_b", vars), lambda v: F.struct(v.alias("var"), F.lit("3_14").alias("code")))
    new = F.transform(F.array_except(vars, "_b"), lambda v: F.struct(v.alias("var"), F.lit("3_15").alias("code")))
    return f.select(*series, order, F.explode(F.concat(gone, new)).alias("f")).select(*series, order, "f.var", "f.code")


def looked_up(vars: DataFrame, table: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``vars`` with the requirement table's ``columns``; ``code`` is 3_1 where the table has no such row, else the first column
    whose value is not as required, or null."""
    t = table.select(*keys, *[F.col(c).alias(f"want_{c}") for c in columns], F.lit(True).alias("_in"))
    j = vars.join(t, keys, "left")
    code = F.when(F.col("_in").isNull(), "3_1")
    for c in columns:
        code = code.when(~F.col(c).eqNullSafe(F.col(f"want_{c}")), c)
    return j.withColumn("code", code).drop("_in")


def domain(grids: DataFrame, domains: DataFrame) -> DataFrame:
    """``domain`` of each grid (name, nlon, nlat): the row of that name, else the first of the same sizes; ``by`` says which."""
    d = domains.select(F.col("name").alias("d_name"), F.col("nlon").alias("d_nlon"), F.col("nlat").alias("d_nlat"))
    named = grids.join(d.select(F.col("d_name").alias("name"), F.lit(True).alias("_n")), "name", "left")
    sized = d.groupBy(F.col("d_nlon").alias("nlon"), F.col("d_nlat").alias("nlat")).agg(F.min("d_name").alias("_s"))
    j = named.join(sized, ["nlon", "nlat"], "left")
    return j.withColumn("domain", F.when(F.col("_n"), F.col("name")).otherwise(F.col("_s"))).withColumn("by", F.when(F.col("_n"), "name").when(F.col("_s").isNotNull(), "size")).drop("_n", "_s")


def duplicated(table: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that a rule table has more than once, and how often."""
    return table.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
