"""Roles of variables by evidence, passed along references until nothing changes.

A variable is data if as much speaks for data as against it. Its attributes and dimensions speak for themselves; then what a variable
is says something about those that it names: a data variable's ancillary variables are data, its coordinates and cell measures are not; a variable
that is none makes its bounds, coordinates and formula terms none. Evidence once passed stays, so the loop ends: each round adds some of a
finite set (one for each reference) or is the last. What doesn't depend on a state is passed before. A round is joins by (file, variable); files are small, so no key is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.sources.shared import dropped, written

# Attributes that speak for data and against it, and those whose value names other variables.
DATA = ("ancillary_variables", "cell_measures", "cell_methods", "coordinates", "_FillValue", "missing_value", "flag_values", "flag_masks", "grid_mapping")
AUXILIARY = ("axis", "cf_role", "climatology", "bounds", "instance_dimension", "sample_dimension", "positive", "compress", "grid_mapping_name")
REFERENCES = ("ancillary_variables", "coordinates", "bounds", "climatology", "cell_measures", "formula_terms", "grid_mapping")
#: What a reference says of the variable it names, and of which kind the one that names it has to be for that.
PASSED = {"ancillary_variables": ("data", "data"), "coordinates": ("any", "auxiliary"), "cell_measures": ("any", "auxiliary"), "grid_mapping": ("any", "auxiliary"), "bounds": ("any", "auxiliary"), "climatology": ("any", "auxiliary"), "formula_terms": ("auxiliary", "auxiliary")}
#: Roles by the reference that names a variable, the strongest first.
NAMED = ("bounds", "climatology", "grid_mapping", "formula_terms", "cell_measures")


def references(atts: DataFrame, vars: DataFrame) -> DataFrame:
    """(file_id, var, att, name): each variable of a file that an attribute of another one names, once."""
    word = F.when(F.col("att").isin("cell_measures", "formula_terms"), F.regexp_extract_all("value", F.lit(r": *(\w+)(?!\w*:)"), F.lit(1))).otherwise(F.split(F.trim("value"), "[ ,]+"))
    named = atts.where(F.col("att").isin(*REFERENCES) & F.col("value").isNotNull()).select("file_id", "var", "att", F.explode(F.array_distinct(word)).alias("name"))
    return named.where("name <> var").join(vars.select("file_id", F.col("var").alias("name")).distinct(), ["file_id", "name"], "left_semi").distinct()


def own_evidence(vars: DataFrame, atts: DataFrame) -> DataFrame:
    """(file_id, var, by, side): what attributes and dimensions of each variable say; a missing value counts as a fill value."""
    kind = F.when(F.col("att").isin(*DATA), "data").when(F.col("att").isin(*AUXILIARY), "auxiliary")
    by = F.when(F.col("att") == "missing_value", "_FillValue").otherwise(F.col("att"))
    said = atts.where(F.col("value").isNotNull()).select("file_id", "var", by.alias("by"), kind.alias("side")).where("side is not null")
    many = vars.where("size(dims) > 2").select("file_id", "var", F.lit("dimensions").alias("by"), F.lit("data").alias("side"))
    # all dimensions of a variable among those of one that has more
    files = vars.groupBy("file_id").agg(F.collect_set("dims").alias("all_dims"))
    part = F.exists("all_dims", lambda d: (F.size("dims") < F.size(d)) & (F.size(F.array_except("dims", d)) == 0))
    fewer = vars.where("size(dims) > 0").join(files, "file_id").where(part).select("file_id", "var", F.lit("part of dimensions").alias("by"), F.lit("auxiliary").alias("side"))
    axis = vars.select("file_id", F.explode("dims").alias("var")).distinct().join(vars.select("file_id", "var"), ["file_id", "var"], "left_semi").select("file_id", "var", F.lit("dimension").alias("by"), F.lit("auxiliary").alias("side"))
    return said.unionByName(many).unionByName(fewer).unionByName(axis).distinct()


def _mapped(values: dict[str, str]):
    return F.element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))]), F.col("att"))


def _balance(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("file_id", "var").agg(F.count_if(F.col("side") == "data").alias("n_data"), F.count_if(F.col("side") == "auxiliary").alias("n_auxiliary"))


def _sum(counts: DataFrame, more: DataFrame) -> DataFrame:
    """``counts`` (file_id, var, n_data, n_auxiliary; null: none) with what ``more`` has beside."""
    m = more.select("file_id", "var", F.col("n_data").alias("d"), F.col("n_auxiliary").alias("a"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return counts.join(m, ["file_id", "var"], "left").select("file_id", "var", (zero("n_data") + zero("d")).alias("n_data"), (zero("n_auxiliary") + zero("a")).alias("n_auxiliary"))


def variable_roles(vars: DataFrame, atts: DataFrame, order: str | None = None) -> DataFrame:
    """(file_id, var, role, n_data, n_auxiliary) of every variable.

    vars: (file_id, var, type, dims array); atts: (file_id, var, att, value). Roles: ``bounds``, ``map``, ``term`` and ``measure`` by the attribute that names
    a variable that is no data, ``label`` of text, ``coordinate`` of the one dimension it is named after, else ``data`` or ``auxiliary`` by
    evidence. Null files or names are left out, repeated rows count once, references to nothing or to oneself say nothing; an empty
    table has no roles. Of rows of one variable that differ the one of least ``order``, a column of ``vars``, counts; else, and of equal ones, that of least type and dims.
    """
    one = F.struct(*([order] if order else []), "type", F.coalesce("dims", F.array().cast("array<string>")).alias("dims"))
    vars = vars.where("file_id is not null and var is not null").groupBy("file_id", "var").agg(F.min(one).alias("one")).select("file_id", "var", "one.type", "one.dims")
    refs = written(references(atts, vars), "references")
    free = [a for a, (needs, _) in PASSED.items() if needs == "any"]
    says = lambda r: r.select("file_id", F.col("name").alias("var"), F.col("att").alias("by"), _mapped({k: side for k, (_, side) in PASSED.items()}).alias("side"))
    base = written(_balance(own_evidence(vars, atts).select("file_id", "var", "by", "side").unionByName(says(refs.where(F.col("att").isin(free))))), "evidence")
    # what depends on the state of the variable that names another
    open_, passed = refs.where(~F.col("att").isin(free)), refs.where("false")
    while True:
        state = _sum(open_.select("file_id", "var").distinct().join(base, ["file_id", "var"], "left"), _balance(says(passed)))
        is_ = F.when(F.col("n_data") >= F.col("n_auxiliary"), "data").otherwise("auxiliary")
        now = open_.join(state, ["file_id", "var"]).where(_mapped({k: needs for k, (needs, _) in PASSED.items()}) == is_).select(*refs.columns)
        more = written(passed.union(now.join(passed, refs.columns, "left_anti")), "passed")
        old, new = passed.count(), more.count()
        dropped(passed)
        passed = more
        if new == old:
            break
    held = _sum(vars.select("file_id", "var").join(base, ["file_id", "var"], "left"), _balance(says(passed)))
    named = refs.groupBy("file_id", F.col("name").alias("var")).agg(F.collect_set("att").alias("by"))
    d = vars.join(held, ["file_id", "var"], "left").join(named, ["file_id", "var"], "left")
    by = lambda *atts: F.coalesce(F.arrays_overlap("by", F.array(*[F.lit(a) for a in atts])), F.lit(False))
    data = F.col("n_data") >= F.col("n_auxiliary")
    role = (
        F.when(~data & by("bounds", "climatology"), "bounds").when(~data & by("grid_mapping"), "map").when(F.col("type").isin("char", "string"), "label")
        .when((F.size("dims") == 1) & (F.get("dims", F.lit(0)) == F.col("var")), "coordinate").when(~data & by("formula_terms"), "term").when(~data & by("cell_measures"), "measure")
        .when(data, "data").otherwise("auxiliary")
    )
    return d.select("file_id", "var", role.alias("role"), F.col("n_data").cast("long").alias("n_data"), F.col("n_auxiliary").cast("long").alias("n_auxiliary"))
