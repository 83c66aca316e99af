"""What a file's global attributes say of its experiment: source, forcing and ensemble member, each judged in the file's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Descriptors of a source's parts, those that may go without a resolution, and the attributes of an ensemble member.
DESCRIPTORS = ("atmosphere", "ocean", "sea ice", "land")
SHORT = ("sea ice", "land")
MEMBER = ("realization", "initialization_method", "physics_version")


def source_codes(source: Column, model: Column) -> Column:
    """array<string>: 2_7a a source that doesn't begin with a model, 2_7b with another one than ``model``, 2_7c without a year behind it; 2_7d a part
    without a model's name behind its descriptor, 2_7e without a term in brackets, 2_7f with one that is not of a name and a resolution
    (sea ice and land may have the name alone). Parts are set apart by semicolons. An empty or null source has no codes."""
    parts = F.split(F.trim(source), r"\s*;\s*")
    words = F.split(F.get(parts, F.lit(0)), " +")
    first, second = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    no_model = first.rlike(rf"^(|\(.*|({'|'.join(d.split()[0] for d in DESCRIPTORS)}):?)$")
    head = F.array(F.when(no_model, "2_7a").when(~first.eqNullSafe(model), "2_7b"), F.when(~no_model & ~F.coalesce(second.rlike("^[0-9]{4}[,:]?$"), F.lit(False)), "2_7c"))

    def of_part(p):
        told = F.regexp_extract(p, rf"(?:^|\s)({'|'.join(DESCRIPTORS)}):\s*(.*)$", 1)
        rest = F.regexp_extract(p, rf"(?:^|\s)({'|'.join(DESCRIPTORS)}):\s*(.*)$", 2)
        term = F.regexp_extract(rest, r"\(([^()]*)\)", 1)
        terms = F.size(F.filter(F.split(term, ","), lambda x: F.trim(x) != ""))
        fine = (terms == 2) | ((terms == 1) & told.isin(*SHORT))
        return F.when(told == "", F.array().cast("array<string>")).otherwise(F.array(F.when((rest == "") | F.startswith(rest, F.lit("(")), "2_7d"), F.when(~rest.rlike(r"\([^()]*\)"), "2_7e").when(~fine, "2_7f")))

    codes = F.array_distinct(F.array_compact(F.concat(head, F.flatten(F.transform(parts, of_part)))))
    return F.when(F.coalesce(F.trim(source), F.lit("")) != "", codes).otherwise(F.array().cast("array<string>"))


def forcing_codes(forcing: Column, known: list[str]) -> Column:
    """array<string>: 2_6b a list set apart by blanks, 2_6a an item that is not among ``known``; what stands in brackets doesn't count, ``N/A`` is no list."""
    text = F.trim(forcing)
    commas = F.contains(text, F.lit(","))
    bare = F.regexp_replace(text, r"\([^()]*\)", "")
    blanks = ~commas & F.trim(bare).rlike(r"\S\s+\S")
    items = F.filter(F.transform(F.split(bare, F.when(commas, F.lit(",")).otherwise(F.lit(" "))), lambda x: F.trim(x)), lambda x: x != "")
    codes = F.array_compact(F.array(F.when(blanks, "2_6b"), F.when(F.exists(items, lambda x: ~x.isin(*known)), "2_6a")))
    return F.when(text.isNotNull() & (text != "") & (text != "N/A"), codes).otherwise(F.array().cast("array<string>"))


def member_code(value: Column, frequency: Column) -> Column:
    """2_5a a number of the ensemble member that is no whole number, 2_5b 0 but of ``fx``, 2_5c above 0 of ``fx``; null is not judged."""
    whole = value.rlike("^[0-9]+$")
    zero = value.rlike("^0+$")
    return F.when(~whole, "2_5a").when(zero & ~frequency.eqNullSafe("fx"), "2_5b").when(~zero & frequency.eqNullSafe("fx"), "2_5c")


def experiment_faults(atts: DataFrame, forcings: list[str]) -> DataFrame:
    """(file_id, att, code) of global attributes (file_id, att, value): source, forcing, and the numbers of the ensemble member.

    Attributes that are missing are not judged here (``rules.requested`` is for that); of repeated ones the least value counts.
    """
    kinds = ["source", "model_id", "forcing", "frequency", *MEMBER]
    g = atts.where(F.col("att").isin(*kinds) & F.col("value").isNotNull()).groupBy("file_id").pivot("att", kinds).agg(F.min("value"))
    told = lambda att, codes: F.transform(codes, lambda c: F.struct(F.lit(att).alias("att"), c.alias("code")))
    found = F.concat(
        told("source", source_codes(F.col("source"), F.col("model_id"))), told("forcing", forcing_codes(F.col("forcing"), forcings)),
        *[told(m, F.array_compact(F.array(member_code(F.col(m), F.col("frequency"))))) for m in MEMBER],
    )
    return g.select("file_id", F.inline(found))
