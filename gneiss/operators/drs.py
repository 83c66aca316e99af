"""Directory structures, file names and requirement tables, as vocabulary and requirement files state them.

The rules are files of some hundred lines: their rows come to the driver, up to a bound, and become conditions. Every file or variable
is then judged in its own row; nothing is paired.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most rows of a rule file that become part of the plan.
MOST_ROWS = 10_000
#: The codes of a file name, a path, a model's name and a component that the vocabulary doesn't know.
NAME, PATH, MODEL, UNKNOWN = "1_1", "1_2", "1_4", "7_3"


def _collected(rules: DataFrame) -> list:
    rows = rules.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a rule file of more than {MOST_ROWS} rows")
    return rows


class Structure:
    """The encodings of one block of a vocabulary: for each its components, their attributes and what they may be."""

    def __init__(self, vocabulary: DataFrame, block: str):
        rows = _collected(vocabulary.where(F.col("section") == block))
        self.encodings: dict[str, list[str]] = {}
        for r in sorted((r for r in rows if r.kind == "encoding"), key=lambda r: (r.name, r.pos)):
            self.encodings.setdefault(r.name, []).append(r.value)
        self.attributes = {r.name: r.value for r in rows if r.kind == "component"}
        self.allowed: dict[str, list[str]] = {}
        for r in sorted((r for r in rows if r.kind == "component value"), key=lambda r: (r.name, r.pos)):
            self.allowed.setdefault(r.name, []).append(r.value)

    def unknown(self) -> list[tuple[str, str]]:
        """(encoding, component) of components that the vocabulary doesn't explain."""
        return [(e, c) for e, parts in sorted(self.encodings.items()) for c in parts if c not in self.attributes]

    def fits(self, component: str, part: Column, own: dict[str, Column], attributes: Column) -> Column:
        """Whether a part is what the file's attributes, or its ``own`` columns, say; a component of neither may be anything.

        An activity is compared without regard to case, a version is digits behind a v, and a component with a list of values
        may be any of these.
        """
        if component == "version number":
            return part.rlike("^v[0-9]+$")
        attribute = self.attributes.get(component)
        if attribute is None and component not in own:
            return F.lit(True)
        want = own[component] if attribute is None else F.element_at(attributes, F.lit(attribute))
        same = F.upper(part) == F.upper(want) if component == "activity" else part == want
        if component in self.allowed:
            same = F.coalesce(same, F.lit(False)) | part.isin(*self.allowed[component])
        return F.coalesce(same, F.lit(False))

    def best(self, kind: str, parts: Column, own: dict[str, Column], attributes: Column, at_end: bool) -> Column:
        """struct<faults, encoding, component>: the encoding of ``kind`` with the fewest parts that don't fit (ties by name), and its first
        such component. Parts lie from the end of a path, or from the beginning of a name; what is missing doesn't fit. Null without encodings."""
        found = []
        for name, components in sorted(self.encodings.items()):
            if not name.endswith(f"-{kind}"):
                continue
            n = len(components)
            first = F.size(parts) - n if at_end else F.lit(0)
            bad = [F.when(~F.coalesce(self.fits(c, F.when(first + k >= 0, F.get(parts, F.greatest(first + k, F.lit(0)))), own, attributes), F.lit(False)), F.lit(c)) for k, c in enumerate(components)]
            more = F.greatest(F.size(parts) - n, F.lit(0)) if not at_end else F.lit(0)
            faults = reduce(lambda a, b: a + b, [F.when(b.isNotNull(), 1).otherwise(0) for b in bad]) + more
            found.append(F.struct(faults.cast("long").alias("faults"), F.lit(name).alias("encoding"), F.coalesce(*bad).alias("component")))
        return F.array_min(F.array(*found)) if found else F.lit(None).cast("struct<faults:bigint,encoding:string,component:string>")


def structure_faults(files: DataFrame, atts: DataFrame, vocabulary: DataFrame, block: str, own: dict[str, str] | None = None, models: dict[str, str] | None = None) -> DataFrame:
    """(file_id, code, encoding, component) of paths and names that no encoding of the vocabulary's ``block`` fits.

    files: (file_id, path, name, ...); atts: (file_id, att, value), global ones. ``own`` maps components that have no attribute to columns of
    ``files``; ``models`` maps a component to the one whose value its own has to begin with (an institution's models: ``SMHI-RCA4``). 1_1 is a name, 1_2 a
    path, 1_4 a model's name; component is the first that doesn't fit, null where a name has parts left over. A path's further
    directories in front are no fault; a null path or name has no finding. Components that the vocabulary doesn't know are 7_3 and
    have a null file_id.
    """
    rules = Structure(vocabulary, block)
    maps = atts.where("att is not null and value is not null").groupBy("file_id", "att").agg(F.min("value").alias("value")).groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("att", "value"))).alias("g"))
    f = files.join(maps, "file_id", "left")
    has = {c: F.col(col) for c, col in (own or {}).items()}
    path = rules.best("DS", F.filter(F.split("path", "/"), lambda x: x != ""), has, F.col("g"), True)
    name = rules.best("FE", F.split(F.regexp_replace("name", r"\.nc$", ""), "_"), has, F.col("g"), False)
    value = lambda c: F.element_at("g", F.lit(rules.attributes[c]))
    wrong = [F.when(~F.startswith(value(m), F.concat(value(i), F.lit("-"))), F.struct(F.lit(MODEL).alias("code"), F.lit(None).cast("string").alias("encoding"), F.lit(m).alias("component"))) for m, i in (models or {}).items()]
    told = lambda b, code: F.when(b["faults"] > 0, F.struct(F.lit(code).alias("code"), b["encoding"].alias("encoding"), b["component"].alias("component")))
    judged = f.select("file_id", F.when(F.col("path").isNotNull(), path).alias("p"), F.when(F.col("name").isNotNull(), name).alias("n"), F.array(*wrong).cast("array<struct<code:string,encoding:string,component:string>>").alias("m"))
    found = judged.select("file_id", F.inline(F.array_compact(F.concat(F.array(told(F.col("p"), PATH), told(F.col("n"), NAME)), "m"))))
    kind = dict(files.dtypes)["file_id"]
    strange = files.sparkSession.createDataFrame([(UNKNOWN, e, c) for e, c in rules.unknown()], "code string, encoding string, component string")
    return found.union(strange.select(F.lit(None).cast(kind).alias("file_id"), "code", "encoding", "component"))


# Codes of a variable's departures from its row of a requirement table.
ABSENT, TYPE, STANDARD_NAME, LONG_NAME, UNITS, CELL_METHODS, CASE = "3_1", "3_2", "3_3", "3_4", "3_6", "3_7", "3_8"


def same_words(a: Column, b: Column) -> Column:
    """Whether long names agree: without regard to case, or ``b`` has more than three words of three letters or more and all but one of them are
    among those of ``a``, two letters at most apart."""
    words = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: F.length(w) >= 3)
    there = F.size(F.filter(words(b), lambda w: F.exists(words(a), lambda x: (x == w) | ((F.length(w) > 4) & (F.levenshtein(x, w) <= 2)))))
    return (F.lower(F.trim(a)) == F.lower(F.trim(b))) | ((F.size(words(b)) > 3) & (F.size(words(b)) - there < 2))


def requirement_faults(vars: DataFrame, requirements: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """(file_id, var, code) of variables that are not as their row of the requirement table says.

    vars: (file_id, sheet, var, type, role, standard_name, long_name, units, cell_methods), sheet the frequency; requirements: (sheet, entry, name, value), the
    cells that ``sources.vocabulary.requirements`` reads; types: (kind, section, name, pos, value) of ``vocabulary``, in which a role's
    section (``DATA_VAR``, ``AUX_VAR``) has the attribute ``VAR_TYPE``. A row is found by the variable's name without regard to case; without one the only
    finding is 3_1, for data variables. What a row leaves out isn't asked for. Cell methods are not asked of ``fx`` and may be those of either
    column. Null names are left out. The table is small: it is broadcast, up to ``MOST_ROWS`` cells.
    """
    _collected(requirements)
    cols = ["standard name", "long name", "units", "cell_methods", "cell_methods_opt"]
    table = requirements.groupBy("sheet", "entry").pivot("name", cols).agg(F.min("value"))
    table = table.select("sheet", F.lower("entry").alias("low"), F.col("entry").alias("want_name"), *[F.col(f"`{c}`").alias("want_" + c.replace(" ", "_")) for c in cols], F.lit(True).alias("there")).dropDuplicates(["sheet", "low"])
    v = vars.where("var is not null").withColumn("low", F.lower("var")).join(F.broadcast(table), ["sheet", "low"], "left")
    wanted = {r.section: r.value for r in _collected(types.where("kind = 'attribute value' and name = 'VAR_TYPE'"))} if types is not None else {}
    kind = F.when(F.col("role") == "data", F.lit(wanted.get("DATA_VAR"))).otherwise(F.lit(wanted.get("AUX_VAR")))
    kind = F.coalesce(reduce(lambda a, s: a.when(F.col("var") == s, F.lit(wanted[s])), wanted, F.when(F.lit(False), F.lit(None).cast("string"))), kind)
    asked = lambda want, bad, code: F.when(F.col(want).isNotNull() & F.coalesce(bad, F.lit(True)), code)
    plain = lambda c: F.regexp_replace(F.trim(c), "[ \t]+", " ")
    methods = (plain(F.col("cell_methods")) == plain(F.col("want_cell_methods"))) | F.coalesce(plain(F.col("cell_methods")) == plain(F.col("want_cell_methods_opt")), F.lit(False))
    codes = F.array_compact(F.array(
        F.when(F.col("there").isNull() & (F.col("role") == "data"), ABSENT), F.when(F.coalesce(F.col("type") != kind, F.lit(False)), TYPE),
        F.when(F.col("var") != F.col("want_name"), CASE), asked("want_standard_name", F.col("standard_name") != F.col("want_standard_name"), STANDARD_NAME),
        asked("want_long_name", ~same_words(F.col("long_name"), F.col("want_long_name")), LONG_NAME), asked("want_units", F.col("units") != F.col("want_units"), UNITS),
        F.when(F.col("sheet") != "fx", asked("want_cell_methods", ~methods, CELL_METHODS)),
    ))
    return v.select("file_id", "var", F.explode(codes).alias("code"))
