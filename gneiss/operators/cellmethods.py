"""The grammar of cell methods, and the rules of chapters 7.3 and 7.4 on what it says.

A text is a row of items ``name: [name: ...] method [where|over|within type ...] [(comment)]``. ``items`` reads it by one fold over
its words. ``faults`` judges each item in the row of its variable, with the variables of its file beside it (one grouping by
file: a file has few variables), so that a text of any number of items moves no rows. Joins are hinted to sort and merge, since Spark takes
what is exploded from a small file for small; only the table of standard names is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions.units import dimension

# The methods that the conventions know, and area types of their list.
METHODS = ("maximum", "mean", "median", "mid_range", "minimum", "mode", "point", "standard_deviation", "sum", "variance")
AREA_TYPES = (
    "all_area_types", "bare_ground", "burnt_vegetation", "clear_sky", "cloud", "crops", "floating_ice_shelf", "forest", "grassland", "grounded_ice_sheet", "ice_free_land", "ice_free_sea",
    "ice_sheet", "lake_ice_or_sea_ice", "land", "land_ice", "natural_grasses", "pastures", "primary_deciduous_trees", "primary_evergreen_trees", "river", "sea", "sea_ice", "shrubs", "snow",
    "trees", "unfrozen_soil", "urban", "vegetation",
)


def items(text: str) -> Column:
    """array<struct<names, words, comments>> of the column ``text``, in order.

    A word that ends in a colon is a name: it begins an item if the item before has its method, else it is one more name of this
    one. ``words`` are the method and what follows it; comments keep their parentheses. Null gives null, a text without words
    no item; what stands before the first name is left out, and so is a comment that doesn't end.
    """
    kind = "array<struct<names:array<string>,words:array<string>,comments:array<string>>>"
    none = "cast(array() as array<string>)"

    def put(items: str, ready: str, comment: str = "acc.comment") -> str:
        return f"named_struct('items', {items}, 'comment', {comment}, 'ready', {ready})"

    def grown(**more: str) -> str:
        """The items with the last one longer by a word in one of its lists."""
        lists = ", ".join(f"'{f}', " + (f"concat(element_at(acc.items, -1).{f}, array({more[f]}))" if f in more else f"element_at(acc.items, -1).{f}") for f in ("names", "words", "comments"))
        return f"concat(slice(acc.items, 1, size(acc.items) - 1), array(named_struct({lists})))"

    name, said = "trim(trailing ':' from w)", "concat_ws(' ', acc.comment, w)"
    new = f"concat(acc.items, array(named_struct('names', array({name}), 'words', {none}, 'comments', {none})))"
    step = f"""case
      when (acc.comment is not null or startswith(w, '(')) and not endswith(w, ')') then {put("acc.items", "acc.ready", said)}
      when acc.comment is not null or startswith(w, '(') then {put(f"case when size(acc.items) = 0 then acc.items else {grown(comments=said)} end", "true", "cast(null as string)")}
      when endswith(w, ':') and acc.ready then {put(new, "false")}
      when endswith(w, ':') then {put(grown(names=name), "false")}
      when size(acc.items) = 0 then acc
      else {put(grown(words="w"), "true")} end"""
    start = f"named_struct('items', cast(array() as {kind}), 'comment', cast(null as string), 'ready', true)"
    return F.expr(f"aggregate(filter(split(trim({text}), ' +'), w -> w <> ''), {start}, (acc, w) -> {step}).items")


def after(words: Column, mode: str) -> Column:
    """The word behind ``mode`` among ``words``: empty if ``mode`` stands last, null if it isn't there."""
    at = F.array_position(words, F.lit(mode)).cast("int")
    return F.when(at > 0, F.coalesce(F.get(words, at), F.lit("")))


def _among(c: Column, values) -> Column:
    return F.coalesce(c.isin(*values), F.lit(False))


def _comment_fault(comment: Column) -> Column:
    """732a: keyword without standardised information; 732d: it comes first; 732c: it ends the text; 732b: no interval of value and units."""
    words = F.filter(F.split(F.translate(comment, "()", "  "), " +"), lambda w: w != "")
    first, last, units = F.get(words, F.lit(0)), F.element_at(words, -1), F.get(words, F.lit(2))
    good = (F.size(words) > 2) & F.coalesce(F.get(words, F.lit(1)).rlike("^[0-9]"), F.lit(False)) & dimension(units).isNotNull()
    return (
        F.when(F.size(words) == 0, F.lit(None).cast("string"))
        .when((first == "comment:") & ~F.contains(comment, F.lit("interval:")), "CF_732a")
        .when(first == "comment:", "CF_732d")
        .when(last == "comment:", "CF_732c")
        .when((first == "interval:") & ~good, "CF_732b")
    )


def _type_fault(name: Column, mode: str, file_vars: Column, coordinates: Column) -> Column:
    """What is wrong with the type behind ``where`` or ``over``: 733b none, 733c no area type, 733d a variable that is no auxiliary label of
    area types, 733e several strings behind ``over``, 733f strings that are no area types, 5j not among the coordinates."""
    v = F.get(F.filter(file_vars, lambda x: x["var"] == name), F.lit(0))
    label = v["label"] & ~v["coord"] & F.coalesce(v["std"] == "area_type", F.lit(False))
    out = F.when(name == "", "CF_733b").when(v.isNull(), F.when(~_among(name, AREA_TYPES), "CF_733c")).when(~label, "CF_733d")
    if mode == "over":
        out = out.when(F.size(v["texts"]) > 1, "CF_733e")
    out = out.when(F.exists(F.coalesce(v["texts"], F.array().cast("array<string>")), lambda t: ~_among(F.trim(t), AREA_TYPES)), "CF_733f")
    return out.when(~v["term"] & ~F.coalesce(F.array_contains(F.split(F.trim(coordinates), " +"), name), F.lit(False)), "CF_5j")


def _item_fault(item: Column, file_vars: Column, coordinates: Column) -> Column:
    """The fault of an item's method or conditions, null if it has none."""
    words = item["words"]
    where, over = after(words, "where"), after(words, "over")
    placed = (item["names"] != F.array(F.lit("time"))) & where.isNotNull()
    typed = F.coalesce(_type_fault(where, "where", file_vars, coordinates), F.when(over.isNotNull(), _type_fault(over, "over", file_vars, coordinates)))
    return (
        F.when(~_among(F.get(words, F.lit(0)), METHODS), "CF_73d")
        .when((F.size(words) > 1) & ~_among(F.get(words, F.lit(1)), ("where", "over", "within")), "CF_733a")
        .when(placed, typed)
    )


def _climatology_fault(items: Column, has: Column) -> Column:
    """74a: fewer than two time items although time is a climatology; 74d: periods that are no climatology's; 74e: no climatology of time."""
    t = F.filter(items, lambda i: i["names"] == F.array(F.lit("time")))
    says = lambda i, mode, period: F.coalesce(after(F.get(t, F.lit(i))["words"], mode) == period, F.lit(False))
    two = (says(0, "within", "years") & says(1, "over", "years")) | (says(0, "within", "days") & says(1, "over", "days"))
    three = says(0, "within", "days") & says(1, "over", "days") & says(2, "over", "years")
    n = F.size(t)
    return F.when((n < 2) & has, "CF_74a").when(((n == 2) & ~two) | ((n == 3) & ~three), "CF_74d").when(n.isin(2, 3) & ~has, "CF_74e")


def _names_without_bounds(items: Column, file_vars: Column) -> Column:
    """Whether some name of an item whose method isn't point is, or by standard name means, a variable without bounds."""
    bare = lambda test: F.exists(file_vars, lambda v: test(v) & ~v["bounded"])
    means = lambda n, v: F.when(n == "area", _among(v["std"], ("longitude", "latitude"))).when(n.isin("longitude", "latitude"), F.coalesce(v["std"] == n, F.lit(False))).otherwise(F.lit(False))
    one = lambda n: F.when(F.exists(file_vars, lambda v: v["var"] == n), bare(lambda v: v["var"] == n)).otherwise(bare(lambda v: means(n, v)))
    return F.exists(items, lambda i: ~F.array_contains(i["words"], "point") & F.exists(i["names"], one))


def file_variables(vars: DataFrame, atts: DataFrame, texts: DataFrame) -> DataFrame:
    """(file_id, file_vars, file_dims): each file's variables with what the rules ask of them."""
    kinds = ("standard_name", "units", "bounds", "climatology", "formula_terms")
    own = atts.where(F.col("att").isin(*kinds) & F.col("value").isNotNull()).groupBy("file_id", "var").pivot("att", list(kinds)).agg(F.min("value"))
    v = vars.join(own.hint("merge"), ["file_id", "var"], "left").join(texts.select("file_id", "var", "texts").hint("merge"), ["file_id", "var"], "left")
    units, std = F.coalesce("units", F.lit("")), F.coalesce("standard_name", F.lit(""))
    row = F.struct(
        F.col("var").alias("var"), F.col("standard_name").alias("std"), "texts",
        ((F.size("dims") == 0) | ((F.col("type") == "char") & (F.size("dims") == 1))).alias("scalar"), F.col("type").isin("char", "string").alias("label"),
        (F.get("dims", F.lit(0)) == F.col("var")).alias("coord"), (F.col("bounds").isNotNull() | F.col("climatology").isNotNull()).alias("bounded"),
        (units.rlike("^degrees?_?(east|E)$") | std.isin("longitude", "grid_longitude")).alias("lon"), (units.rlike("^degrees?_?(north|N)$") | std.isin("latitude", "grid_latitude")).alias("lat"),
        F.col("climatology").isNotNull().alias("clim"),
    )
    terms = F.flatten(F.collect_list(F.regexp_extract_all(F.coalesce("formula_terms", F.lit("")), F.lit(r": *(\w+)"), F.lit(1))))
    by = v.groupBy("file_id").agg(F.collect_list(row).alias("vs"), terms.alias("terms"), F.array_distinct(F.flatten(F.collect_list("dims"))).alias("file_dims"))
    full = F.transform("vs", lambda x: x.withField("term", F.array_contains("terms", x["var"])).withField("coord", F.coalesce(x["coord"], F.lit(False))))
    return by.select("file_id", full.alias("file_vars"), "file_dims")


def faults(vars: DataFrame, atts: DataFrame, names: DataFrame, texts: DataFrame, recommendations: bool = True) -> DataFrame:
    """(file_id, var, code) of what cell methods break; the code of a file that has a climatology and no cell methods has an empty var.

    vars: (file_id, var, type, dims array); atts: (file_id, var, att, value); names: (name) the table of standard names; texts: (file_id, var,
    texts array) the strings of label variables. Where the words can't be told apart (73a, 73b, 732e) nothing else is judged; a faulty comment or
    item ends the judgement of a text, what was found before it stands. ``recommendations`` adds 731a, 73e and 734a. Null values and
    texts without words have no findings but 73b; variables of null file or name are left out; each code counts once.
    """
    own = atts.where("att in ('cell_methods', 'coordinates') and value is not null").groupBy("file_id", "var").pivot("att", ["cell_methods", "coordinates"]).agg(F.min("value"))
    context = file_variables(vars.where("file_id is not null and var is not null"), atts, texts)
    d = vars.join(own.where("cell_methods is not null").hint("merge"), ["file_id", "var"]).join(context.hint("merge"), "file_id")
    cm = F.trim("cell_methods")
    d = d.withColumn("items", items("cell_methods")).withColumn("cm", cm)
    count = lambda c: F.length("cm") - F.length(F.replace("cm", F.lit(c), F.lit("")))
    d = d.withColumn("open", count("(") != count(")"))
    apart = F.regexp_replace("cm", "^:+", "").rlike(r":[^ )]|[^ ]\(|\)[^ ]")
    words = F.split(F.col("cm"), " +")
    pairs = ~F.contains("cm", F.lit(":")) | F.col("cm").rlike(r"^:|:$| :") | ~F.endswith(F.get(words, F.lit(0)), F.lit(":"))
    form = F.when(apart, "CF_73a").when(pairs, "CF_73b")
    # names: a dimension of the variable, a scalar or a standard name of the file, area, longitude, latitude or a name of the table
    d = d.withColumn("item_faults", F.transform("items", lambda i: _item_fault(i, F.col("file_vars"), F.col("coordinates"))))
    first_bad = F.array_position(F.transform("item_faults", lambda f: f.isNotNull()), F.lit(True)).cast("int")
    judged = F.when(first_bad > 0, F.slice("items", F.lit(1), first_bad)).otherwise(F.col("items"))
    d = d.withColumn("judged_names", F.flatten(F.transform(judged, lambda i: i["names"]))).withColumn("item_fault", F.get("item_faults", first_bad - 1))
    strange = F.filter(
        "judged_names",
        lambda n: ~F.array_contains("dims", n) & ~F.exists("file_vars", lambda v: (v["scalar"] & (v["var"] == n)) | F.coalesce(v["std"] == n, F.lit(False))) & (F.array_contains("file_dims", n) | ~n.isin("area", "longitude", "latitude")),
    )
    d = d.withColumn("strange", strange).withColumn("comment_fault", F.get(F.filter(F.transform(F.flatten(F.transform("items", lambda i: i["comments"])), _comment_fault), lambda c: c.isNotNull()), F.lit(0)))
    has = lambda test: F.exists("file_vars", test)
    clim = F.when(has(lambda v: v["var"] == "time"), _climatology_fault(F.col("items"), has(lambda v: (v["var"] == "time") & v["clim"])))
    plane = lambda n: F.exists("file_vars", lambda v: (v["var"] == n) & (v["lon"] | v["lat"]))
    area = F.exists("items", lambda i: F.exists(F.zip_with(F.slice(i["names"], 2, F.size(i["names"])), i["names"], lambda x, y: F.coalesce(plane(x) & plane(y), F.lit(False))), lambda both: both))
    lon, lat = has(lambda v: v["lon"] | (v["var"] == "longitude")), has(lambda v: v["lat"] | (v["var"] == "latitude"))
    scope = lambda n: ~has(lambda v: v["var"] == n) & (((n == "area") & ~(lon & lat)) | ((n == "longitude") & ~lon) | ((n == "latitude") & ~lat))
    wide = F.exists("items", lambda i: ~F.array_contains(i["words"], "point") & F.exists(i["names"], scope))
    told = F.coalesce("comment_fault", "item_fault").isNull()
    recos = [F.when(told & _names_without_bounds(F.col("items"), F.col("file_vars")), "CF_73e"), F.when(told & wide, "CF_734a")] if recommendations else []
    found = F.when(form.isNotNull() | F.col("open"), F.array(form, F.when(F.col("open"), "CF_732e"))).otherwise(
        F.array(F.when(F.lit(recommendations) & area, "CF_731a"), F.coalesce("comment_fault", "item_fault"), F.when(told, clim), *recos)
    )
    one = d.select("file_id", "var", F.explode(F.array_compact(found)).alias("code"))
    # a name that is no other may still be a standard name of the table: only such names meet it
    left = d.where(form.isNull() & ~F.col("open") & F.col("comment_fault").isNull()).select("file_id", "var", "file_dims", F.explode("strange").alias("name"))
    table = names.select("name", F.lit(True).alias("in_table")).distinct()
    unknown = left.join(F.broadcast(table), "name", "left").where("in_table is null or array_contains(file_dims, name)").select("file_id", "var", F.lit("CF_73c").alias("code")).distinct()
    marks = atts.where("att in ('climatology', 'cell_methods') and value is not null").groupBy("file_id").agg(F.bool_or(F.col("att") == "cell_methods").alias("told"))
    return one.unionByName(unknown).unionByName(marks.where("not told").select("file_id", F.lit("").alias("var"), F.lit("CF_74b").alias("code")))
