"""Queries over metadata rules, projections, file periods and continued series."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from gneiss.fixtures import FILES, file_catalog
from gneiss.functions import calendar, geometry
from gneiss.operators import catalog, rules
from gneiss.sources.shared import shared_folder
from gneiss.sources.tables import table
from gneiss.streaming.continuation import Continuation, run_available

QUERIES, ORACLES = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _choice(column, values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (column % len(values) + 1).cast("int"))


_VERTICAL = [("atmosphere_sigma_coordinate", "sigma: v ps: v ptop: v"), ("ocean_s_coordinate", "s: v eta: v depth: v a: v b: v depth_c: v"), ("atmosphere_hybrid_height_coordinate", "a: v b: v orog: v"), ("height", "x: v")]


@query("""SELECT p_partkey AS file_id, CASE WHEN p_partkey % 3 = 2 THEN ['sigma', 's', 'a'][CAST(p_partkey % 4 + 1 AS BIGINT)] ELSE '' END AS missing, CASE WHEN p_partkey % 3 = 1 THEN 'extra' ELSE '' END AS surplus
 FROM part WHERE p_partkey % 4 < 3 AND p_partkey % 3 > 0""")
def formula_terms(spark, sf_dir):
    k = F.col("p_partkey")
    terms = _choice(k, [t for _, t in _VERTICAL])
    terms = F.when(k % 3 == 1, F.concat(terms, F.lit(" extra: v"))).when(k % 3 == 2, F.regexp_replace(terms, "^\\w+: v ?", "")).otherwise(terms)
    a = table(spark, sf_dir, "part").select(k.alias("file_id"), F.lit("lev").alias("var"), _choice(k, [n for n, _ in _VERTICAL]).alias("standard_name"), terms.alias("formula_terms"))
    return rules.formula_terms(a).select("file_id", F.array_join("missing", " ").alias("missing"), F.array_join("surplus", " ").alias("surplus"))


_METHODS = ["time: mean area: maximum where land", "time: lat: foo (interval: 1 h)", "time: minimum within days time: mean over days"]


@query("""SELECT p_partkey AS file_id, m.pos, m.method, m.known, m.scope, m.dims FROM part JOIN (VALUES (0, 0, 'mean', true, '', 'time'), (0, 1, 'maximum', true, 'where land', 'area'), (1, 0, 'foo', false, '', 'time lat'),
 (2, 0, 'minimum', true, 'within days', 'time'), (2, 1, 'mean', true, 'over days', 'time')) m(k, pos, method, known, scope, dims) ON m.k = p_partkey % 3""")
def cell_methods(spark, sf_dir):
    a = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), F.lit("v").alias("var"), _choice(F.col("p_partkey"), _METHODS).alias("value"))
    return rules.cell_methods(a).select("file_id", "pos", "method", "known", "scope", F.array_join("dims", " ").alias("dims"))


@query("""SELECT p_partkey AS file_id, m.role, m.weight, m.tie FROM part JOIN (VALUES (0, 'X', 3, false), (1, 'Y', 2, false), (2, 'T', 2, false), (3, 'Z', 1, false), (5, 'Y', 1, true)) m(k, role, weight, tie) ON m.k = p_partkey % 6""")
def coordinate_roles(spark, sf_dir):
    k = F.col("p_partkey")
    v = table(spark, sf_dir, "part").select(
        k.alias("file_id"), F.lit("c").alias("var"), _choice(k, ["degrees_east", "degree_N", "days since 1850-01-01", "hPa", "kg", "degrees_east"]).alias("units"),
        _choice(k, ["longitude", "latitude", "time", "", "tas", "latitude"]).alias("standard_name"), _choice(k, ["X", "", "", "", "", ""]).alias("axis"),
    )
    return rules.coordinate_roles(v).select("file_id", "role", "weight", "tie")


#: An order's lines as flags: their numbers and masks, and a meaning each, one short for some orders.
_FLAGS = """SELECT l_orderkey AS file_id, {list}(CAST(l_linenumber + CASE WHEN l_orderkey % 11 = 0 AND l_linenumber = 2 THEN -1 ELSE 0 END AS INT)) AS flag_values,
 CASE WHEN l_orderkey % 3 > 0 THEN {list}(CAST(CASE WHEN l_quantity > 47 THEN 0 WHEN l_quantity > 40 THEN 2 ELSE 7 END AS INT)) END AS flag_masks,
 trim(repeat('good ', CAST(count(*) - CASE WHEN l_orderkey % 13 = 0 THEN 1 ELSE 0 END AS INT))) AS flag_meanings FROM {from_} GROUP BY l_orderkey"""


@query(
    f"""WITH a AS ({_FLAGS.format(list="list", from_="(SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber)")}),
 b AS (SELECT *, len([w for w in string_split(flag_meanings, ' ') if w <> '']) AS n FROM a)
 SELECT file_id, code FROM (SELECT file_id, CASE WHEN len(flag_values) <> n OR len(flag_masks) <> n THEN 'sizes' WHEN len(list_distinct(flag_values)) < len(flag_values) THEN 'repeated'
   WHEN list_contains(flag_masks, 0) THEN 'zero_mask'
   WHEN len([i for i in range(1, len(flag_masks) + 1) if (flag_values[i] & flag_masks[i]) <> flag_values[i]]) > 0 THEN 'outside_mask' END AS code FROM b) WHERE code IS NOT NULL"""
)
def flag_attributes(spark, sf_dir):
    """Faults of flags whose values, masks and meanings are those of an order's lines, in their order."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("lines"))
    k = F.col("l_orderkey")
    value = lambda x: (x["l_linenumber"] - F.when((k % 11 == 0) & (x["l_linenumber"] == 2), 1).otherwise(0)).cast("int")
    mask = lambda x: F.when(x["l_quantity"] > 47, 0).when(x["l_quantity"] > 40, 2).otherwise(7).cast("int")
    n = F.size("lines") - F.when(k % 13 == 0, 1).otherwise(0)
    a = l.select(
        k.alias("file_id"), F.transform("lines", value).alias("flag_values"), F.when(k % 3 > 0, F.transform("lines", mask)).alias("flag_masks"), F.array_join(F.array_repeat(F.lit("good"), n), " ").alias("flag_meanings")
    )
    return rules.flag_faults(a).select("file_id", "code")


#: Types of a packed variable and its factors, by size and type of the part; both engines run it.
_PACKED = """SELECT p_partkey AS file_id, CASE WHEN p_size % 4 = 0 THEN 'short' WHEN p_size % 4 = 1 THEN 'int' WHEN p_size % 4 = 2 THEN 'byte' ELSE 'double' END AS type,
 CASE WHEN p_retailprice > 1000 THEN 'float' WHEN p_type = 'ECONOMY' THEN 'double' END AS scale_type, CASE WHEN p_size > 30 THEN 'double' WHEN p_size > 10 THEN 'float' END AS offset_type FROM {part}"""


@query(
    f"""WITH v AS ({_PACKED.format(part="part")}) SELECT file_id, code FROM (SELECT file_id, CASE WHEN scale_type <> offset_type THEN 'factor_types'
 WHEN (scale_type IS NOT NULL OR offset_type IS NOT NULL) AND type NOT IN ('byte', 'short', 'int') THEN 'packed_type' END AS code FROM v) WHERE code IS NOT NULL"""
)
def packing(spark, sf_dir):
    return rules.packing_faults(spark.sql(_PACKED.format(part=f"parquet.`{sf_dir}/part.parquet`"))).select("file_id", "code")


@query("""SELECT l_orderkey AS file_id, c.total, s.size FROM (SELECT l_orderkey, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem GROUP BY 1) c JOIN (SELECT l_orderkey AS k, count(*) * (count(*) + 1) // 2 AS size FROM lineitem GROUP BY 1) s ON k = l_orderkey WHERE total <> size""")
def ragged_counts(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "file_id")
    sizes = l.groupBy("file_id").agg(F.expr("count(*) * (count(*) + 1) div 2").alias("size"))
    return rules.ragged_faults(l.select("file_id", F.col("l_linenumber").cast("long").alias("count")), sizes)


@query("""WITH a AS (SELECT l_orderkey AS file_id, 'v' || l_linenumber AS var, 'cell_measures' AS att, 'a_' || l_returnflag AS name FROM lineitem
 UNION ALL SELECT l_orderkey, 'v' || l_linenumber, 'cell_measures', 'a_' || l_linestatus FROM lineitem
 UNION ALL SELECT l_orderkey, 'v' || l_linenumber, 'ancillary_variables', 'a_' || l_linestatus FROM lineitem),
 v AS (SELECT DISTINCT l_orderkey AS file_id, 'a_' || l_returnflag AS name FROM lineitem WHERE l_quantity > 10 UNION SELECT l_orderkey, 'a_' || l_linestatus FROM lineitem WHERE l_quantity > 30)
 SELECT a.* FROM a WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.file_id = a.file_id AND v.name = a.name)""")
def dangling_references(spark, sf_dir):
    """A line's attributes name cells of its flag and status; its order has those of lines of large quantity."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.concat(F.lit("v"), F.col("l_linenumber").cast("string")).alias("var"), F.concat(F.lit("a_"), "l_returnflag").alias("f"), F.concat(F.lit("a_"), "l_linestatus").alias("s"), "l_quantity")
    measures = l.select("file_id", "var", F.lit("cell_measures").alias("att"), F.concat(F.lit("area: "), "f", F.lit(" volume: "), "s").alias("value"))
    atts = measures.union(l.select("file_id", "var", F.lit("ancillary_variables"), "s")).union(l.select("file_id", "var", F.lit("comment"), F.lit("no_reference")))
    has = l.where("l_quantity > 10").select("file_id", F.col("f").alias("var")).union(l.where("l_quantity > 30").select("file_id", "s"))
    return rules.dangling_references(atts, has, ["cell_measures", "ancillary_variables"]).select("file_id", "var", "att", "name")


@query("""WITH v AS (SELECT o_custkey, o_orderkey, list_sort(list_distinct(list(l_returnflag))) AS vs FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
 w AS (SELECT *, lag(vs) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM v)
 SELECT o_custkey, o_orderkey, unnest([x for x in b if NOT list_contains(vs, x)]) AS var, '3_14' AS code FROM w WHERE b IS NOT NULL UNION ALL SELECT o_custkey, o_orderkey, unnest([x for x in vs if NOT list_contains(b, x)]), '3_15' FROM w WHERE b IS NOT NULL""")
def changed_variables(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_returnflag").alias("vs"))
    return rules.changed_variables(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").join(v, "o_orderkey"), ["o_custkey"], "o_orderkey", "vs")


@query("""WITH need AS (SELECT p_brand, p_name, min(p_type) AS p_type, max(p_size) AS p_size FROM part WHERE p_size <= 25 GROUP BY 1, 2)
 SELECT p.p_partkey, CASE WHEN n.p_type IS NULL THEN '3_1' WHEN p.p_type <> n.p_type THEN 'p_type' WHEN p.p_size <> n.p_size THEN 'p_size' END AS code
 FROM part p LEFT JOIN need n ON p.p_brand = n.p_brand AND p.p_name = n.p_name""")
def requirement_lookup(spark, sf_dir):
    """Parts against a table of brand and name that the smaller ones make."""
    v = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", "p_type", "p_size")
    need = v.where("p_size <= 25").groupBy("p_brand", "p_name").agg(F.min("p_type").alias("p_type"), F.max("p_size").alias("p_size"))
    return rules.looked_up(v, need, ["p_brand", "p_name"], ["p_type", "p_size"]).select("p_partkey", "code")


@query("""WITH g AS (SELECT p_partkey, p_name AS name, p_size AS nlon, p_partkey % 10 AS nlat FROM part),
 d AS (SELECT p_name AS name, max(p_size) AS nlon, min(p_partkey % 10) AS nlat FROM part WHERE p_brand = 'Brand#2' GROUP BY 1), s AS (SELECT nlon, nlat, min(name) AS first FROM d GROUP BY 1, 2)
 SELECT p_partkey, CASE WHEN d.name IS NOT NULL THEN d.name ELSE s.first END AS domain, CASE WHEN d.name IS NOT NULL THEN 'name' WHEN s.first IS NOT NULL THEN 'size' END AS by
 FROM g LEFT JOIN d ON d.name = g.name LEFT JOIN s ON s.nlon = g.nlon AND s.nlat = g.nlat""")
def domain_lookup(spark, sf_dir):
    """Grids of parts, named and sized by them, among the domains that one brand's names make."""
    g = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_name").alias("name"), F.col("p_size").alias("nlon"), (F.col("p_partkey") % 10).alias("nlat"))
    d = g.where("p_brand = 'Brand#2'").groupBy("name").agg(F.max("nlon").alias("nlon"), F.min("nlat").alias("nlat"))
    return rules.domain(g, d).select("p_partkey", "domain", "by")


@query("SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def table_duplicates(spark, sf_dir):
    return rules.duplicated(table(spark, sf_dir, "part"), ["p_brand", "p_size"])


@query(f"""WITH {FILES}, f AS (SELECT *, ['mon', 'day', '6hr'][CAST(l_suppkey % 3 + 1 AS BIGINT)] AS freq, (year - l_suppkey % 3) || substring(d_beg, 5) AS b2 FROM files),
 w AS (SELECT *, lag(b2) OVER o AS p, lead(b2) OVER o AS n FROM f WINDOW o AS (PARTITION BY l_suppkey ORDER BY b2, d_end))
 SELECT l_suppkey, year, CASE WHEN l_suppkey % 3 + 1 > CASE freq WHEN 'mon' THEN 10 WHEN 'day' THEN 5 ELSE 1 END THEN 'span' WHEN p IS NOT NULL AND substring(b2, 5, 2) NOT IN ('', '01') THEN 'begin' WHEN n IS NOT NULL AND substring(d_end, 5, 2) NOT IN ('', '12') THEN 'end' END AS code FROM w""")
def period_cut(spark, sf_dir):
    k = F.col("l_suppkey") % 3
    f = file_catalog(spark, sf_dir).withColumn("freq", _choice(F.col("l_suppkey"), ["mon", "day", "6hr"])).withColumn("d_beg", F.concat((F.col("year") - k).cast("string"), F.expr("substring(d_beg, 5)")))
    return catalog.period_cut(f, ["l_suppkey"], "freq").select("l_suppkey", "year", "code")


@query(f"""WITH {FILES} SELECT l_suppkey, year FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY year DESC) AS r FROM files) WHERE r <= 2""")
def next_files(spark, sf_dir):
    return catalog.next_files(file_catalog(spark, sf_dir), ["l_suppkey"], [F.desc("year")], 2).select("l_suppkey", "year")


@query(f"""WITH {FILES} SELECT l_suppkey, year, greatest("begin", 9000) AS "from", least("end", 9500) AS "to" FROM files WHERE "end" >= 9000 AND "begin" <= 9500""")
def time_limit_files(spark, sf_dir):
    return catalog.overlapping(file_catalog(spark, sf_dir), 9000, 9500).select("l_suppkey", "year", "from", "to")


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) + INTERVAL 12 HOUR AS t, round(epoch(CAST(o_orderdate AS DATE) + INTERVAL 12 HOUR) / 3600.0, 4) AS hours FROM orders""")
def absolute_dates(spark, sf_dir):
    value = F.date_format("o_orderdate", "yyyyMMdd").cast("double") + 0.5
    o = table(spark, sf_dir, "orders").select("o_orderkey", calendar.absolute_date(value).alias("t"))
    return o.select("o_orderkey", F.col("t").cast("timestamp_ntz").alias("t"), F.round(calendar.since(F.col("t"), F.lit("1970-01-01").cast("timestamp"), "hour"), 4).alias("hours"))


@query("""SELECT s_suppkey, round(s_suppkey * 1.5 - CASE WHEN lag(s_suppkey) OVER w IS NULL THEN (lead(s_suppkey) OVER w - s_suppkey) * 1.5 / 2 ELSE (s_suppkey - lag(s_suppkey) OVER w) * 1.5 / 2 END, 4) AS lower FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)""")
def cell_vertices(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumn("c", F.col("s_suppkey") * 1.5)
    return s.select("s_suppkey", F.round(geometry.vertices(F.col("c"), Window.partitionBy("s_nationkey").orderBy("s_suppkey"))["lower"], 4).alias("lower"))


@query("""SELECT vec_id, round(sqrt(sum((e.v - c.v) * (e.v - c.v))), 4) AS distance, count(*) FILTER (WHERE e.v > c.v) AS above FROM (SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS v FROM embeddings) e
 JOIN (SELECT label AS l, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS v FROM (SELECT label, first(embedding ORDER BY vec_id) AS embedding FROM embeddings GROUP BY 1)) c ON c.l = e.label AND c.i = e.i GROUP BY 1""")
def grid_arithmetic(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    base = e.groupBy(F.col("label").alias("l")).agg(F.min_by("embedding", "vec_id").alias("base"))
    d = F.zip_with("embedding", "base", lambda x, y: (x.cast("double") - y.cast("double")))
    j = e.join(base, F.col("label") == F.col("l")).withColumn("d", d)
    return j.select("vec_id", F.round(F.sqrt(F.aggregate("d", F.lit(0.0), lambda a, x: a + x * x)), 4).alias("distance"), F.size(F.filter("d", lambda x: x > 0)).cast("long").alias("above"))


@query("""WITH t AS (SELECT user_id AS series, event_id, value, CASE WHEN event_id % 20 = 0 THEN CAST(event_id AS DOUBLE) - 500 WHEN event_id % 31 = 0 THEN 0.0 ELSE CAST(event_id AS DOUBLE) END AS t FROM events),
 s AS (SELECT *, t - lag(t) OVER (PARTITION BY series ORDER BY event_id) AS step FROM t),
 r AS (SELECT *, first_value(step IGNORE NULLS) OVER (PARTITION BY series ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ref FROM s)
 SELECT series, event_id, CASE WHEN step < 0 THEN 1 WHEN step = 0 THEN 4 WHEN step > 1.25 * ref THEN 2 ELSE 0 END AS flag FROM r""")
def streaming_continuation(spark, sf_dir):
    """Events that arrive in three parts, each a run of the stream that goes on from the one before: the flags are those of
    the whole table, wherever it is cut."""
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events")
    k = F.col("event_id")
    time = F.when(k % 20 == 0, k.cast("double") - 500).when(k % 31 == 0, 0.0).otherwise(k.cast("double"))
    rows = events.select(F.col("user_id").cast("string").alias("series"), k.alias("seq"), time.alias("time"), "value")
    last = events.agg(F.max("event_id")).first()[0] or 0
    sink = Continuation(spark, f"{at}/out")
    for part in range(3):
        rows.where((F.col("seq") * 3 >= part * (last + 1)) & (F.col("seq") * 3 < (part + 1) * (last + 1))).write.mode("append").parquet(f"{at}/arrived")
        run_available(spark.readStream.schema(rows.schema).parquet(f"{at}/arrived"), sink, f"{at}/progress")
    return sink.records().select(F.col("series").cast("long").alias("series"), F.col("seq").alias("event_id"), "flag")
