"""Queries over file catalogues, metadata rules, findings, calendars and functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gneiss.fixtures import FILES, PART_ATTS, RECORDS, event_cells, file_catalog, part_attributes
from gneiss.functions import calendar, geometry, strings
from gneiss.operators import anomaly, annotations, catalog, rules, statistics
from gneiss.plans.directives import check_list
from gneiss.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""WITH {FILES}, w AS (SELECT *, lag(d_end) OVER o AS pd, lag("begin") OVER o AS pb, lag("end") OVER o AS pe, min(length(d_beg)) OVER (PARTITION BY l_suppkey) <> max(length(d_beg)) OVER (PARTITION BY l_suppkey) AS mixed
 FROM files WINDOW o AS (PARTITION BY l_suppkey ORDER BY "begin", "end", d_beg)),
 c AS (SELECT l_suppkey, year, CASE WHEN d_beg < pd THEN 1 ELSE 0 END + CASE WHEN "begin" = pb AND "end" = pe THEN 4 ELSE 0 END + CASE WHEN NOT ("begin" = pb AND "end" = pe) AND "begin" < pe THEN 8 ELSE 0 END + CASE WHEN mixed THEN 16 ELSE 0 END AS c FROM w)
 SELECT l_suppkey, year, CASE WHEN c > 0 THEN c + 10 ELSE 0 END AS code FROM c""")
def file_sequence_codes(spark, sf_dir):
    return catalog.sequence_codes(file_catalog(spark, sf_dir), ["l_suppkey"]).select("l_suppkey", "year", "code")


@query(f"""WITH {FILES}, p AS (SELECT l_suppkey, l_suppkey % 4 AS freq, min("begin") AS b, max("end") AS e FROM files GROUP BY 1)
 SELECT l_suppkey, CASE WHEN b > mb AND e < me THEN 'FAIL:BE' WHEN b > mb THEN 'FAIL:B' WHEN e < me THEN 'FAIL:E' ELSE 'PASS' END AS status
 FROM (SELECT *, min(b) OVER (PARTITION BY freq) AS mb, max(e) OVER (PARTITION BY freq) AS me FROM p)""")
def period_status(spark, sf_dir):
    p = file_catalog(spark, sf_dir).groupBy("l_suppkey").agg((F.first("l_suppkey") % 4).alias("freq"), F.min("begin").alias("begin"), F.max("end").alias("end"))
    return catalog.period_status(p, "freq").select("l_suppkey", "status")


@query(f"""WITH {FILES} SELECT name, regexp_extract(name, '_([0-9]+)-([0-9]+)\\.nc$', 1) AS beg, regexp_extract(name, '_([0-9]+)-([0-9]+)\\.nc$', 2) AS "end" FROM files""")
def filename_period(spark, sf_dir):
    return file_catalog(spark, sf_dir).select("name", catalog.drs_period(F.col("name")).alias("p")).select("name", "p.beg", "p.end")


@query("""SELECT page_id FROM pages WHERE regexp_matches(url, '^(?:https://.*/(en|de)/)') AND NOT regexp_matches(url, '^(?:https?://blog\\.)')""")
def select_lock(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    return catalog.selected(p, "url", "url", [("https://.*/(en|de)/", ".*")], [("https?://blog\\.", ".*")]).select("page_id")


@query("""SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) AS r FROM conversations) WHERE r = 1""")
def dedup_keep_last(spark, sf_dir):
    return catalog.latest(table(spark, sf_dir, "conversations"), ["conv_id"], [F.desc("turn"), F.col("role")]).select("conv_id", "turn", "role")


@query("""WITH req AS (SELECT n_nationkey AS var, event_type AS freq FROM nation, (SELECT DISTINCT event_type FROM events)), del AS (SELECT DISTINCT user_id % 40 AS var, event_type AS freq FROM events WHERE event_type <> 'click' AND (user_id % 40 + length(event_type)) % 5 > 0)
 SELECT var, freq FROM req WHERE freq IN (SELECT freq FROM del) AND NOT EXISTS (SELECT 1 FROM del WHERE del.var = req.var AND del.freq = req.freq)""")
def not_delivered(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    nations = sorted(r[0] for r in table(spark, sf_dir, "nation").select("n_nationkey").distinct().limit(10_001).collect())
    if len(nations) > 10_000:
        raise ValueError("more than 10000 variables are required")
    required = e.select(F.col("event_type").alias("freq")).distinct().select(F.explode(F.array(*[F.lit(n) for n in nations]).cast("array<bigint>")).alias("var"), "freq")
    # of one in five pairs of variable and frequency nothing was delivered
    delivered = e.where("event_type <> 'click' and (user_id % 40 + length(event_type)) % 5 > 0").select((F.col("user_id") % 40).alias("var"), F.col("event_type").alias("freq"))
    return catalog.not_delivered(required, delivered, "freq", "var").select("var", "freq")


@query("""SELECT doc_id, CASE WHEN t = n_chars % 3 AND c <> md5(text) THEN 'M7' WHEN t <> n_chars % 3 AND c = md5(text) THEN 'M8' END AS code
 FROM (SELECT *, lag(md5(text)) OVER w AS c, lag(n_chars % 3) OVER w AS t FROM documents WINDOW w AS (PARTITION BY source, doc_id // 8 ORDER BY doc_id))""")
def checksum_history(spark, sf_dir):
    name = F.concat_ws("/", F.coalesce("source", F.lit("")), F.floor(F.col("doc_id") / 8).cast("string"))
    d = table(spark, sf_dir, "documents").select("doc_id", name.alias("name"), F.md5("text").alias("sum"), (F.col("n_chars") % 3).alias("track"))
    return catalog.checksum_history(d, "name", "doc_id", "sum", "track").select("doc_id", "code")


@query(f"""WITH {PART_ATTS}, w AS (SELECT DISTINCT p_partkey FROM atts), r AS (SELECT 'p_brand' AS att UNION ALL SELECT 'p_type')
 SELECT w.p_partkey, r.att, CASE WHEN a.value IS NULL THEN 'missing' ELSE 'unmatched' END AS code FROM w CROSS JOIN r LEFT JOIN atts a ON a.p_partkey = w.p_partkey AND a.att = r.att
 WHERE a.value IS NULL OR (r.att = 'p_brand' AND a.value NOT IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21', 'Brand#22'))""")
def requested_attributes(spark, sf_dir):
    need = spark.createDataFrame([("p_brand", ["Brand#11", "Brand#12", "Brand#13", "Brand#21", "Brand#22"]), ("p_type", None)], "att string, allowed array<string>")
    return rules.requested(part_attributes(spark, sf_dir), need, ["p_partkey"])


_CUTS = """a AS (SELECT n_nationkey % 5 AS k, n_name AS aux, 'region' AS att, CAST(n_regionkey AS VARCHAR) AS value FROM nation WHERE n_nationkey % 7 <> 3 UNION ALL SELECT n_nationkey % 5, n_name, 'size', CAST(length(n_name) AS VARCHAR) FROM nation WHERE n_nationkey % 7 <> 3 AND n_nationkey % 4 <> 0),
 b AS (SELECT n_nationkey % 5 AS k, n_name AS aux, 'region' AS att, CAST(CASE WHEN n_nationkey % 6 = 0 THEN 9 ELSE n_regionkey END AS VARCHAR) AS value FROM nation WHERE n_nationkey % 7 <> 5 UNION ALL SELECT n_nationkey % 5, n_name, 'size', CAST(length(n_name) AS VARCHAR) FROM nation WHERE n_nationkey % 7 <> 5 AND n_nationkey % 3 <> 0)"""


@query(f"""WITH {_CUTS} SELECT coalesce(a.k, b.k) AS k, coalesce(a.aux, b.aux) AS aux, coalesce(a.att, b.att) AS att,
 CASE WHEN NOT EXISTS (SELECT 1 FROM b y WHERE y.aux = coalesce(a.aux, b.aux)) THEN '8_4' WHEN NOT EXISTS (SELECT 1 FROM a y WHERE y.aux = coalesce(a.aux, b.aux)) THEN '8_5' WHEN b.k IS NULL THEN '8_7' WHEN a.k IS NULL THEN '8_6' ELSE '8_8' END AS code
 FROM a FULL JOIN b ON a.k = b.k AND a.aux = b.aux AND a.att = b.att WHERE a.value IS DISTINCT FROM b.value""")
def consistency_full_outer(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("k", (F.col("n_nationkey") % 5).cast("long"))
    cut = lambda w, more, v: n.where(w).select("k", F.col("n_name").alias("aux"), F.lit("region").alias("att"), v.cast("string").alias("value")).union(
        n.where(w).where(more).select("k", "n_name", F.lit("size"), F.length("n_name").cast("string"))
    )
    a = cut("n_nationkey % 7 <> 3", "n_nationkey % 4 <> 0", F.col("n_regionkey"))
    b = cut("n_nationkey % 7 <> 5", "n_nationkey % 3 <> 0", F.when(F.col("n_nationkey") % 6 == 0, 9).otherwise(F.col("n_regionkey")))
    return rules.consistency(a, b, ["k"])


@query("""WITH p AS (SELECT page_id, string_split(url, '/') AS s FROM pages), e AS (SELECT * FROM (VALUES ('secure', 1, '^https:$'), ('secure', 3, '^.*example\\.com$'), ('plain', 1, '^http:$'), ('plain', 3, '^.*example\\.(org|net)$'), ('plain', 4, '^(en|de|fr|es)$')) t(enc, pos, pat)),
 h AS (SELECT page_id, enc, count(*) AS hits FROM p, e WHERE pos <= len(s) AND regexp_matches(s[pos], pat) GROUP BY 1, 2), sz AS (SELECT enc, count(*) AS n FROM e GROUP BY 1)
 SELECT page_id, enc, faults FROM (SELECT page_id, h.enc, n - hits AS faults, row_number() OVER (PARTITION BY page_id ORDER BY n - hits, h.enc) AS r FROM h JOIN sz ON sz.enc = h.enc) WHERE r = 1""")
def encoding_match(spark, sf_dir):
    enc = [("secure", 0, "^https:$"), ("secure", 2, "^.*example\\.com$"), ("plain", 0, "^http:$"), ("plain", 2, "^.*example\\.(org|net)$"), ("plain", 3, "^(en|de|fr|es)$")]
    return rules.encoding_faults(table(spark, sf_dir, "pages").select("page_id", "url"), "page_id", F.split("url", "/"), spark.createDataFrame(enc, "enc string, pos int, pattern string"))


_KNOWN = ["BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD", "FURNITURE"]


@query("""WITH n AS (SELECT DISTINCT CASE WHEN c_custkey % 3 = 0 THEN substring(c_mktsegment, 2) WHEN c_custkey % 3 = 1 THEN c_mktsegment || 'S' ELSE c_mktsegment END AS name FROM customer), k AS (SELECT unnest(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']) AS k)
 SELECT name, nearest, distance FROM (SELECT name, k AS nearest, levenshtein(name, k) / length(name) AS distance, row_number() OVER (PARTITION BY name ORDER BY levenshtein(name, k), k) AS r FROM n, k WHERE name NOT IN (SELECT k FROM k)) WHERE r = 1 AND distance < 0.25""")
def misspelled_attribute(spark, sf_dir):
    c, s = F.col("c_custkey") % 3, F.col("c_mktsegment")
    names = table(spark, sf_dir, "customer").select(F.when(c == 0, F.substr(s, F.lit(2), F.length(s))).when(c == 1, F.concat(s, F.lit("S"))).otherwise(s).alias("name"))
    return rules.nearest_names(names, _KNOWN)


def _findings(spark, sf_dir):
    r = statistics.field_stats(event_cells(spark, sf_dir), ["var", "day"], "v", fill=F.col("v") == 1e20)
    f = anomaly.record_flags(r).select("var", "day", F.explode("flags").alias("c"), F.col("n").cast("string").alias("value"))
    return f.select(F.concat(F.lit("R"), F.col("c").cast("string")).alias("code"), "var", "day", F.lit(2).alias("level"), "value", F.concat_ws(" ", F.lit("record"), F.col("day").cast("string")).alias("text"))


_CHECKS = ["constant record & R200,L3", "constant record & R200,D,purchase", "bad values & R6400,L4,{click,V=0},{view,D}", "anything & *,L1,signup"]
_FIND = f"""{RECORDS}, find AS (
 SELECT 'R' || c AS code, var, day, 2 AS level, CAST(n AS VARCHAR) AS value, 'record ' || day AS text FROM (
  SELECT *, unnest(list_concat(CASE WHEN n = 0 THEN [100] ELSE [] END, list_concat(CASE WHEN n > 1 AND mn = mx THEN [200] ELSE [] END, CASE WHEN nan_count > 0 THEN [6400] ELSE [] END))) AS c FROM records))"""
_RESOLVED = f"""{_FIND}, res AS (SELECT code, var, day, CASE WHEN code = 'R200' THEN 3 WHEN code = 'R6400' THEN 4 WHEN var = 'signup' THEN 1 ELSE level END AS level, text
 FROM find WHERE NOT (code = 'R200' AND var = 'purchase') AND NOT (code = 'R6400' AND var = 'view'))"""


def _resolved(spark, sf_dir):
    return annotations.resolved(_findings(spark, sf_dir), check_list(spark, _CHECKS))


@query(f"WITH {_RESOLVED} SELECT code, var, day, level FROM res")
def directive_resolution(spark, sf_dir):
    return _resolved(spark, sf_dir).select("code", "var", "day", "level")


@query(f"WITH {_RESOLVED} SELECT var, level, code, count(*) AS n, min(text) AS caption FROM res GROUP BY 1, 2, 3")
def tag_summary(spark, sf_dir):
    return annotations.tag_summary(_resolved(spark, sf_dir), ["var"])


@query(f"WITH {_RESOLVED}, r AS (SELECT *, row_number() OVER (PARTITION BY code, var ORDER BY day) AS place FROM res) SELECT code, var, place, CASE WHEN place > 5 THEN 'more ...' ELSE text END AS text FROM r WHERE place <= 6")
def flood_limit(spark, sf_dir):
    return annotations.flood_limited(_resolved(spark, sf_dir), ["code", "var"], ["day"]).select("code", "var", F.col("place").cast("long").alias("place"), "text")


@query(f"""WITH {_RESOLVED}, f AS (SELECT var, CASE WHEN code = 'R6400' THEN 'data' ELSE 'meta' END AS area, CASE WHEN level > 3 THEN 4 WHEN level > 2 THEN 2 ELSE 3 END AS r FROM res)
 SELECT var, coalesce(['N/A', 'OMIT', 'FIXED', 'PASS', 'FAIL'][max(r) FILTER (WHERE area = 'meta') + 1], 'N/A') AS meta, coalesce(['N/A', 'OMIT', 'FIXED', 'PASS', 'FAIL'][max(r) FILTER (WHERE area = 'data') + 1], 'N/A') AS data FROM f GROUP BY var""")
def check_result_pivot(spark, sf_dir):
    f = _resolved(spark, sf_dir).select("var", F.when(F.col("code") == "R6400", "data").otherwise("meta").alias("area"), F.when(F.col("level") > 3, "FAIL").when(F.col("level") > 2, "FIXED").otherwise("PASS").alias("result"))
    return annotations.check_results(f, ["var"], ["meta", "data"])


@query(f"""WITH {FILES} SELECT l_suppkey, year FROM (SELECT *, max(CASE WHEN (l_suppkey + year) % 10 = 0 THEN 2 ELSE 1 END) OVER (PARTITION BY l_suppkey ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM files) WHERE m IS NULL OR m < 2""")
def lock_propagation(spark, sf_dir):
    f = file_catalog(spark, sf_dir).withColumn("level", F.when((F.col("l_suppkey") + F.col("year")) % 10 == 0, 2).otherwise(1))
    return annotations.unlocked(f, ["l_suppkey"], ["year"], "level").select("l_suppkey", "year")


@query(f"""WITH {_RESOLVED} SELECT code, var, day FROM res r WHERE NOT (code = 'R200' AND EXISTS (SELECT 1 FROM res x WHERE x.code = 'R6400' AND x.var = r.var))""")
def annotation_erase(spark, sf_dir):
    gone = spark.createDataFrame([("R6400", "R200")], "code string, erases string")
    return annotations.erased(_resolved(spark, sf_dir), gone, ["var"]).select("code", "var", "day")


@query("""SELECT p_brand, first(p_size ORDER BY prio, p_partkey) AS p_size, min(prio) AS prio FROM (
 SELECT *, row_number() OVER (PARTITION BY p_brand, prio ORDER BY p_partkey) AS r FROM (SELECT p_brand, p_size, p_partkey, CASE WHEN p_size > 45 THEN 0 WHEN p_size > 20 THEN 1 ELSE 2 END AS prio FROM part)) WHERE r = 1 GROUP BY 1""")
def union_checklists(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    first = Window.partitionBy("p_brand").orderBy("p_partkey")
    cut = lambda w: p.where(w).withColumn("r", F.row_number().over(first)).where("r = 1").select("p_brand", "p_size")
    return annotations.union_by_precedence([cut("p_size > 45"), cut("p_size > 20 and p_size <= 45"), cut("p_size <= 20")], ["p_brand"])


@query("""SELECT o_orderkey, CAST(julian(CAST(o_orderdate AS DATE)) AS BIGINT) AS jd, CAST(o_orderdate AS DATE) AS back, CAST(round(year(o_orderdate) + (dayofyear(o_orderdate) - 1) / (CASE WHEN year(o_orderdate) % 4 = 0 AND (year(o_orderdate) % 100 <> 0 OR year(o_orderdate) % 400 = 0) THEN 366.0 ELSE 365.0 END), 6) AS DOUBLE) AS dy,
 strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso FROM orders""")
def julian_day(spark, sf_dir):
    d = F.col("o_orderdate")
    jd = calendar.julian_day(d)
    return table(spark, sf_dir, "orders").select("o_orderkey", jd.cast("long").alias("jd"), calendar.from_julian_day(jd).alias("back"), F.round(calendar.decimal_year(d), 6).alias("dy"), calendar.iso_format(d).alias("iso"))


@query("""WITH d AS (SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) * 360 + (month(o_orderdate) - 1) * 30 + least(day(o_orderdate), 30) - 1 AS n FROM orders)
 SELECT o_orderkey, n, n // 360 AS year, n % 360 // 30 + 1 AS month, n % 30 + 1 AS day, (n // 360 * 12 + n % 360 // 30 + 14) // 12 * 360 + (n // 360 * 12 + n % 360 // 30 + 14) % 12 * 30 + n % 30 AS later FROM d""")
def model_calendar(spark, sf_dir):
    d = F.col("o_orderdate")
    n = calendar.model_day(F.year(d).cast("long"), F.month(d), F.least(F.day(d), F.lit(30)), "360_day")
    x = table(spark, sf_dir, "orders").select("o_orderkey", n.alias("n"))
    return x.select("o_orderkey", "n", calendar.model_date(F.col("n"), "360_day").alias("d"), calendar.add_model_months(F.col("n"), F.lit(14), "360_day").alias("later")).select("o_orderkey", "n", "d.year", "d.month", "d.day", "later")


@query("""SELECT o_orderkey, CASE WHEN k = 0 THEN make_timestamp(y, 1, 1, 0, 0, 0) WHEN k = 1 THEN make_timestamp(y, m, 1, 0, 0, 0) ELSE make_timestamp(y, m, d, 0, 0, 0) END AS first,
 CASE WHEN k = 0 THEN make_timestamp(y + 1, 1, 1, 0, 0, 0) WHEN k = 1 THEN make_timestamp(y, m, 1, 0, 0, 0) + INTERVAL 1 MONTH ELSE make_timestamp(y, m, d, 0, 0, 0) + INTERVAL 1 DAY END AS after
 FROM (SELECT o_orderkey, o_orderkey % 3 AS k, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d FROM orders)""")
def drs_period_expand(spark, sf_dir):
    d = F.date_format("o_orderdate", "yyyyMMdd")
    n = F.when(F.col("o_orderkey") % 3 == 0, 4).when(F.col("o_orderkey") % 3 == 1, 6).otherwise(8)
    x = table(spark, sf_dir, "orders").select("o_orderkey", F.substr(d, F.lit(1), n).alias("digits"))
    return x.select("o_orderkey", calendar.drs_instant(F.col("digits"), False).cast("timestamp_ntz").alias("first"), calendar.drs_instant(F.col("digits"), True).cast("timestamp_ntz").alias("after"))


@query("""SELECT o_orderkey, ['day', 'hour', 'minute'][CAST(o_orderkey % 3 + 1 AS BIGINT)] AS unit, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS reference FROM orders WHERE o_orderkey % 5 <> 0
 UNION ALL SELECT o_orderkey, NULL, NULL FROM orders WHERE o_orderkey % 5 = 0""")
def time_units(spark, sf_dir):
    unit = F.element_at(F.array(F.lit("days"), F.lit("Hours"), F.lit("minutes")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    text = F.when(F.col("o_orderkey") % 5 == 0, "days after 1850").otherwise(F.concat(unit, F.lit(" since "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 00:00:00")))
    u = table(spark, sf_dir, "orders").select("o_orderkey", calendar.parsed_units(text).alias("u"))
    return u.select("o_orderkey", "u.unit", F.to_date("u.reference").alias("reference"))


@query("""SELECT p_partkey, CAST(regexp_extract(p_brand, '[0-9]+') AS DOUBLE) AS number, len(regexp_extract_all(p_brand, '[A-Za-z]+|[0-9]+')) AS runs, len(string_split(p_type, ' ')) AS n_items, round(levenshtein(p_brand, 'Brand#12') / length(p_brand), 6) AS far FROM part""")
def string_functions(spark, sf_dir):
    b = F.col("p_brand")
    return table(spark, sf_dir, "part").select(
        "p_partkey", strings.number(b).alias("number"), F.size(strings.alternation(b)).cast("long").alias("runs"), F.size(strings.items(F.col("p_type"), " ")).cast("long").alias("n_items"), F.round(strings.distance_share(b, F.lit("Brand#12")), 6).alias("far")
    )


_GRID = "g AS (SELECT vec_id, label, -180.0 + (vec_id % 72) * 5 AS lon, -87.5 + (vec_id % 36) * 5 AS lat, embedding[1] AS v FROM embeddings)"


@query(f"""WITH {_GRID} SELECT vec_id, round(6371000.0 * 6371000.0 * radians(5) * abs(sin(radians(lat + 2.5)) - sin(radians(lat - 2.5))) / 1e6, 1) AS area FROM g""")
def cell_area(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    lon, lat = -180.0 + (F.col("vec_id") % 72) * 5, -87.5 + (F.col("vec_id") % 36) * 5
    return e.select("vec_id", F.round(geometry.cell_area(lon, lon + 5, lat - 2.5, lat + 2.5) / 1e6, 1).alias("area"))


@query(f"""WITH {_GRID} SELECT vec_id, CASE WHEN v > 0 THEN round(cos(radians(lat)) / sum(CASE WHEN v > 0 THEN cos(radians(lat)) END) OVER (PARTITION BY label), 8) END AS weight FROM g""")
def renormalised_weight(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding")[0].alias("v"), F.cos(F.radians(-87.5 + (F.col("vec_id") % 36) * 5)).alias("w"))
    return e.select("vec_id", F.round(geometry.renormalised(F.col("w"), F.col("v") > 0, Window.partitionBy("label")), 8).alias("weight"))


@query(f"""WITH {_GRID} SELECT vec_id, round(degrees(asin(least(1.0, greatest(-1.0, sin(radians(lat)) * sin(radians(39.25)) + cos(radians(lat)) * cos(radians(39.25)) * cos(radians(lon + 162.0)))))), 5) AS rlat FROM g""")
def rotated_pole(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    lon, lat = -180.0 + (F.col("vec_id") % 72) * 5, -87.5 + (F.col("vec_id") % 36) * 5
    return e.select("vec_id", F.round(geometry.rotated(lon, lat, -162.0, 39.25)["lat"], 5).alias("rlat"))


@query("""WITH c AS (SELECT label, i, avg(v) AS m FROM (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS v FROM embeddings) GROUP BY 1, 2)
 SELECT e.vec_id, count(*) FILTER (WHERE abs(e.v - c.m) > 0.25) AS n_off FROM (SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS v FROM embeddings) e JOIN c ON c.label = e.label AND c.i = e.i GROUP BY 1""")
def array_tolerance(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    mean = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("m"))
    centre = mean.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("centre"))
    return rules.array_tolerance(e.join(centre, "label"), "embedding", "centre", 0.25).select("vec_id", F.col("n_off").cast("long").alias("n_off"))
