"""Queries over operators of the archive that no other query applies: selection of rules, stateful series, extremes, files, time and text."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gneiss.fixtures import FILES, file_catalog
from gneiss.functions import geometry, strings
from gneiss.operators import annotations, anomaly, catalog, statistics, timeaxis
from gneiss.plans import directives, selection
from gneiss.q_records import ORACLES as RECORD_SQL
from gneiss.q_records import _records
from gneiss.sources.shared import shared_folder
from gneiss.sources.tables import delimited, resolved_names, table
from gneiss.streaming.series import OUTPUT, continue_into

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


@query("""WITH t AS (SELECT user_id AS series, event_id AS seq, value, CASE WHEN event_id % 20 = 0 THEN CAST(event_id AS DOUBLE) - 500 WHEN event_id % 31 = 0 THEN 0.0 ELSE CAST(event_id AS DOUBLE) END AS t FROM events),
 s AS (SELECT *, t - lag(t) OVER (PARTITION BY series ORDER BY seq) AS step FROM t),
 r AS (SELECT *, first_value(step IGNORE NULLS) OVER (PARTITION BY series ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ref FROM s)
 SELECT series, seq, CASE WHEN step < 0 THEN 1 WHEN step = 0 THEN 4 WHEN step > 1.25 * ref THEN 2 ELSE 0 END AS flag, count(*) OVER w AS n, round(sum(value) OVER w, 3) AS s, min(value) OVER w AS mn, max(value) OVER w AS mx
 FROM r WINDOW w AS (PARTITION BY series ORDER BY seq ROWS UNBOUNDED PRECEDING)""")
def stateful_series(spark, sf_dir):
    """Events in three parts, each a run of a stream that goes on from the state store of the one before."""
    at = f"{shared_folder(spark)}/series-{uuid.uuid4().hex}"
    k = F.col("event_id")
    events = table(spark, sf_dir, "events")
    rows = events.select(F.col("user_id").cast("string").alias("series"), k.alias("seq"), F.when(k % 20 == 0, k.cast("double") - 500).when(k % 31 == 0, 0.0).otherwise(k.cast("double")).alias("time"), "value")
    last = events.agg(F.max("event_id")).first()[0] or 0
    for part in range(3):
        rows.where((F.col("seq") * 3 >= part * (last + 1)) & (F.col("seq") * 3 < (part + 1) * (last + 1))).write.mode("append").parquet(f"{at}/arrived")
        continue_into(spark.readStream.schema(rows.schema).parquet(f"{at}/arrived"), f"{at}/out", f"{at}/progress")
    out = spark.read.schema(OUTPUT).parquet(f"{at}/out")
    return out.select(F.col("series").cast("long").alias("series"), "seq", "flag", "n", F.round("s", 3).alias("s"), "mn", "mx")


@query("""SELECT l_orderkey, l_linenumber, var, code FROM (SELECT l_orderkey, l_linenumber, l_returnflag AS var, unnest([
  CASE WHEN l_quantity > 45 AND NOT l_returnflag = 'R' THEN 'large' END, CASE WHEN l_discount > 0.08 AND l_returnflag <> 'N' THEN 'discount' END,
  CASE WHEN (CAST(round(l_extendedprice * 100) AS BIGINT) // CASE l_returnflag WHEN 'A' THEN 1 ELSE 1 END) % 2 = 0 AND l_returnflag = 'N' THEN 'even' END]) AS code FROM lineitem) WHERE code IS NOT NULL""")
def selected_rules(spark, sf_dir):
    """Rules of three modes, some switched off for all or for one variable, one left alone for another."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("var"), "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    rules = {
        "large": ("data", F.col("l_quantity") > 45), "discount": ("meta", F.col("l_discount") > 0.08), "late": ("time", F.col("l_tax") > 0.05), "taxed": ("data", F.col("l_tax") > 0.01),
        "even": ("data", F.round(F.col("l_extendedprice") * 100).cast("long") % 2 == 0),
    }
    options = [("mode", None, "meta,data"), ("without", None, "taxed"), ("without", "R", "large"), ("only", "N", "large,even"), ("only", "A", "large,discount"), ("only", "R", "large,discount")]
    return selection.checked(l, rules, spark.createDataFrame(options, "option string, var string, value string")).select("l_orderkey", "l_linenumber", "var", "code")


@query("""SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN price WHEN 'R' THEN CAST(CAST(substring(b, 1, 34) || repeat('0', 30) AS BIT) AS DOUBLE) ELSE CAST(CAST(substring(b, 1, 44) || repeat('0', 20) AS BIT) AS DOUBLE) END AS cleared
 FROM (SELECT l_orderkey, l_linenumber, l_returnflag, l_extendedprice / 7.0 AS price, CAST(CAST(l_extendedprice / 7.0 AS BIT) AS VARCHAR) AS b FROM lineitem)""")
def selected_bits(spark, sf_dir):
    """Prices without the bits that the options of their flag call noise."""
    options = spark.createDataFrame([("clear_bits", None, "20"), ("clear_bits", "A", "0"), ("clear_bits", "R", "30")], "option string, var string, value string")
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("var"), (F.col("l_extendedprice") / 7.0).alias("v"))
    return l.select("l_orderkey", "l_linenumber", selection.Selection.of(options).cleared(F.col("v")).alias("cleared"))


@query(RECORD_SQL["outlier_max"].replace("mx AS x", "mn AS x"))
def outlier_min(spark, sf_dir):
    s = _records(spark, sf_dir).where("n > 0").select("var", "day", F.col("mn").alias("x"))
    return anomaly.outliers(s, ["var"], "x", run=3, count=5, share=0.01, magnitude=3).select("var", "day", F.round("x", 3).alias("x"))


@query(f"""SELECT var, count(*) AS n, arg_max(x, abs(x)) AS x, arg_max(day, abs(x)) AS day FROM ({RECORD_SQL["outlier_max"]}) GROUP BY var""")
def largest_outliers(spark, sf_dir):
    s = _records(spark, sf_dir).where("n > 0").select("var", "day", F.col("mx").alias("x"))
    found = anomaly.outliers(s, ["var"], "x", run=3, count=5, share=0.01, magnitude=3)
    return anomaly.largest_outlier(found, ["var"], "x", ["day"]).select("var", "n", F.round("x", 3).alias("x"), "day")


@query("""SELECT event_id, value FROM events WHERE value >= 10.5 AND value < 20.25""")
def time_slice(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return timeaxis.sliced(e, F.col("value"), 10.5, 20.25).select("event_id", "value")


@query("""SELECT l_orderkey, l_linenumber, abs(l_discount - l_tax) <= 0.02 AS near, abs(l_quantity - l_partkey % 50) <= 0.1 * greatest(abs(l_quantity), abs(l_partkey % 50)) AS near_share FROM lineitem""")
def close_values(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    near = strings.close(F.round("l_discount", 2).cast("decimal(4,2)"), F.round("l_tax", 2).cast("decimal(4,2)"), 0.02)
    return l.select("l_orderkey", "l_linenumber", near.alias("near"), strings.close(F.col("l_quantity"), (F.col("l_partkey") % 50).cast("double"), 0.1, relative=True).alias("near_share"))


ORACLES["close_values"] = ORACLES["close_values"].replace("abs(l_discount - l_tax) <= 0.02", "abs(CAST(l_discount AS DECIMAL(4,2)) - CAST(l_tax AS DECIMAL(4,2))) <= 0.02")


@query("""SELECT p_partkey, list_contains(string_split(p_name, ' '), w) AS equal, len([x for x in string_split(p_name, ' ') if starts_with(x, w[1:2])]) > 0 AS begins, len([x for x in string_split(p_name, ' ') if contains(x, w[2:3])]) > 0 AS within
 FROM (SELECT p_partkey, p_name, ['red', 'bolt', 'plate', 'old'][CAST(p_size % 4 + 1 AS BIGINT)] AS w FROM part)""")
def among_items(spark, sf_dir):
    w = F.element_at(F.array(*[F.lit(x) for x in ("red", "bolt", "plate", "old")]), (F.col("p_size") % 4 + 1).cast("int"))
    items = F.split("p_name", " ")
    return table(spark, sf_dir, "part").select("p_partkey", strings.among(w, items).alias("equal"), strings.among(F.substring(w, 1, 2), items, "prefix").alias("begins"), strings.among(F.substring(w, 2, 2), items, "substring").alias("within"))


@query("""SELECT page_id, string_split(url, '/')[3] || '_' || string_split(url, '/')[-1] AS name FROM pages WHERE url IS NOT NULL""")
def named_paths(spark, sf_dir):
    return catalog.named(table(spark, sf_dir, "pages").where("url is not null"), "url", [3, -1]).select("page_id", "name")


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS ref, CAST(l_quantity AS DOUBLE) AS t FROM lineitem)
 SELECT l_orderkey, l_linenumber, t + date_diff('day', first_value(ref) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, ref, t), ref) AS t FROM f""")
def rebased_times(spark, sf_dir):
    """Days since the date of each line, as days since that of its order's first line."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.to_timestamp("l_shipdate").alias("ref"), F.col("l_quantity").cast("double").alias("t"))
    at = l.withColumn("t0", F.col("t"))
    return timeaxis.rebased(at, "t", "ref", ["l_orderkey"], ["l_linenumber", "ref", "t0"]).select("l_orderkey", "l_linenumber", F.round("t", 6).alias("t"))


@query("""WITH s AS (SELECT user_id, CASE WHEN user_id % 3 = 0 THEN max(event_id) + 1 ELSE max(event_id) END AS last_time FROM events GROUP BY 1)
 SELECT user_id, last_time FROM s WHERE user_id % 5 > 0 AND user_id % 3 = 0""")
def renewed_series(spark, sf_dir):
    """Users whose stored last event is none of theirs; one in five has no events now and is not judged."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id")
    state = e.groupBy("user_id").agg(F.max("event_id").alias("last_time")).withColumn("last_time", F.when(F.col("user_id") % 3 == 0, F.col("last_time") + 1).otherwise(F.col("last_time")))
    return timeaxis.renewed(e.where("user_id % 5 > 0"), state, ["user_id"], F.col("event_id")).select("user_id", "last_time")


@query("""WITH k AS (SELECT s_suppkey, radians(s_suppkey % 180 - 90.0) AS lat, radians(s_suppkey * 7 % 360 - 180.0) AS lon FROM supplier),
 h AS (SELECT s_suppkey, pow(sin((lat - 0.5) / 2), 2) + cos(lat) * cos(0.5) * pow(sin((lon - 1.0) / 2), 2) AS h FROM k)
 SELECT s_suppkey, round(2 * asin(sqrt(least(1.0, h))), 9) AS angle, round(4 * atan(sqrt(greatest(0.0, tan(0.15 * (1 + s_suppkey % 3)) * pow(tan(0.05 * (1 + s_suppkey % 3)), 3)))), 9) AS excess,
  round(1.191042972e-16 / pow(1e-5, 5) / (exp(1.438776877e-2 / (1e-5 * (200 + s_suppkey % 100))) - 1), 3) AS radiance,
  round(CASE WHEN s_suppkey % 2 = 0 THEN -1 ELSE 1 END * (1 + s_suppkey % 60 + (s_suppkey % 59) / 60.0 + (s_suppkey % 58) / 3600.0), 9) AS degrees FROM h""")
def sphere_measures(spark, sf_dir):
    """Angles between points, the excess of triangles, radiances of black bodies and degrees of arc."""
    k = F.col("s_suppkey")
    lat, lon = k % 180 - 90.0, k * 7 % 360 - 180.0
    side = 0.2 * (1 + k % 3)
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.round(geometry.central_angle(F.degrees(F.lit(1.0)), F.degrees(F.lit(0.5)), lon, lat), 9).alias("angle"), F.round(geometry.triangle_area(side, side, side, 1.0), 9).alias("excess"),
        F.round(geometry.planck(F.lit(1e-5), 200.0 + k % 100), 3).alias("radiance"), F.round(geometry.from_dms(F.when(k % 2 == 0, -1).otherwise(1) * (1 + k % 60), k % 59, k % 58), 9).alias("degrees"),
    )


@query("""SELECT event_id, CASE WHEN event_type = 'click' THEN 3 WHEN event_type = 'view' AND user_id % 5 = 2 THEN 1 ELSE least(user_id % 4 + 1, 3) END AS level FROM events WHERE NOT (event_type = 'error' AND user_id % 5 = 1)""")
def level_limit(spark, sf_dir):
    """Findings whose levels no directive may raise above the limit."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("code"), (F.col("user_id") % 5).cast("string").alias("var"), (F.col("user_id") % 4 + 1).cast("int").alias("level"), F.col("value").cast("string").alias("value"))
    lines = ["clicks & click,L4", "a view & view,L1,2", "errors & error,D,1"]
    return annotations.resolved(e, directives.check_list(spark, lines), limit=3).select("event_id", "level")


@query("""WITH c AS (SELECT user_id, min(event_id) AS t FROM events WHERE event_type = 'purchase' GROUP BY 1), p AS (SELECT user_id, event_id AS t, event_id + user_id % 3 AS tb1 FROM events WHERE event_type <> 'purchase' AND user_id % 7 > 0),
 j AS (SELECT c.user_id, c.t, (SELECT min(p.t) FROM p WHERE p.user_id = c.user_id) AS p0, max(p.t) AS pt, arg_max(p.tb1, p.t) AS tb1 FROM c LEFT JOIN p ON p.user_id = c.user_id AND p.t <= c.t GROUP BY 1, 2)
 SELECT user_id, CASE WHEN t <= p0 THEN 'W36' WHEN pt IS NULL OR t - pt > 400 THEN 'W37' WHEN t - 40 + user_id % 40 <> tb1 THEN 'W38' END AS code FROM j""")
def parent_start(spark, sf_dir):
    """A user's first purchase against what went before it: too early, too late, or bounds that do not meet."""
    e = table(spark, sf_dir, "events")
    children = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.min("event_id").cast("double").alias("time")).withColumn("tb0", F.col("time") - 40 + F.col("user_id") % 40)
    parents = e.where("event_type <> 'purchase' and user_id % 7 > 0").select("user_id", F.col("event_id").cast("double").alias("time"), (F.col("event_id") + F.col("user_id") % 3).cast("double").alias("tb1"))
    return timeaxis.child_start(children, parents, ["user_id"], "time", 400.0).select("user_id", "code")


@query(f"""WITH {FILES}, x AS (SELECT *, size > 90 AS newer, l_suppkey % 4 = 1 AS anew FROM files), w AS (SELECT *, lag(d_end) OVER o AS pd, lag("begin") OVER o AS pb, lag("end") OVER o AS pe, min(length(d_beg)) OVER (PARTITION BY l_suppkey) <> max(length(d_beg)) OVER (PARTITION BY l_suppkey) AS mixed
 FROM x WINDOW o AS (PARTITION BY l_suppkey ORDER BY "begin", "end", d_beg)),
 c AS (SELECT l_suppkey, year, CASE WHEN d_beg < pd THEN 1 ELSE 0 END + CASE WHEN newer THEN 2 ELSE 0 END + CASE WHEN "begin" = pb AND "end" = pe THEN 4 ELSE 0 END + CASE WHEN NOT ("begin" = pb AND "end" = pe) AND "begin" < pe THEN 8 ELSE 0 END + CASE WHEN mixed THEN 16 ELSE 0 END + CASE WHEN anew THEN 32 ELSE 0 END AS c FROM w)
 SELECT l_suppkey, year, CASE WHEN c > 0 THEN c + 10 ELSE 0 END AS code FROM c""")
def file_renewal_codes(spark, sf_dir):
    """All codes of a sequence of files, those newer than their target and those whose data no longer reach the stored end among them."""
    f = file_catalog(spark, sf_dir).withColumns({"mod_time": F.col("size"), "target_time": F.lit(90), "known_end": F.when(F.col("l_suppkey") % 4 == 1, F.col("end") + 1).otherwise(F.col("end"))})
    return catalog.sequence_codes(f, ["l_suppkey"]).select("l_suppkey", "year", "code")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem)
 SELECT l_orderkey, l_linenumber, l_partkey FROM r WHERE r > CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_orderkey % 4 END AND r <= CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_orderkey % 4 END + 2""")
def next_records(spark, sf_dir):
    """The next two lines of each order behind those that are done."""
    l = table(spark, sf_dir, "lineitem")
    done = l.where("l_orderkey % 3 > 0").select("l_orderkey", (F.col("l_orderkey") % 4).alias("last")).distinct()
    return catalog.next_records(l, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], done, 2).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""SELECT 'd' || s_suppkey AS path, 'M1' AS code FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_linenumber = 1)""")
def empty_directories(spark, sf_dir):
    d = table(spark, sf_dir, "supplier").select(F.concat(F.lit("d"), F.col("s_suppkey")).alias("path"))
    files = table(spark, sf_dir, "lineitem").where("l_quantity = 50 and l_linenumber = 1").select(F.concat(F.lit("d"), F.col("l_suppkey")).alias("directory"))
    return catalog.empty_directories(d, files).select("path", "code")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'M2' WHEN p_size < 3 THEN 'M3' WHEN p_type = 'PROMO' THEN 'M4' ELSE 'M6' END AS code FROM part WHERE p_partkey % 11 = 0 OR p_size < 3 OR p_type = 'PROMO' OR p_brand NOT LIKE 'Brand#1%'""")
def file_health(spark, sf_dir):
    """Files that can't be used: links without target, empty, unreadable, or of a name with a strange character."""
    f = table(spark, sf_dir, "part").select(
        "p_partkey", (F.col("p_partkey") % 11 != 0).alias("target_exists"), F.greatest(F.col("p_size") - 2, F.lit(0)).alias("size"), (F.col("p_type") != "PROMO").alias("readable"),
        F.when(F.startswith("p_brand", F.lit("Brand#1")), F.translate("p_brand", "#", "_")).otherwise(F.col("p_brand")).alias("name"),
    )
    return catalog.health(f).select("p_partkey", "code")


@query("""WITH f AS (SELECT user_id % 7 AS area, user_id % 2 + 1 AS level, event_type AS code, 'value ' || CAST(floor(value) AS BIGINT) AS text FROM events WHERE value < 30),
 t AS (SELECT DISTINCT area, level, code, text FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY area, level, code ORDER BY text) AS r, count(*) OVER (PARTITION BY area, level, code) AS different FROM t),
 n AS (SELECT area, level, code, count(*) AS n FROM f GROUP BY 1, 2, 3),
 l AS (SELECT r.area, r.level, r.code, '- code: ' || r.code || chr(10) || '  level: L' || r.level || chr(10) || '  count: ' || any_value(n.n) || chr(10) || '  texts:' || chr(10) || string_agg('    - ' || text, chr(10) ORDER BY text) FILTER (r <= 3) || CASE WHEN any_value(different) > 3 THEN chr(10) || '    - more ...' ELSE '' END AS note
  FROM r JOIN n ON n.area = r.area AND n.level = r.level AND n.code = r.code GROUP BY 1, 2, 3)
 SELECT area, string_agg(note, chr(10) ORDER BY level DESC, code DESC) AS note FROM l GROUP BY 1""")
def finding_notes(spark, sf_dir):
    """The findings of each area as one text."""
    e = table(spark, sf_dir, "events").where("value < 30")
    f = e.select((F.col("user_id") % 7).alias("area"), (F.col("user_id") % 2 + 1).alias("level"), F.col("event_type").alias("code"), F.concat(F.lit("value "), F.floor("value")).alias("text"))
    return annotations.notes(f, ["area"], 3).select("area", "note")


@query("""SELECT row_number() OVER (ORDER BY p_partkey) * 2 AS line, p_name AS first, p_partkey || '' AS second FROM part""")
def rule_lines(spark, sf_dir):
    """A rule file of a continued line with a comment for each part, read as numbered lines."""
    at = f"{shared_folder(spark)}/rules-{uuid.uuid4().hex}"
    part = table(spark, sf_dir, "part").repartition(1).sortWithinPartitions("p_partkey")
    text = F.concat("p_name", F.lit(" , \\\n"), F.col("p_partkey").cast("string"), F.lit(" # a part"))
    part.select(text).write.text(at)
    lines = delimited(spark, f"{at}/*.txt")
    return lines.select("line", F.col("items")[0].alias("first"), F.col("items")[1].alias("second"))


@query("""WITH e AS (SELECT DISTINCT replace(p_name, ' ', '_') AS id, 'K' || min(p_size) AS units FROM part GROUP BY p_name)
 SELECT id AS name, id, units AS canonical_units FROM e UNION ALL SELECT 'old_' || id, id, units FROM e UNION ALL SELECT 'older_' || id, id, units FROM e UNION ALL SELECT 'lost', 'gone', NULL""")
def name_aliases(spark, sf_dir):
    """A table of standard names in XML that the parts make, with aliases, aliases of aliases and one of nothing."""
    at = f"{shared_folder(spark)}/rules-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "part").groupBy(F.translate("p_name", " ", "_").alias("id")).agg(F.min("p_size").cast("string").alias("size"))
    tag = lambda t, id, inner: F.concat(F.lit(f'<{t} id="'), id, F.lit('">'), inner, F.lit(f"</{t}>"))
    entry_of = lambda c: F.concat(F.lit("<entry_id>"), c, F.lit("</entry_id>"))
    entries = tag("entry", F.col("id"), F.concat(F.lit("<canonical_units>K"), "size", F.lit("</canonical_units>")))
    lines = e.select(F.concat_ws("\n", entries, tag("alias", F.concat(F.lit("old_"), "id"), entry_of(F.col("id"))), tag("alias", F.concat(F.lit("older_"), "id"), entry_of(F.concat(F.lit("old_"), "id")))).alias("value"))
    whole = lines.agg(F.concat(F.lit("<table>\n"), F.array_join(F.collect_list("value"), "\n"), F.lit('\n<alias id="lost"><entry_id>gone</entry_id></alias>\n</table>')).alias("value"))
    whole.coalesce(1).write.text(at)
    return resolved_names(spark, f"{at}/*.txt")


@query("""WITH e AS (SELECT value, event_id % 700 AS i FROM events WHERE event_id % 700 < 600)
 SELECT i // 200 AS level, i // 50 % 4 AS band, count(*) AS n, min(value) AS mn, max(value) AS mx, count(DISTINCT i % 50) AS cells FROM e GROUP BY 1, 2""")
def layer_statistics(spark, sf_dir):
    """Statistics of each layer of records of three levels, four bands and fields of fifty cells; what lies beyond is left out."""
    e = table(spark, sf_dir, "events").select("value", (F.col("event_id") % 700).alias("i"))
    l = statistics.layered(e, "i", [3, 4], 50).where("layer is not null")
    g = l.groupBy(F.col("layer")[0].alias("level"), F.col("layer")[1].alias("band"))
    return g.agg(F.count("*").alias("n"), F.min("value").alias("mn"), F.max("value").alias("mx"), F.count_distinct("cell").alias("cells"))
