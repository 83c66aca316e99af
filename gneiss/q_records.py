"""Queries over record statistics, anomalies, histograms and time axes."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.fixtures import EVENT_CELLS, RECORDS, event_cells
from gneiss.operators import anomaly, histogram, statistics, timeaxis
from gneiss.sources.shared import dealt
from gneiss.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _month(c="l_shipdate"):
    return (F.year(c) * 100 + F.month(c)).alias("month")


def _records(spark, sf_dir):
    return statistics.field_stats(event_cells(spark, sf_dir), ["var", "day"], "v", fill=F.col("v") == 1e20)


@query("""SELECT year(l_shipdate) * 100 + month(l_shipdate) AS month, count(*) AS n, min(l_extendedprice) AS mn, max(l_extendedprice) AS mx,
 round(avg(l_extendedprice), 3) AS ave, round(stddev_samp(l_extendedprice), 2) AS std FROM lineitem GROUP BY 1""")
def field_stats_month(spark, sf_dir):
    r = statistics.field_stats(table(spark, sf_dir, "lineitem").select(_month(), "l_extendedprice"), ["month"], "l_extendedprice")
    return r.select("month", "n", "mn", "mx", F.round("ave", 3).alias("ave"), F.round("std", 2).alias("std"))


@query("""SELECT year(l_shipdate) * 100 + month(l_shipdate) AS month, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 3) AS ave,
 round(sqrt((sum(l_quantity * l_extendedprice * l_extendedprice) * sum(l_quantity) - pow(sum(l_quantity * l_extendedprice), 2)) / (pow(sum(l_quantity), 2) - sum(l_quantity * l_quantity))), 2) AS std,
 round(sum(l_quantity), 2) AS w FROM lineitem GROUP BY 1""")
def field_stats_weighted(spark, sf_dir):
    r = statistics.field_stats(table(spark, sf_dir, "lineitem").select(_month(), "l_extendedprice", "l_quantity"), ["month"], "l_extendedprice", "l_quantity")
    return r.select("month", F.round("ave", 3).alias("ave"), F.round("std", 2).alias("std"), F.round("w", 2).alias("w"))


@query(f"WITH {RECORDS} SELECT var, day, n, size, nan_count, fill_count FROM records")
def exception_counts(spark, sf_dir):
    return _records(spark, sf_dir).select("var", "day", "n", "size", "nan_count", "fill_count")


@query("""SELECT year(l_shipdate) * 100 + month(l_shipdate) AS month, count(*) AS n, round(avg(l_extendedprice), 3) AS ave, round(stddev_samp(l_extendedprice), 2) AS std FROM lineitem GROUP BY 1""")
def merged_state(spark, sf_dir):
    """States of (month, returnflag) merged to months are those of the months."""
    parts = statistics.partial_states(table(spark, sf_dir, "lineitem").select(_month(), "l_returnflag", "l_extendedprice"), ["month", "l_returnflag"], "l_extendedprice")
    r = statistics.finished(statistics.merged(parts, ["month"]), weighted=False)
    return r.select("month", "n", F.round("ave", 3).alias("ave"), F.round("std", 2).alias("std"))


@query(f"""WITH {RECORDS} SELECT var, count(*) AS records, round(min(mn), 3) AS mn_min, round(max(mx), 2) AS mx_max, round(avg(ave), 3) AS ave_ave, round(max(std), 2) AS std_max
 FROM records WHERE n > 0 GROUP BY var""")
def stats_of_stats(spark, sf_dir):
    r = statistics.stats_of_stats(_records(spark, sf_dir), ["var"])
    return r.select("var", "records", F.round("mn_min", 3).alias("mn_min"), F.round("mx_max", 2).alias("mx_max"), F.round("ave_ave", 3).alias("ave_ave"), F.round("std_max", 2).alias("std_max"))


_FLAG = "(CASE WHEN n = 0 THEN 100 ELSE 0 END + CASE WHEN n > 1 AND mn = mx THEN 200 ELSE 0 END + CASE WHEN nan_count > 0 THEN 6400 ELSE 0 END)"


@query(f"WITH {RECORDS} SELECT var, day, CAST({_FLAG} AS BIGINT) AS flag FROM records WHERE {_FLAG} > 0")
def record_flags(spark, sf_dir):
    return anomaly.record_flags(_records(spark, sf_dir)).where("flag > 0").select("var", "day", F.col("flag").cast("long").alias("flag"))


@query(f"""WITH {RECORDS}, f AS (SELECT {_FLAG} AS flag FROM records)
 SELECT code, count(*) AS n FROM (SELECT unnest([c for c in [100, 200, 6400] if (CASE c WHEN 100 THEN flag IN (100, 6500) WHEN 200 THEN flag IN (200, 6600) ELSE flag >= 6400 END)]) AS code FROM f) GROUP BY code""")
def flag_sum_decode(spark, sf_dir):
    r = anomaly.record_flags(_records(spark, sf_dir))
    return r.select(F.explode(anomaly.decoded(F.col("flag"))).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query("""SELECT l_returnflag, count(*) AS records, bool_and(n > 1 AND mn = mx) AS code_6_1, bool_and(n = 0) AS code_6_2, count(*) > 1 AND min(sum) = max(sum) AS code_6_3
 FROM (SELECT l_returnflag, l_linenumber, count(*) AS n, min(l_tax * 0) AS mn, max(l_tax * 0) AS mx, min(l_returnflag) AS sum FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def whole_series(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("v", F.col("l_tax") * 0)
    r = statistics.field_stats(l, ["l_returnflag", "l_linenumber"], "v").withColumn("sum", F.col("l_returnflag"))
    return anomaly.whole_series(r, ["l_returnflag"], "sum").select("l_returnflag", "records", "code_6_1", "code_6_2", "code_6_3")


@query("""SELECT var, units, CASE WHEN units = '%' AND lo >= 0 AND hi <= 1 THEN '6_8' WHEN units = '1' AND lo >= 0 AND hi > 1 AND hi <= 100 THEN '6_9' END AS code FROM (
 SELECT 'l_discount' AS var, '%' AS units, min(l_discount) AS lo, max(l_discount) AS hi FROM lineitem UNION ALL SELECT 'l_quantity', '1', min(l_quantity), max(l_quantity) FROM lineitem
 UNION ALL SELECT 'l_tax', '1', min(l_tax), max(l_tax) FROM lineitem)""")
def percent_plausibility(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_discount", "l_quantity", "l_tax")
    long = l.unpivot([], ["l_discount", "l_quantity", "l_tax"], "var", "v").groupBy("var").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    long = long.withColumn("units", F.when(F.col("var") == "l_discount", "%").otherwise("1"))
    return anomaly.percent_plausibility(long, "units", "lo", "hi").select("var", "units", "code")


_SERIES = f"{RECORDS}, series AS (SELECT var, day, mx AS x FROM records WHERE n > 0)"


@query(f"""WITH {_SERIES}, st AS (SELECT var, avg(x) AS a, stddev_samp(x) AS sd, count(*) AS r FROM series GROUP BY var HAVING count(*) > 1 AND stddev_samp(x) > 0
 AND NOT (min(x) > 0 AND ((max(x) > 1 AND min(x) < 0.001) OR max(x) - min(x) < 1e-8))),
 nk AS (SELECT var, k, count(*) AS nk FROM (SELECT s.var, unnest(range(1, 100)) AS k, abs(x - a) / (sd / 2) AS y FROM series s JOIN st ON st.var = s.var) WHERE y > k GROUP BY var, k),
 hit AS (SELECT var, min(k) AS k FROM (SELECT *, row_number() OVER (PARTITION BY var, nk ORDER BY k) AS rn FROM nk) WHERE rn = 3 GROUP BY var),
 hits AS (SELECT h.var, h.k, n.nk FROM hit h JOIN nk n ON n.var = h.var AND n.k = h.k)
 SELECT s.var, s.day, round(s.x, 3) AS x FROM series s JOIN st ON st.var = s.var JOIN hits h ON h.var = s.var WHERE abs(x - a) / (sd / 2) > h.k
 AND (NOT (h.nk / r > 0.01 * pow(10, greatest(0, ceil(log10(0.1 / (r * 0.01))))) AND h.nk > 5) OR abs(abs(a) - x) > 1000 * pow(10, floor(log10(abs(a)))))""")
def outlier_max(spark, sf_dir):
    s = _records(spark, sf_dir).where("n > 0").select("var", "day", F.col("mx").alias("x"))
    return anomaly.outliers(s, ["var"], "x", run=3, count=5, share=0.01, magnitude=3).select("var", "day", F.round("x", 3).alias("x"))


_REP = """rec AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS rec, CAST(l_quantity AS BIGINT) % 5 AS sum FROM lineitem),
 m AS (SELECT *, min(rec) OVER (PARTITION BY l_suppkey, sum) AS source FROM rec), d AS (SELECT * FROM m WHERE source < rec),
 g AS (SELECT *, sum(CASE WHEN rec - prec = 1 AND source - psource = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY l_suppkey ORDER BY rec) AS island
       FROM (SELECT *, lag(rec) OVER w AS prec, lag(source) OVER w AS psource FROM d WINDOW w AS (PARTITION BY l_suppkey ORDER BY rec)))"""


@query(f"WITH {_REP} SELECT l_suppkey, min(rec) AS first, max(rec) AS last, min(source) AS source, count(*) AS length FROM g GROUP BY l_suppkey, island HAVING max(rec) - min(rec) >= 1")
def replicated_only_groups(spark, sf_dir):
    from pyspark.sql import Window

    l = dealt(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), ["l_suppkey"], 500_000)
    rec = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")).cast("long")
    r = l.select("l_suppkey", rec.alias("rec"), (F.col("l_quantity").cast("long") % 5).alias("sum"))
    return anomaly.replicated(r, ["l_suppkey"], "rec", "sum", only_groups=1)


@query("""SELECT l_partkey, n, round(hlevd, 4) AS hlevd FROM (SELECT l_partkey, count(l_extendedprice) AS n, (max(l_extendedprice) - min(l_extendedprice)) / nullif(stddev_samp(l_extendedprice), 0) AS hlevd
 FROM lineitem GROUP BY 1) WHERE hlevd > 3""")
def hlevd_index(spark, sf_dir):
    return statistics.hlevd(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_extendedprice", 3.0).select("l_partkey", "n", F.round("hlevd", 4).alias("hlevd"))


@query("""WITH f AS (SELECT l_suppkey AS k, regr_slope(l_extendedprice, l_quantity) AS m, regr_intercept(l_extendedprice, l_quantity) AS c FROM lineitem GROUP BY 1)
 SELECT l_suppkey, count(*) AS n, round(stddev_samp(l_extendedprice - m * l_quantity - c), 1) AS std FROM lineitem JOIN f ON k = l_suppkey GROUP BY 1""")
def detrended_spread(spark, sf_dir):
    d = statistics.detrended(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice")
    return d.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.stddev_samp("residual"), 1).alias("std"))


_HIST = "SELECT floor(o_totalprice / {w}) * {w} AS bin_left, count(*) AS n, round(sum(o_totalprice), 2) AS sum_v FROM orders GROUP BY 1"


@query(_HIST.format(w="1000.0"))
def hist_build(spark, sf_dir):
    return histogram.build(table(spark, sf_dir, "orders"), [], "o_totalprice", 1000.0).select("bin_left", "n", F.round("sum_v", 2).alias("sum_v"))


@query("SELECT l_returnflag, floor(l_extendedprice / 5000.0) * 5000.0 AS bin_left, round(sum(l_quantity), 2) AS freq, count(*) AS n FROM lineitem GROUP BY 1, 2")
def hist_weighted(spark, sf_dir):
    h = histogram.build(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", 5000.0, weight="l_quantity")
    return h.select("l_returnflag", "bin_left", F.round("freq", 2).alias("freq"), "n")


@query("""WITH h AS (SELECT floor(o_totalprice / 1000.0) * 1000.0 AS b, count(*) AS n, sum(o_totalprice) AS s FROM orders GROUP BY 1),
 w AS (SELECT 1000.0 * CASE WHEN count(*) <= 50 THEN 1 ELSE pow(2, greatest(1, ceil(ln(((max(b) - min(b)) / 1000.0 + 1) / 50) / ln(2)))) END AS w FROM h)
 SELECT floor(s / n / w) * w AS bin_left, CAST(sum(n) AS BIGINT) AS n FROM h, w GROUP BY 1""")
def hist_resize(spark, sf_dir):
    h, _ = histogram.resized(histogram.build(table(spark, sf_dir, "orders"), [], "o_totalprice", 1000.0), [], 1000.0)
    return h.select("bin_left", F.col("n").cast("long").alias("n"))


@query(_HIST.format(w="1000.0"))
def hist_merge(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    parts = [histogram.build(o.where(f"o_orderkey % 3 = {k}"), [], "o_totalprice", 1000.0) for k in range(3)]
    return histogram.merged(parts[0].union(parts[1]).union(parts[2]), []).select("bin_left", "n", F.round("sum_v", 2).alias("sum_v"))


@query("""WITH a AS (SELECT floor(o_totalprice / 10000.0) * 10000.0 AS b, count(*) AS f FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
 o AS (SELECT floor(o_totalprice / 10000.0) * 10000.0 AS b, count(*) AS f FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
 SELECT coalesce(a.b, o.b) AS bin_left, CAST(coalesce(o.f, 0) - coalesce(a.f, 0) AS DOUBLE) AS diff, coalesce(round(100.0 * (coalesce(o.f, 0) - a.f) / a.f, 4), 1.7976931348623157e308) AS percent FROM a FULL JOIN o ON a.b = o.b""")
def hist_diff(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a, b = (histogram.build(o.where(F.col("o_orderstatus") == s), [], "o_totalprice", 10000.0) for s in "FO")
    return histogram.difference(a, b).select("bin_left", "diff", F.round("percent", 4).alias("percent"))


@query("SELECT year(o_orderdate) // 2 * 2 AS part, floor(o_totalprice / 20000.0) * 20000.0 AS bin_left, count(*) AS n FROM orders GROUP BY 1, 2")
def hist_by_year(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("part", (F.floor(F.year("o_orderdate") / 2) * 2).cast("long"))
    return histogram.build(o, ["part"], "o_totalprice", 20000.0).select("part", "bin_left", "n")


_STEPS = """t AS (SELECT user_id, event_id, CASE WHEN event_id % 20 = 0 THEN CAST(epoch_us(ts) // 3600000000 AS DOUBLE) - 500 WHEN event_id % 31 = 0 THEN 0.0 ELSE CAST(epoch_us(ts) // 3600000000 AS DOUBLE) END AS t FROM events),
 s AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM t),
 r AS (SELECT *, first_value(step IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ref FROM s)"""


@query(f"WITH {_STEPS} SELECT user_id, event_id, CASE WHEN step < 0 THEN 1 WHEN step = 0 THEN 4 WHEN step > 1.25 * ref THEN 2 ELSE 0 END AS flag FROM r")
def time_steps(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    hours = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000).cast("double")
    t = F.when(F.col("event_id") % 20 == 0, hours - 500).when(F.col("event_id") % 31 == 0, 0.0).otherwise(hours)
    return timeaxis.step_flags(e, ["user_id"], ["event_id"], t).select("user_id", "event_id", "flag")


@query("""WITH b AS (SELECT o_custkey, o_orderkey, epoch(o_orderdate) / 86400.0 AS tb0, max(epoch(l_shipdate)) / 86400.0 AS tb1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
 w AS (SELECT *, lag(tb1) OVER (PARTITION BY o_custkey ORDER BY tb0, o_orderkey) AS p FROM b)
 SELECT o_custkey, o_orderkey, CASE WHEN tb1 - tb0 <= 0 THEN 8 ELSE 0 END + CASE WHEN round(tb0, 5) < round(p, 5) THEN 16 ELSE 0 END + CASE WHEN round(tb0, 5) > round(p, 5) THEN 32 ELSE 0 END AS flag FROM w""")
def time_bounds(spark, sf_dir):
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    days = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 86400e6
    ends = l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(days("l_shipdate")).alias("tb1"))
    b = o.select("o_custkey", "o_orderkey", days("o_orderdate").alias("tb0")).join(ends, "o_orderkey")
    return timeaxis.bounds_flags(b, ["o_custkey"], ["tb0", "o_orderkey"]).select("o_custkey", "o_orderkey", "flag")


@query("""WITH s AS (SELECT l_orderkey, sign(l_partkey - lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey)) AS s FROM lineitem)
 SELECT l_orderkey, CASE WHEN coalesce(min(s), 1) > 0 THEN 1 WHEN max(s) < 0 THEN -1 ELSE 0 END AS direction FROM s GROUP BY 1""")
def monotonic_coord(spark, sf_dir):
    return timeaxis.monotonic(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey"], "l_partkey")


@query(f"""WITH {EVENT_CELLS}, d AS (SELECT var, day, avg(v) AS x FROM cells WHERE NOT isnan(v) AND v <> 1e20 GROUP BY 1, 2), w AS (SELECT *, lag(x) OVER o AS a, lead(x) OVER o AS b FROM d WINDOW o AS (PARTITION BY var ORDER BY day))
 SELECT var, day, CASE WHEN x > a THEN 'max' ELSE 'min' END AS kind, round(x - 0.25 * (a - b) * 0.5 * (a - b) / (a - 2 * x + b), 3) AS vertex FROM w WHERE (x > a AND x > b) OR (x < a AND x < b)""")
def local_extrema(spark, sf_dir):
    d = event_cells(spark, sf_dir).where("not isnan(v) and v <> 1e20").groupBy("var", "day").agg(F.avg("v").alias("x"))
    return timeaxis.local_extrema(d, ["var"], ["day"], "x").select("var", "day", "kind", F.round("vertex", 3).alias("vertex"))


_RANGES = [(d, d + 40) for d in range(0, 20000, 90)]


@query("""WITH t AS (SELECT o_orderkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS t FROM orders)
 SELECT o_orderkey, EXISTS (SELECT 1 FROM (SELECT unnest(range(0, 20000, 90)) AS b) WHERE t >= b AND t <= b + 40) AS allowed FROM t""")
def time_table_interval(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    ranges = spark.createDataFrame([(float(a), float(b)) for a, b in _RANGES], "beg double, end double")
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date"))
    return timeaxis.in_time_table(o, day, ranges, 45.0).select("o_orderkey", "allowed")


@query("""WITH l AS (SELECT o_orderkey, o_custkey % 50 AS k, epoch_us(o_orderdate) AS t FROM orders), r AS (SELECT user_id % 50 AS k, epoch_us(ts) AS t, max(event_id) AS e FROM events GROUP BY 1, 2)
 SELECT l.o_orderkey, r.e AS asof_e, r.t AS asof_time FROM l ASOF LEFT JOIN r ON l.k = r.k AND l.t >= r.t""")
def asof_parent_child(spark, sf_dir):
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    l = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("k"), us("o_orderdate").alias("t"))
    r = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 50).alias("k"), us("ts").alias("t")).agg(F.max("event_id").alias("e"))
    return timeaxis.asof(l, r, ["k"], "t", "e").select("o_orderkey", "asof_e", "asof_time")


@query("""WITH s AS (SELECT user_id, max(event_id) AS last_time FROM events WHERE event_id < (SELECT max(event_id) * 3 // 10 FROM events) GROUP BY 1) SELECT e.user_id, e.event_id FROM events e LEFT JOIN s ON s.user_id = e.user_id WHERE last_time IS NULL OR e.event_id > last_time - 1.0""")
def resume_filter(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    cut = e.agg(F.expr("max(event_id) * 3 div 10")).first()[0] or 0
    state = e.where(F.col("event_id") < cut).groupBy("user_id").agg(F.max("event_id").alias("last_time")).withColumn("last_step", F.lit(10.0))
    return timeaxis.resumed(e, state, ["user_id"], F.col("event_id")).select("user_id", "event_id")


@query("""WITH r AS (SELECT l_orderkey, l_partkey >> 16 AS hi, l_partkey & 65535 AS lo, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
 SELECT l_orderkey, CAST(sum(hi * (2 * n - 2 * k + 2) + lo * (2 * n - 2 * k + 1)) % 65535 * 65536 + sum(hi + lo) % 65535 AS BIGINT) AS fletcher FROM r GROUP BY 1""")
def record_checksums(spark, sf_dir):
    """A fold over the halves of each number; the SQL weighs every half by the sums that it is in."""
    v = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("r"))
    return v.select("l_orderkey", statistics.fletcher32(F.col("r")["l_partkey"]).alias("fletcher"))
