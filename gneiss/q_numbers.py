"""Queries over the bits of numbers, byte checksums, points in grids and calendars."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from gneiss.functions import bits, calendar
from gneiss.operators import gridlookup
from gneiss.sources.shared import dealt
from gneiss.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


#: Prices with a sign, a fraction without end, and both zeros, infinities and tiny numbers among them.
_VALUE = """CASE WHEN l_linenumber = 7 THEN 0.0 WHEN l_quantity = 50 THEN 1e-310 * l_linenumber WHEN l_quantity = 49 THEN CAST('inf' AS DOUBLE) WHEN l_quantity = 48 THEN CAST(2 AS DOUBLE) ** l_linenumber
 ELSE l_extendedprice / 3.0 END * CASE WHEN l_returnflag = 'A' THEN -1 ELSE 1 END"""


def _value():
    v = F.when(F.col("l_linenumber") == 7, 0.0).when(F.col("l_quantity") == 50, F.lit(1e-310) * F.col("l_linenumber")).when(F.col("l_quantity") == 49, float("inf")).when(F.col("l_quantity") == 48, F.pow(F.lit(2.0), "l_linenumber"))
    return v.otherwise(F.col("l_extendedprice") / 3.0) * F.when(F.col("l_returnflag") == "A", -1).otherwise(1)


@query(f"""WITH v AS (SELECT l_orderkey, l_linenumber, {_VALUE} AS v FROM lineitem)
 SELECT l_orderkey, l_linenumber, CAST(CAST(v AS BIT) AS VARCHAR) AS bits, CAST(CAST(substring(CAST(CAST(v AS BIT) AS VARCHAR), 1, 44) || repeat('0', 20) AS BIT) AS DOUBLE) AS cleared FROM v""")
def cleared_double_bits(spark, sf_dir):
    """The bits of doubles of all sizes, and the doubles without their lowest twenty."""
    v = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", _value().alias("v"))
    return v.select("l_orderkey", "l_linenumber", F.lpad(F.bin(bits.double_bits(F.col("v"))), 64, "0").alias("bits"), bits.clear_low_double_bits(F.col("v"), 20).alias("cleared"))


@query(f"""WITH v AS (SELECT l_orderkey, string_agg(CAST(CAST({_VALUE} AS BIT) AS VARCHAR), '' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS s FROM lineitem GROUP BY 1),
 b AS (SELECT l_orderkey, len(s) // 8 AS n, unnest(range(0, len(s) // 8)) AS i, s FROM v),
 c AS (SELECT l_orderkey, n, i, list_sum([CASE WHEN substring(s, CAST(8 * i + k AS BIGINT), 1) = '1' THEN CAST(2 ** (8 - k) AS BIGINT) ELSE 0 END for k in range(1, 9)]) AS byte FROM b),
 d AS (SELECT l_orderkey, sum(byte) % 65535 AS a, sum((n - i) * byte) % 65535 AS b FROM c GROUP BY 1)
 SELECT l_orderkey, CAST((CASE WHEN b = 0 THEN 65535 ELSE b END) * 65536 + (CASE WHEN a = 0 THEN 65535 ELSE a END) AS BIGINT) AS checksum FROM d""")
def byte_checksums(spark, sf_dir):
    """The checksum of an order's prices, from the states of two parts of its lines joined in order."""
    v = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", _value().alias("v")).alias("line"))
    parts = v.groupBy("l_orderkey", (F.col("line.l_linenumber") > 3).alias("late")).agg(F.sort_array(F.collect_list("line")).alias("r"))
    states = parts.select("l_orderkey", "late", bits.byte_state(F.col("r")["v"]).alias("state"))
    both = states.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("late", "state"))).alias("s"))
    none = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("a", "b", "n")])
    return both.select("l_orderkey", bits.fletcher(F.aggregate("s", none, lambda a, x: bits.joined(a, x["state"]))).alias("checksum"))


@query("""WITH p AS (SELECT event_id, (event_id * 7.313) % 110 - 55 AS lat, (event_id * 13.717) % 360 - 180 AS lon FROM events),
 t AS (SELECT event_id, ((lon + 180 + turn) * 6 - 0.3 * (lat + 60)) / 53.97 AS u, (9 * (lat + 60) - 0.1 * (lon + 180 + turn)) / 53.97 AS v FROM p, (VALUES (0), (360)) x(turn)),
 c AS (SELECT event_id, CAST(floor(u) AS BIGINT) AS i, CAST(floor(v) AS BIGINT) AS j FROM t WHERE u >= 0 AND u < 40)
 SELECT event_id, p_partkey AS cell FROM c JOIN part ON p_partkey = 40 * j + i AND p_partkey < 800 AND i >= 0""")
def grid_lookup(spark, sf_dir):
    """Events in the cells of a sheared grid of parts, which goes on over the date line."""
    k = F.col("p_partkey")
    corner = lambda di, dj: [((a * (F.floor(k / 40) + dj) + b * (k % 40 + di) - c) / 10).cast("decimal(15,9)") for a, b, c in ((60, 1, 600), (3, 90, 1800))]
    around = [corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)]
    cells = table(spark, sf_dir, "part").where("p_partkey < 800").select(k.alias("cell"), F.array(*[c[0] for c in around]).alias("lats"), F.array(*[c[1] for c in around]).alias("lons"))
    # decimals all the way: beside an edge the noise of doubles of large numbers would choose the cell
    e = lambda step, turn: (F.col("event_id") * F.lit(Decimal(step)) % F.lit(Decimal(turn)) - F.lit(Decimal(turn // 2))).cast("decimal(15,9)")
    points = dealt(table(spark, sf_dir, "events").select("event_id"), ["event_id"]).select("event_id", e("7.313", 110).alias("lat"), e("13.717", 360).alias("lon"))
    return gridlookup.located(points, cells, 6.0).select("event_id", "cell")


#: A date an order: its year is moved over some two thousand years, so that it lies on both sides of the change of calendars.
_DATE = "year(o_orderdate) - (o_orderkey % 20) * 100 AS y, month(o_orderdate) AS m, least(day(o_orderdate), 28) AS d"


@query(f"""WITH o AS (SELECT o_orderkey, {_DATE} FROM orders),
 n AS (SELECT *, 365 * (y + 4712) + (y + 4715) // 4 + [0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334][m] + CASE WHEN m > 2 AND y % 4 = 0 THEN 1 ELSE 0 END + d - 1 AS julian,
  date_diff('day', DATE '1970-01-01', make_date(y, m, d)) + 2440588 AS gregorian FROM o)
 SELECT o_orderkey, CAST(julian AS BIGINT) AS julian, CAST(gregorian AS BIGINT) AS gregorian, CAST(CASE WHEN y * 10000 + m * 100 + d >= 15821015 THEN gregorian ELSE julian END AS BIGINT) AS mixed,
  CAST(y * 384 + [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352][m] + d - 1 AS BIGINT) AS custom, y * 10000 + m * 100 + d AS back_julian, y * 10000 + m * 100 + d AS back_gregorian, y * 10000 + m * 100 + d AS back_mixed, y * 10000 + m * 100 + d AS back_custom FROM n""")
def calendar_days(spark, sf_dir):
    """Dates of two thousand years as day numbers of the Julian, the Gregorian, the mixed and a custom calendar, and back."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.year("o_orderdate") - F.col("o_orderkey") % 20 * 100).cast("long").alias("y"), F.month("o_orderdate").cast("long").alias("m"), F.least(F.day("o_orderdate"), F.lit(28)).cast("long").alias("d")
    )
    kinds = {"julian": "julian", "gregorian": "proleptic_gregorian", "mixed": "standard"}
    lengths = [32] * 12
    o = o.select("o_orderkey", *[calendar.calendar_day(F.col("y"), F.col("m"), F.col("d"), k).alias(n) for n, k in kinds.items()], calendar.custom_day(F.col("y"), F.col("m"), F.col("d"), lengths).alias("custom"))
    back = {n: calendar.calendar_date(F.col(n), k) for n, k in kinds.items()} | {"custom": calendar.custom_date(F.col("custom"), lengths)}
    return o.select("*", *[(b["year"] * 10000 + b["month"] * 100 + b["day"]).alias(f"back_{n}") for n, b in back.items()])


@query("""WITH d AS (SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, least(day(o_orderdate), 30) AS d, o_orderkey % 86400 AS s, o_orderkey % 40 AS months, o_orderkey % 50 AS days, o_orderkey * 7 % 90000 AS seconds FROM orders),
 t AS (SELECT *, (y * 12 + m - 1 + 12 + months) * 30 + d - 1 + days + (s + seconds) // 86400 AS n, (s + seconds) % 86400 AS second FROM d)
 SELECT o_orderkey, CAST(n // 360 AS BIGINT) AS year, CAST(n % 360 // 30 + 1 AS BIGINT) AS month, CAST(n % 30 + 1 AS BIGINT) AS day, CAST(second AS BIGINT) AS second FROM t""")
def model_time_sums(spark, sf_dir):
    """Dates of years of 360 days a year, some months, days and seconds later."""
    k = F.col("o_orderkey")
    at = calendar.model_seconds(F.year("o_orderdate"), F.month("o_orderdate"), F.least(F.day("o_orderdate"), F.lit(30)), k % 86400, "360_day")
    o = table(spark, sf_dir, "orders").select("o_orderkey", calendar.add_model_time(at, "360_day", 1, k % 40, k % 50, k * 7 % 90000).alias("t"))
    t = calendar.model_time(F.col("t"), "360_day")
    return o.select("o_orderkey", *[t[c].alias(c) for c in ("year", "month", "day", "second")])
