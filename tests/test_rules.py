"""Rules and numbers on odd rows: nulls, empty tables, ties, clashing names, errors."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from gneiss.functions import bits, calendar
from gneiss.operators import annotations, cellmethods, drs, experiment, gridlookup, roles, rules, sampling
from gneiss.plans.selection import Selection
from gneiss.sources.tables import delimited
from gneiss.sources.vocabulary import vocabulary
from gneiss.streaming.series import OUTPUT, continue_into

VARS = "file_id long, var string, type string, dims array<string>"
ATTS = "file_id long, var string, att string, value string"


def test_items_of_cell_methods(spark):
    texts = ["time: mean", "lat: lon: mean where land over sea (a b) time: sum", "", None, "mean", "time: mean (open", "(x) time: mean", "time:"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", cellmethods.items("t").alias("x")).orderBy("i").collect()
    got = [r.x and [(list(i.names), list(i.words), list(i.comments)) for i in r.x] for r in rows]
    assert got == [
        [(["time"], ["mean"], [])], [(["lat", "lon"], ["mean", "where", "land", "over", "sea"], ["(a b)"]), (["time"], ["sum"], [])], [], None, [], [(["time"], ["mean"], [])], [(["time"], ["mean"], [])], [(["time"], [], [])],
    ]


def test_cell_methods_of_odd_rows(spark):
    vars_ = spark.createDataFrame([(1, "v", "float", ["time"]), (1, None, "float", []), (None, "v", "float", []), (2, "v", "float", None), (3, "v", "float", ["time"])], VARS)
    atts = spark.createDataFrame([(1, "v", "cell_methods", "time: mean"), (1, "v", "cell_methods", "time: mean"), (2, "v", "cell_methods", None), (3, "v", "cell_methods", " "), (3, "x", "cell_methods", "bad")], ATTS)
    names, texts = spark.createDataFrame([("time",)], "name string"), spark.createDataFrame([], "file_id long, var string, texts array<string>")
    assert {tuple(r) for r in cellmethods.faults(vars_, atts, names, texts).collect()} == {(3, "v", "CF_73b")}
    assert cellmethods.faults(vars_.where("false"), atts.where("false"), names, texts).count() == 0


def test_roles_of_odd_rows(spark):
    vars_ = spark.createDataFrame([(1, "a", "float", None), (1, "a", "float", None), (1, None, "float", []), (1, "b", "char", ["n"]), (1, "t", "double", ["t"])], VARS)
    atts = spark.createDataFrame([(1, "a", "coordinates", "b a gone"), (1, "b", "ancillary_variables", None), (1, "t", "bounds", "a")], ATTS)
    got = {r.var: (r.role, r.n_data, r.n_auxiliary) for r in roles.variable_roles(vars_, atts).collect()}
    assert got == {"a": ("data", 1, 1), "b": ("label", 0, 1), "t": ("coordinate", 0, 2)}
    assert roles.variable_roles(vars_.where("false"), atts.where("false")).count() == 0


def test_roles_pass_along_a_chain(spark):
    """a is none by its own word, so its bounds b and their formula terms c are none, and what these name."""
    vars_ = spark.createDataFrame([(1, v, "double", ["n"]) for v in "abcd"], VARS)
    atts = spark.createDataFrame([(1, "a", "axis", "X"), (1, "a", "bounds", "b"), (1, "b", "formula_terms", "x: c"), (1, "c", "formula_terms", "x: d")], ATTS)
    assert {r.var: r.role for r in roles.variable_roles(vars_, atts).collect()} == {"a": "auxiliary", "b": "bounds", "c": "term", "d": "term"}


def test_roles_of_repeated_variables(spark, sf, tmp_path):
    """Of rows of a variable that differ the same one counts in any order of rows; in the query the first of the table, as in the SQL of one thread."""
    import duckdb

    from gneiss import registry

    rows, atts = [(1, "a", "float", ["n"], 2), (1, "a", "char", ["n"], 3), (1, "a", "float", ["a"], 1)], spark.createDataFrame([], ATTS)
    for r in (rows, rows[::-1]):
        vars_ = spark.createDataFrame(r, VARS + ", place int").coalesce(1)
        assert [x.role for x in roles.variable_roles(vars_, atts).collect()] == ["label"]
        assert [x.role for x in roles.variable_roles(vars_, atts, "place").collect()] == ["coordinate"]
    (tmp_path / "lineitem.parquet").mkdir()
    con = duckdb.connect()
    con.sql("SET threads = 1")
    # Spark begins with the larger file
    for name, which in (("a", "LIMIT 1000"), ("b", "OFFSET 1000")):
        con.sql(f"COPY (SELECT * FROM '{sf}/lineitem.parquet' {which}) TO '{tmp_path}/lineitem.parquet/{name}.parquet'")
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.sql(f"SELECT file_id, var, role, n_data, n_auxiliary FROM ({registry.ORACLES['variable_roles']})").fetchall()
    assert sorted(map(tuple, registry.QUERIES["variable_roles"](spark, str(tmp_path)).collect())) == sorted(want)


def test_structures_of_odd_rows(spark, tmp_path):
    (tmp_path / "v.csv").write_text("BEGIN: DRS\n  A-DS: <activity>/<variable name>\n  <activity> = project_id\n  <variable name>\nEND: DRS\n")
    words = vocabulary(spark, str(tmp_path / "v.csv"))
    files = spark.createDataFrame([(1, None, None, "t"), (2, "", "x", "t"), (3, "x/p/t", "x", "t"), (4, "P/u", "x", None)], "file_id long, path string, name string, own string")
    atts = spark.createDataFrame([(i, "project_id", "P") for i in range(1, 5)] + [(3, None, "x"), (3, "project_id", "P")], "file_id long, att string, value string")
    assert {(r.file_id, r.code, r.component) for r in drs.structure_faults(files, atts, words, "DRS", {"variable name": "own"}).collect()} == {(2, "1_2", "activity"), (4, "1_2", "variable name")}
    assert drs.structure_faults(files, atts, words, "NONE").count() == 0


def test_requirements_of_odd_rows(spark):
    need = spark.createDataFrame([("mon", "tas", "units", "K"), ("mon", "tas", "units", "K"), ("mon", "pr", "units", None)], "sheet string, entry string, name string, value string")
    schema = "file_id long, sheet string, var string, type string, role string, standard_name string, long_name string, units string, cell_methods string"
    v = spark.createDataFrame([(1, "mon", "tas", None, "data", None, None, None, None), (2, "mon", "TAS", "float", "data", None, None, "K", None), (3, None, "tas", None, "data", None, None, None, None), (4, "mon", None, None, None, None, None, None, None)], schema)
    assert {tuple(r) for r in drs.requirement_faults(v, need).collect()} == {(1, "tas", "3_6"), (2, "TAS", "3_8"), (3, "tas", "3_1")}
    assert drs.requirement_faults(v.where("false"), need.where("false")).count() == 0


def test_bits_are_those_of_the_machine(spark):
    rnd = random.Random(2)
    values = [0.0, -0.0, 1.0, -1.5, math.pi, 1e-310, 5e-324, 1.7976931348623157e308, 2.2250738585072014e-308, 2.225073858507201e-308, float("inf"), float("-inf"), *[rnd.uniform(-1, 1) * 10 ** rnd.randint(-300, 300) for _ in range(400)], *[2.0**k for k in range(-1074, 1024, 7)]]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(-1, None), (-2, float("nan"))], "i int, v double")
    got = {r.i: r for r in rows.select("i", bits.double_bits(F.col("v")).alias("b"), bits.from_double_bits(bits.double_bits(F.col("v"))).alias("back"), bits.clear_low_double_bits(F.col("v"), 20).alias("c")).collect()}
    for i, v in enumerate(values):
        word = struct.unpack(">q", struct.pack(">d", v))[0]
        assert got[i].b == word and struct.pack(">d", got[i].back) == struct.pack(">d", v)
        assert struct.pack(">d", got[i].c) == struct.pack(">q", word >> 20 << 20) or math.isinf(v)
    assert got[-1].b is None and got[-2].b == 0x7FF8000000000000
    with pytest.raises(ValueError):
        bits.clear_low_double_bits(F.lit(1.0), 60)


def test_parts_of_a_byte_sum_join(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.uniform(-9, 9) for _ in range(rnd.randrange(0, 40))]) for i in range(60)]

    def plainly(values):
        a = b = 65535
        for byte in b"".join(struct.pack(">d", v) for v in values):
            a += byte
            b += a
            a, b = (a & 65535) + (a >> 16), (b & 65535) + (b >> 16)
        a, b = (a & 65535) + (a >> 16), (b & 65535) + (b >> 16)
        return b << 16 | a

    d = spark.createDataFrame(rows, "i int, v array<double>").withColumn("k", F.floor(F.size("v") / 3).cast("int"))
    first, second = bits.byte_state(F.slice("v", F.lit(1), F.col("k"))), bits.byte_state(F.slice("v", F.col("k") + 1, F.size("v")))
    got = {r.i: r for r in d.select("i", bits.fletcher(bits.byte_state(F.col("v"))).alias("whole"), bits.fletcher(bits.joined(first, second)).alias("parts")).collect()}
    assert all(got[i].whole == got[i].parts == plainly(v) for i, v in rows)


def test_grid_of_odd_rows(spark):
    cells = spark.createDataFrame([(1, [0.0, 0.0, 10.0, 10.0], [175.0, 185.0, 185.0, 175.0]), (2, [0.0, 1.0], [0.0, 1.0]), (3, None, None), (4, [0.0, None, 1.0], [0.0, 1.0, 2.0])], "cell int, lats array<double>, lons array<double>")
    points = spark.createDataFrame([(1, 5.0, -178.0), (2, 5.0, 178.0), (3, 5.0, 170.0), (4, None, 178.0), (5, 5.0, 538.0)], "p int, lat double, lon double").selectExpr("*", "1 as lons0")
    assert {(r.p, r.cell) for r in gridlookup.located(points, cells).collect()} == {(1, 1), (2, 1), (5, 1)}
    assert gridlookup.located(points, cells.where("false")).count() == 0
    with pytest.raises(ValueError):
        gridlookup.located(points, cells, 7.0)


def test_calendars_at_the_change(spark):
    d = spark.createDataFrame([(1582, 10, 4), (1582, 10, 15), (-4712, 1, 1), (2000, 2, 29), (0, 3, 1)], "y long, m long, d long")
    n = [r.n for r in d.select(calendar.calendar_day(F.col("y"), F.col("m"), F.col("d"), "standard").alias("n")).collect()]
    assert n[:4] == [2299160, 2299161, 0, 2451604]


def test_sampling_of_empty_tables(spark):
    vars_ = spark.createDataFrame([], f"{VARS}, role string, axis string")
    none = spark.createDataFrame([], "file_id long, var string, value long")
    assert sampling.sampling_faults(vars_, spark.createDataFrame([], ATTS), spark.createDataFrame([], "file_id long, dim string, size long"), none).count() == 0


def test_experiments_of_odd_rows(spark):
    atts = spark.createDataFrame([(1, "source", None), (1, "forcing", " "), (1, "realization", "0"), (1, "frequency", "fx"), (2, "source", "ocean: X (a, b)"), (2, None, "x"), (3, "source", "M 1999 land: (x)")], "file_id long, att string, value string")
    assert {tuple(r) for r in experiment.experiment_faults(atts, ["Nat"]).collect()} == {(2, "source", "2_7a"), (3, "source", "2_7b"), (3, "source", "2_7d")}


def test_selection(spark):
    options = lambda *rows: Selection.of(spark.createDataFrame(list(rows), "option string, var string, value string"))
    rules_ = {"a": ("meta", F.lit(True)), "b": ("time", F.lit(True)), "c": ("data", F.lit(True))}
    assert set(options(("mode", None, "meta,time"), ("without", None, "a"), (None, None, "x"), ("mode", None, None)).rules(rules_)) == {"b"}
    assert set(options(("only", "v", "c")).rules(rules_)) == {"a", "b", "c"} and set(options(("only", None, "b"), ("only", "v", "c")).rules(rules_)) == {"b", "c"}
    for bad in (("what", None, "x"), ("mode", None, "x")):
        with pytest.raises(ValueError):
            options(bad)


def test_stateful_series_do_not_depend_on_batches(spark, tmp_path):
    rnd = random.Random(8)
    rows = [(f"s{i % 3}", i, float(rnd.choice([i, i, i, i - 4, i - 3])), rnd.choice([1.0, 2.5, None, float("nan")])) for i in range(60)]
    got = []
    for name, cuts in (("one", [60]), ("many", [7, 8, 30, 60])):
        at, begin = tmp_path / name, 0
        for end in cuts:
            spark.createDataFrame(rows[begin:end], "series string, seq long, time double, value double").write.mode("append").parquet(str(at / "in"))
            continue_into(spark.readStream.schema("series string, seq long, time double, value double").parquet(str(at / "in")), str(at / "out"), str(at / "progress"))
            begin = end
        got.append(sorted(map(str, spark.read.schema(OUTPUT).parquet(str(at / "out")).collect())))
    assert got[0] == got[1] and len(got[0]) == 60


def test_erased_requested_and_lines(spark, tmp_path):
    f = spark.createDataFrame([("k", "A", 1), ("k", "B", 2), ("j", "B", 3), (None, "A", 4), (None, "B", 5), ("k", None, 6)], "key string, code string, gone_2 int")
    assert {r.gone_2 for r in annotations.erased(f, spark.createDataFrame([("A", "B"), (None, "A")], "code string, erases string"), ["key"]).collect()} == {1, 3, 4, 5, 6}
    atts = spark.createDataFrame([("o", "a", "x"), ("o", "a", "y"), ("o", "c", None), ("p", "z", "1"), ("q", None, None)], "owner string, att string, value string")
    need = spark.createDataFrame([("a", ["x"]), ("c", None)], "att string, allowed array<string>")
    assert sorted(tuple(r) for r in rules.requested(atts, need, ["owner"]).collect()) == [("o", "a", "unmatched"), ("o", "c", "missing"), *[(x, y, "missing") for x in "pq" for y in "ac"]]
    (tmp_path / "r.csv").write_text("# head\na, b \\\n, c # tail\n\n d\\\n\\\ne\nf")
    assert [(r.line, list(r["items"])) for r in delimited(spark, str(tmp_path / "r.csv")).orderBy("line").collect()] == [(3, ["a", "b", "c"]), (7, ["de"]), (8, ["f"])]


def test_points_of_large_keys_on_edges_of_cells(spark, tmp_path):
    """Positions of large keys are decimals: those exactly on an edge are in the cell that the SQL says."""
    import duckdb

    from gneiss import registry

    ids = [5360900, 3499800, 4858200, 4902400, 1859400, 1621600, 2776400, 2080100]
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(str(tmp_path / "events.parquet"))
    spark.range(800).withColumnRenamed("id", "p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    for name in ("events", "part"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = sorted(con.sql(registry.ORACLES["grid_lookup"]).fetchall())
    assert len(want) == len(ids) and sorted(map(tuple, registry.QUERIES["grid_lookup"](spark, str(tmp_path)).collect())) == want


def test_long_rule_files_are_read_in_parts(spark, tmp_path):
    """Parts end anywhere, also inside of continued lines; the time grows with the lines, not with their square; an unfinished last line is one."""
    import time

    (tmp_path / "a.csv").write_text("".join(f"a{i} \\\n, {i} # no, {i}\r\n\n" for i in range(100)) + "z, \\\n \\\ny \\")
    (tmp_path / "b.csv").write_text("b \\\n" * 50 + "c\n# d\n")
    want = sorted([*[(3 * i + 2, [f"a{i}", str(i)]) for i in range(100)], (303, ["z", "y"]), (51, ["b " * 50 + "c"])])
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("50", "1000", "1000000"):
            for k in kept:
                spark.conf.set(k, size)
            assert sorted((r.line, list(r["items"])) for r in delimited(spark, str(tmp_path / "*.csv")).collect()) == want
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    (tmp_path / "long.txt").write_text("a, \\\nb # c\n" * 30_000)
    begin = time.time()
    got = delimited(spark, str(tmp_path / "long.txt")).where("items[0] = 'a' and items[1] = 'b'").agg(F.count("*"), F.max("line")).first()
    assert tuple(got) == (30_000, 60_000) and time.time() - begin < 30


def test_exploded_rows_of_a_small_file_are_not_broadcast(spark, sf):
    """Only the table of standard names may go through the driver."""
    from gneiss import registry

    for name in ("conventions_chapter_4", "cell_method_faults"):
        plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastExchange") <= 1, name


def test_replicated_records_are_shuffled_once(spark, sf):
    from gneiss import registry

    plan = registry.QUERIES["replicated_only_groups"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_series_share_rows_of_the_state_store(spark, tmp_path):
    """The store has at most a row a bucket, and each series goes on from its own state; a null series is one too."""
    from gneiss.streaming import series

    n = 1500
    for part in range(2):
        spark.range(n).selectExpr("if(id = 0, null, concat('s', id)) as series", f"id + {part * n} as seq", f"double({part}) as time", "double(id) as value").write.mode("append").parquet(str(tmp_path / "in"))
        continue_into(spark.readStream.schema("series string, seq long, time double, value double").parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "progress"))
    rows = spark.read.schema(OUTPUT).parquet(str(tmp_path / "out")).where("seq >= 1500").collect()
    assert len(rows) == n and all((r.n, r.step, r.s, r.series) == (2, 1.0, 2.0 * (r.seq - n), None if r.seq == n else f"s{r.seq - n}") for r in rows)
    assert spark.read.format("statestore").load(str(tmp_path / "progress")).count() <= series.BUCKETS < n


@pytest.mark.parametrize("chapter", [0, 2, 5, 7, 9])
def test_no_exploded_rows_of_a_chapter_are_broadcast(spark, sf, chapter):
    """Only the table of standard names may go through the driver."""
    from gneiss import registry

    plan = registry.QUERIES[f"conventions_chapter_{chapter}"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") <= 1
