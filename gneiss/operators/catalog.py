"""File catalogues: selection, sequences, periods, deliveries, checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def selected(files: DataFrame, path: str, name: str, select: list[tuple[str, str]], lock: list[tuple[str, str]] = ()) -> DataFrame:
    """Files that match a (path, name) pair of regular expressions from its start, and no locked pair; no selection is all."""
    hit = lambda pairs: F.array_max(F.array(*[(F.col(path).rlike(f"^(?:{p})") & F.col(name).rlike(f"^(?:{v})$")) for p, v in pairs]))
    out = files.where(hit(select)) if select else files
    return out.where(~hit(lock)) if lock else out


def drs_period(name: Column) -> Column:
    """(beg, end) digits of a file name's trailing _YYYY[MM[DD...]]-YYYY[MM[DD...]] or single date; null without one."""
    two = F.regexp_extract(name, r"_([0-9]{4,14})-([0-9]{4,14})(?:-clim)?(?:\.[A-Za-z0-9]+)?$", 1)
    end = F.regexp_extract(name, r"_([0-9]{4,14})-([0-9]{4,14})(?:-clim)?(?:\.[A-Za-z0-9]+)?$", 2)
    one = F.regexp_extract(name, r"_([0-9]{4,14})(?:\.[A-Za-z0-9]+)?$", 1)
    beg = F.when(two != "", two).when(one != "", one)
    return F.struct(beg.alias("beg"), F.when(end != "", end).otherwise(beg).alias("end"))


def sequence_codes(files: DataFrame, series: list[str]) -> DataFrame:
    """``code`` of each file of a series by begin: 1 name date before the end of the name before, 4 same begin and end as
    before, 8 overlap with the one before, 16 mixed date formats in the series; they add up, and 10 more if any fired.

    files: (begin, end, d_beg, d_end): numbers from the data and digits from the name. Two more columns may be there:
    ``mod_time`` and ``target_time``, the time of what was made from the series: 2 the file is newer than that; ``known_end``, the last time
    that was stored of the file: 32 its data no longer reach it, so they were made anew.
    """
    has = set(files.columns)
    w = Window.partitionBy(*series).orderBy("begin", "end", "d_beg")
    lag = lambda c: F.lag(c).over(w)
    every = Window.partitionBy(*series)
    mixed = F.min(F.length("d_beg")).over(every) != F.max(F.length("d_beg")).over(every)
    same = (F.col("begin") == lag("begin")) & (F.col("end") == lag("end"))
    code = (
        F.when(F.col("d_beg") < lag("d_end"), 1).otherwise(0)
        + F.when(same, 4).otherwise(0)
        + F.when(~same & (F.col("begin") < lag("end")), 8).otherwise(0)
        + F.when(mixed, 16).otherwise(0)
        + (F.when(F.col("mod_time") > F.col("target_time"), 2).otherwise(0) if {"mod_time", "target_time"} <= has else 0)
        + (F.when(F.col("end") < F.col("known_end"), 32).otherwise(0) if "known_end" in has else 0)
    )
    return files.withColumn("code", F.coalesce(code, F.lit(0))).withColumn("code", F.when(F.col("code") > 0, F.col("code") + 10).otherwise(0))


def period_status(periods: DataFrame, freq: str, begin: str = "begin", end: str = "end") -> DataFrame:
    """``status``: FAIL:B begins later than the earliest of its frequency, FAIL:E ends earlier than the latest, FAIL:BE both
    or undefined, else PASS."""
    span = periods.groupBy(F.col(freq).alias("_f")).agg(F.min(begin).alias("_b"), F.max(end).alias("_e"))
    late, early = F.col(begin) > F.col("_b"), F.col(end) < F.col("_e")
    status = F.when(F.col(begin).isNull() | F.col(end).isNull() | (late & early), "FAIL:BE").when(late, "FAIL:B").when(early, "FAIL:E").otherwise("PASS")
    return periods.join(span, F.col(freq).eqNullSafe(F.col("_f")), "left").withColumn("status", status).drop("_f", "_b", "_e")


def not_delivered(required: DataFrame, delivered: DataFrame, freq: str, var: str) -> DataFrame:
    """Required (var, freq) that are not there, of the frequencies of which anything is."""
    return required.join(delivered.select(freq).distinct(), freq, "left_semi").join(delivered.select(freq, var).distinct(), [freq, var], "left_anti")


def latest(blocks: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last block of each key; earlier ones are superseded."""
    return blocks.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def checksum_history(files: DataFrame, name: str, order: str, checksum: str, tracking: str) -> DataFrame:
    """``code`` against the earlier version of the same name: M7 changed data of unchanged tracking, M8 unchanged data of changed."""
    w = Window.partitionBy(name).orderBy(order)
    c, t = F.lag(checksum).over(w), F.lag(tracking).over(w)
    code = F.when((t == F.col(tracking)) & (c != F.col(checksum)), "M7").when((t != F.col(tracking)) & (c == F.col(checksum)), "M8")
    return files.withColumn("code", code)


def health(files: DataFrame) -> DataFrame:
    """``code`` of files that can't be used: M2 a link without target (``target_exists``, if there is such a column), M3 empty,
    M4 unreadable, M6 invalid name."""
    broken = ~F.col("target_exists") if "target_exists" in files.columns else F.lit(False)
    code = F.when(broken, "M2").when(F.col("size") == 0, "M3").when(~F.col("readable"), "M4").when(~F.col("name").rlike(r"^[A-Za-z0-9._-]+$"), "M6")
    return files.withColumn("code", code).where("code is not null")


def empty_directories(directories: DataFrame, files: DataFrame) -> DataFrame:
    """Directories (path) in which no file (directory) lies, as M1."""
    used = files.select(F.col("directory").alias("path")).distinct()
    return directories.join(used, "path", "left_anti").withColumn("code", F.lit("M1"))


def named(paths: DataFrame, path: str, parts: list[int], separator: str = "_") -> DataFrame:
    """``name`` of the experiment or project: components of the path by their place, counted from 1, or from the end if negative."""
    at = F.split(path, "/")
    return paths.withColumn("name", F.concat_ws(separator, *[F.try_element_at(at, F.lit(i)) for i in parts]))


def next_records(records: DataFrame, series: list[str], order: list[str], after: DataFrame, n: int) -> DataFrame:
    """The next ``n`` records of each series behind those already done. ``after``: (series.., last), counts of records; none is 0."""
    w = Window.partitionBy(*series).orderBy(*order)
    r = records.withColumn("_r", F.row_number().over(w)).join(after.select(*series, F.col("last").alias("_last")), series, "left")
    return r.where(F.col("_r") - F.coalesce("_last", F.lit(0)) > 0).where(F.col("_r") - F.coalesce("_last", F.lit(0)) <= n).select(*records.columns)


#: Years that a file of a frequency may span.
MOST_YEARS = {"3hr": 1, "6hr": 1, "day": 5, "mon": 10, "sem": 10}


def period_cut(files: DataFrame, series: list[str], freq: str) -> DataFrame:
    """``code`` of files (d_beg, d_end digits): ``span`` covers more years than its frequency may; ``begin`` or ``end`` does not
    stand at a year's boundary, which only a series' first begin and last end need not."""
    w = Window.partitionBy(*series).orderBy("d_beg", "d_end")
    limit = F.element_at(F.create_map(*[x for k, v in MOST_YEARS.items() for x in (F.lit(k), F.lit(v))]), F.col(freq))
    span = F.substring("d_end", 1, 4).cast("int") - F.substring("d_beg", 1, 4).cast("int") + 1
    month = lambda c: F.substring(c, 5, 2)
    first, last = F.lag("d_beg").over(w).isNull(), F.lead("d_beg").over(w).isNull()
    code = F.when(span > limit, "span").when(~first & ~month("d_beg").isin("", "01"), "begin").when(~last & ~month("d_end").isin("", "12"), "end")
    return files.withColumn("code", code)


def next_files(files: DataFrame, series: list[str], order: list[str], n: int) -> DataFrame:
    """The next ``n`` files of each series."""
    return files.withColumn("_r", F.row_number().over(Window.partitionBy(*series).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def overlapping(files: DataFrame, lo: float, hi: float) -> DataFrame:
    """Files with any time in [lo, hi], and the part of it that they hold."""
    f = files.where((F.col("end") >= lo) & (F.col("begin") <= hi))
    return f.withColumn("from", F.greatest("begin", F.lit(lo))).withColumn("to", F.least("end", F.lit(hi)))
