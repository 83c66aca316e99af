"""Anomalies of record statistics: flags, whole-series predicates, outliers, replicated records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Codes of the record flags that add up in one integer.
CODES = (1, 2, 4, 8, 16, 32, 64, 100, 200, 400, 800, 1600, 3200, 6400)


def record_flags(records: DataFrame) -> DataFrame:
    """``flags`` of record statistics (n, size, mn, mx, std, nan_count, inf_count) and their sum ``flag``:
    100 no valid cell, 200 constant, 1600 deviation undefined, 6400 NaN or infinite cells."""
    found = F.array(
        F.when(F.col("n") == 0, 100),
        F.when((F.col("n") > 1) & (F.col("mn") == F.col("mx")), 200),
        F.when((F.col("n") > 1) & F.col("std").isNull(), 1600),
        F.when(F.col("nan_count") + F.col("inf_count") > 0, 6400),
    )
    flags = F.array_compact(found)
    return records.withColumn("flags", flags).withColumn("flag", F.aggregate(flags, F.lit(0), lambda a, x: a + x))


def decoded(flag: Column) -> Column:
    """The codes that a sum is made of; the greatest that fits is taken first."""
    start = F.struct(flag.cast("int").alias("rest"), F.array().cast("array<int>").alias("codes"))
    codes = F.array(*[F.lit(c) for c in reversed(CODES)])
    take = lambda a, c: F.when(c <= a["rest"], F.struct((a["rest"] - c).alias("rest"), F.array_append(a["codes"], c).alias("codes"))).otherwise(a)
    return F.sort_array(F.aggregate(codes, start, take)["codes"])


def whole_series(records: DataFrame, keys: list[str], checksum: str) -> DataFrame:
    """Series that are entirely constant (6_1), entirely fill (6_2), or of identical records (6_3)."""
    g = records.groupBy(*keys).agg(
        F.every((F.col("n") > 1) & (F.col("mn") == F.col("mx"))).alias("code_6_1"), F.every(F.col("n") == 0).alias("code_6_2"), F.count("*").alias("records"), F.min(checksum).alias("_a"), F.max(checksum).alias("_z")
    )
    return g.withColumn("code_6_3", (F.col("records") > 1) & F.col("_a").eqNullSafe(F.col("_z"))).drop("_a", "_z")


def percent_plausibility(series: DataFrame, units: str, lo: str, hi: str) -> DataFrame:
    """6_8: declared in percent, but within [0, 1]; 6_9: declared a fraction, but within (1, 100]."""
    code = F.when((F.col(units) == "%") & (F.col(lo) >= 0) & (F.col(hi) <= 1), "6_8").when(F.col(units).isin("1", "") & (F.col(lo) >= 0) & (F.col(hi) > 1) & (F.col(hi) <= 100), "6_9")
    return series.withColumn("code", code)


def outliers(series: DataFrame, keys: list[str], value: str, run: int = 5, count: int = 5, share: float = 0.01, magnitude: int = 5) -> DataFrame:
    """Records beyond the threshold at which the number of records beyond it stays the same ``run`` times.

    Thresholds rise from the mean by steps of half a standard deviation, a hundred of them; counts of records beyond
    each come from one aggregation over (series x thresholds), runs of equal counts by gaps and islands. A
    series that reaches no such run before the count is 0 has no outlier; one whose count never is 0 is
    judged again with steps of twice the size, until it is (n records lie within sqrt(n) deviations of their mean, so
    the k-th pass needs more than 2500 * 4^(k - 1) records). If the run holds more than ``share`` and more than ``count`` records, only those beyond 10^``magnitude`` times the scale
    of the mean are outliers. Series of extremes are given by ``value``: minima and maxima are judged alike.
    Null and NaN values take no part; a series of fewer than two values or without spread has none.
    """
    v = series.where(F.col(value).isNotNull() & ~F.isnan(value))
    stats = v.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_sd"), F.count("*").alias("_records"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    up = (F.col("_lo") > 0) & (((F.col("_hi") > 1) & (F.col("_lo") < 0.001)) | (F.abs(F.col("_hi") - F.col("_lo")) < 1e-8))
    down = (F.col("_hi") < 0) & (((F.col("_lo") < -1) & (F.col("_hi") > -0.001)) | (F.abs(F.col("_hi") - F.col("_lo")) < 1e-8))
    stats = stats.where((F.col("_records") > 1) & (F.col("_sd") > 0) & ~up & ~down).drop("_lo", "_hi")
    far = v.join(stats, keys).withColumn("_steps", F.abs(F.col(value) - F.col("_mean")) / (F.col("_sd") / 2))
    # the last pass of a series is the first in which its farthest record is within a hundred thresholds
    last = F.ceil(F.log2(F.greatest(F.max("_steps") / 100, F.lit(1.0)))).cast("int")
    reached = far.groupBy(*keys).agg(last.alias("_last"))
    all_steps = far.join(reached, keys).withColumn("_pass", F.explode(F.sequence(F.lit(0), "_last"))).withColumn("_beyond", F.least(F.ceil(F.col("_steps") / F.pow(F.lit(2.0), F.col("_pass"))), F.lit(101)).cast("int"))
    steps = all_steps.where("_beyond > 1").groupBy(*keys, "_pass", "_beyond").agg(F.count("*").alias("_c"))
    spread = reached.withColumn("_pass", F.explode(F.sequence(F.lit(0), "_last"))).withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(100))))
    spread = spread.join(steps.withColumn("_k", F.col("_beyond") - 1), [*keys, "_pass", "_k"], "left")
    above = Window.partitionBy(*keys, "_pass").orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = spread.withColumn("_nk", F.coalesce(F.sum("_c").over(above), F.lit(0))).where("_nk > 0")
    place = Window.partitionBy(*keys, "_pass", "_nk").orderBy("_k")
    hit = counts.withColumn("_r", F.row_number().over(place)).where(F.col("_r") == run).groupBy(*keys).agg(F.min(F.struct("_pass", "_k", "_nk")).alias("_h"))
    out = far.join(hit, keys).where(F.col("_steps") > F.col("_h._k") * F.pow(F.lit(2.0), F.col("_h._pass")))
    # a share that stands for less than a tenth of a record is raised by powers of ten
    most = share * F.pow(F.lit(10.0), F.greatest(F.lit(0.0), F.ceil(F.log10(0.1 / (F.col("_records") * share)))))
    many = (F.col("_h._nk") / F.col("_records") > most) & (F.col("_h._nk") > count)
    scale = F.pow(F.lit(10.0), F.floor(F.log10(F.greatest(F.abs("_mean"), F.lit(1e-300)))))
    kept = out.where(~many | (F.abs(F.abs("_mean") - F.col(value)) > F.pow(F.lit(10.0), F.lit(magnitude)) * scale))
    return kept.select(*series.columns)


def largest_outlier(found: DataFrame, keys: list[str], value: str, at: list[str]) -> DataFrame:
    """(keys, n, value, at): of each series' outliers their number and the one of the largest amount."""
    best = F.max_by(F.struct(value, *at), F.abs(F.col(value))).alias("_b")
    return found.groupBy(*keys).agg(F.count("*").alias("n"), best).select(*keys, "n", "_b.*")


def replicated(records: DataFrame, keys: list[str], rec: str, checksum: str, only_groups: int = 0) -> DataFrame:
    """(keys, first, last, source, length): runs of records that repeat a run of earlier ones.

    Each record is matched with the earliest one of equal checksum (a minimum, not all pairs); records that are dealt out by ``keys`` stay where they are; runs
    in which both sides move in step are islands of the difference. ``only_groups`` leaves out runs not longer.
    Records flagged as fill or constant should be left out before.
    """
    earliest = F.min(rec).over(Window.partitionBy(*keys, checksum))
    m = records.dropna(subset=[*keys, checksum]).withColumn("source", earliest).where(F.col("source") < F.col(rec)).select(*keys, rec, "source")
    w = Window.partitionBy(*keys).orderBy(rec)
    new = F.when((F.col(rec) - F.lag(rec).over(w) == 1) & (F.col("source") - F.lag("source").over(w) == 1), 0).otherwise(1)
    m = m.withColumn("new", new).withColumn("island", F.sum("new").over(w))
    g = m.groupBy(*keys, "island").agg(F.min(rec).alias("first"), F.max(rec).alias("last"), F.min("source").alias("source"), F.count("*").alias("length"))
    return g.where(F.col("last") - F.col("first") >= only_groups).drop("island")
