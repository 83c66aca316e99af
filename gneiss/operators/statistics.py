"""Field statistics: one row for each record of a variable, in one pass, mergeable.

A cell is valid if it is neither null, NaN, infinite nor a fill value; classes of invalid cells are counted
apart. A state (n, s, ss, w, w2, mn, mx) holds all that is needed to merge and to finish.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE = ("n", "s", "ss", "w", "w2", "mn", "mx")


def cell_class(value: Column, fill: Column | None = None, low: float | None = None, high: float | None = None) -> Column:
    """``valid`` or why not: ``fill``, ``nan``, ``inf``, ``range``."""
    c = F.when(value.isNull(), "fill").when(F.isnan(value), "nan").when(F.abs(value) == float("inf"), "inf")
    if fill is not None:
        c = c.when(fill, "fill")
    if low is not None:
        c = c.when(value < low, "range")
    if high is not None:
        c = c.when(value > high, "range")
    return c.otherwise("valid")


def partial_states(cells: DataFrame, keys: list[str], value: str, weight: str | None = None, fill: Column | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
    """States of ``keys`` with counters of invalid cells, among them those outside [``low``, ``high``]; groups without a
    valid cell have n = 0 and null extremes."""
    v, w = F.col(value), F.col(weight) if weight else F.lit(1.0)
    kind = cell_class(v, fill, low, high)
    ok = lambda x: F.when(F.col("_class") == "valid", x)
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return (
        cells.withColumn("_class", kind)
        .groupBy(*keys)
        .agg(
            F.count(ok(v)).alias("n"),
            zero(F.sum(ok(w * v))).alias("s"),
            zero(F.sum(ok(w * v * v))).alias("ss"),
            zero(F.sum(ok(w))).alias("w"),
            zero(F.sum(ok(w * w))).alias("w2"),
            F.min(ok(v)).alias("mn"),
            F.max(ok(v)).alias("mx"),
            *[F.count_if(F.col("_class") == k).alias(f"{k}_count") for k in ("fill", "nan", "inf", "range")],
            F.count("*").alias("size"),
        )
    )


def merged(states: DataFrame, keys: list[str]) -> DataFrame:
    """States of coarser ``keys``; ``states`` may come from any partial results."""
    add = [F.sum(c).alias(c) for c in ("n", "s", "ss", "w", "w2")]
    return states.groupBy(*keys).agg(*add, F.min("mn").alias("mn"), F.max("mx").alias("mx"))


def finished(states: DataFrame, weighted: bool) -> DataFrame:
    """``ave``, ``std`` and ``std_error`` beside the states. Sample variance needs two values; small negative
    remainders count as 0; without valid cells all are null."""
    n, s, ss, w, w2 = (F.col(c) for c in STATE[:5])
    if weighted:
        var = F.when((n > 1) & (w * w > w2), (ss * w - s * s) / (w * w - w2))
    else:
        var = F.when(n > 1, (ss - s * s / n) / (n - 1))
    out = states.withColumn("ave", F.when((n > 0) & (w != 0), F.try_divide(s, w)))
    out = out.withColumn("std", F.when(var.isNotNull(), F.sqrt(F.greatest(var, F.lit(0.0)))))
    return out.withColumn("std_error", F.try_divide(F.col("std"), F.sqrt(n.cast("double"))))


def field_stats(cells: DataFrame, keys: list[str], value: str, weight: str | None = None, fill: Column | None = None) -> DataFrame:
    return finished(partial_states(cells, keys, value, weight, fill), weight is not None)


def stats_of_stats(records: DataFrame, keys: list[str], columns: tuple[str, ...] = ("mn", "mx", "ave", "std")) -> DataFrame:
    """Second-level statistics of record statistics over time; records without valid cells take no part."""
    out = []
    for c in columns:
        out += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.avg(c).alias(f"{c}_ave"), F.stddev_samp(c).alias(f"{c}_std")]
    return records.where("n > 0").groupBy(*keys).agg(F.count("*").alias("records"), *out)


def checksum(values: Column, clear_bits: int = 0) -> Column:
    """An order-sensitive checksum of an array of numbers; ``clear_bits`` low decimal digits of noise are rounded off."""
    seen = F.transform(values, lambda v: F.round(v, 12 - clear_bits)) if clear_bits else values
    return F.xxhash64(F.array_join(F.transform(seen, lambda v: F.coalesce(v.cast("string"), F.lit("_"))), ","))


def fletcher32(values: Column) -> Column:
    """Fletcher-32 over the 16-bit halves of each value's 32-bit integer part, as a fold of the array."""

    def step(acc, v):
        word = F.pmod(v.cast("long"), F.lit(1 << 32))
        a = (acc["a"] + F.shiftright(word, 16)) % 65535
        b = (acc["b"] + a) % 65535
        a2 = (a + word.bitwiseAND(F.lit(65535))) % 65535
        return F.struct(a2.alias("a"), ((b + a2) % 65535).alias("b"))

    start = F.struct(F.lit(65535).cast("long").alias("a"), F.lit(65535).cast("long").alias("b"))
    acc = F.aggregate(values, start, step)
    return acc["b"] * 65536 + acc["a"]


def area_fraction(valid_weight: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(valid_weight), F.sum(weight))


def hlevd(cells: DataFrame, cell: list[str], value: str, threshold: float) -> DataFrame:
    """Cells whose range over time exceeds ``threshold`` standard deviations."""
    g = cells.groupBy(*cell).agg((F.max(value) - F.min(value)).alias("spread"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"))
    return g.withColumn("hlevd", F.try_divide(F.col("spread"), F.col("std"))).where(F.col("hlevd") > threshold)


def detrended(cells: DataFrame, cell: list[str], time: str, value: str) -> DataFrame:
    """``value`` less its linear trend in each cell; the trend is an aggregate joined back."""
    fit = cells.groupBy(*cell).agg(F.regr_slope(value, time).alias("_m"), F.regr_intercept(value, time).alias("_c"))
    return cells.join(fit, cell).withColumn("residual", F.col(value) - F.col("_m") * F.col(time) - F.col("_c")).drop("_m", "_c")


def layered(cells: DataFrame, index: str, levels: list[int], size: int) -> DataFrame:
    """``cells`` with ``layer``, the places in the levels above the horizontal field, and ``cell``, the place in the field, of an ``index`` that counts
    through all fields of ``size`` cells, the last level running fastest; both are null for an index out of range. A record of several
    levels is then judged layer by layer, by grouping."""
    rest, places, fields = F.floor(F.col(index) / size), [], 1
    for n in reversed(levels):
        places.append(F.pmod(F.floor(rest / fields), F.lit(n)).cast("long"))
        fields *= n
    there = (F.col(index) >= 0) & (F.col(index) < fields * size)
    layer = F.array(*reversed(places)).cast("array<bigint>")
    return cells.withColumns({"layer": F.when(there, layer), "cell": F.when(there, F.pmod(F.col(index), F.lit(size)).cast("long"))})
