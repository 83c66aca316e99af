"""Time axes and time bounds: steps, gaps, overlaps, time tables, as windows over each series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def step_flags(rows: DataFrame, series: list[str], order: list[str], time: Column, slack: float = 1.25) -> DataFrame:
    """``flag`` by the step to the record before: 1 negative, 4 identical, 2 missing (a step beyond ``slack`` times
    the series' first), else 0; the tests exclude each other in this order."""
    w = Window.partitionBy(*series).orderBy(*order)
    t = rows.withColumn("_t", time).withColumn("step", F.col("_t") - F.lag("_t").over(w))
    t = t.withColumn("ref_step", F.first("step", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    flag = F.when(F.col("step") < 0, 1).when(F.col("step") == 0, 4).when(F.col("step") > slack * F.col("ref_step"), 2).otherwise(0)
    return t.withColumn("flag", flag).drop("_t")


def bounds_flags(rows: DataFrame, series: list[str], order: list[str], lo: str = "tb0", hi: str = "tb1", regular: bool = True, slack: float = 0.0) -> DataFrame:
    """``flag``: 8 no width, 16 overlap with the bounds before, 32 gap of more than ``slack`` after them (regular axes only);
    they add up. Where dates stand for whole days, a slack of one unit lets the next day follow the last."""
    w = Window.partitionBy(*series).orderBy(*order)
    a, before = F.round(lo, 5), F.round(F.lag(hi).over(w), 5)
    gap = F.when(a > before + slack, 32).otherwise(0) if regular else F.lit(0)
    return rows.withColumn("flag", F.when(F.col(hi) - F.col(lo) <= 0, 8).otherwise(0) + F.when(a < before, 16).otherwise(0) + gap)


def monotonic(rows: DataFrame, series: list[str], order: list[str], value: str) -> DataFrame:
    """(series, direction): 1 strictly rising, -1 strictly falling, 0 neither; one value alone rises."""
    w = Window.partitionBy(*series).orderBy(*order)
    s = rows.withColumn("_s", F.signum(F.col(value) - F.lag(value).over(w)))
    g = s.groupBy(*series).agg(F.min("_s").alias("lo"), F.max("_s").alias("hi"))
    return g.select(*series, F.when(F.coalesce("lo", F.lit(1.0)) > 0, 1).when(F.col("hi") < 0, -1).otherwise(0).alias("direction"))


def local_extrema(rows: DataFrame, series: list[str], order: list[str], value: str) -> DataFrame:
    """Records above or below both neighbours, with the vertex of the parabola through the three."""
    w = Window.partitionBy(*series).orderBy(*order)
    y0, y1, y2 = F.lag(value).over(w), F.col(value), F.lead(value).over(w)
    r = rows.select("*", y0.alias("_0"), y1.alias("_1"), y2.alias("_2")).where("(_1 > _0 and _1 > _2) or (_1 < _0 and _1 < _2)")
    bend = F.col("_0") - 2 * F.col("_1") + F.col("_2")
    at = 0.5 * (F.col("_0") - F.col("_2")) / bend
    return r.withColumn("kind", F.when(F.col("_1") > F.col("_0"), "max").otherwise("min")).withColumn("shift", at).withColumn("vertex", F.col("_1") - 0.25 * (F.col("_0") - F.col("_2")) * at).drop("_0", "_1", "_2")


def in_time_table(rows: DataFrame, time: Column, ranges: DataFrame, width: float) -> DataFrame:
    """``allowed``: whether ``time`` lies in one of ``ranges`` (beg, end). Ranges are cut in the buckets of ``width`` that they touch,
    those of a bucket are gathered, and each row looks among them: an equi-join without a nested loop, in which every
    row has one partner at most. A time table has few ranges; a null time is not allowed."""
    r = ranges.select("beg", "end", F.explode(F.sequence(F.floor(F.col("beg") / width), F.floor(F.col("end") / width))).alias("_b"))
    r = r.groupBy("_b").agg(F.collect_list(F.struct("beg", "end")).alias("_ranges"))
    t = rows.withColumn("_t", time).withColumn("_b", F.floor(F.col("_t") / width)).join(r, "_b", "left")
    inside = F.exists("_ranges", lambda x: F.col("_t").between(x["beg"], x["end"]))
    return t.withColumn("allowed", F.coalesce(inside, F.lit(False))).select(*rows.columns, "allowed")


def asof(left: DataFrame, right: DataFrame, key: list[str], time: str, value: str) -> DataFrame:
    """Each row of ``left`` with the last ``value`` and time of ``right`` at or before it: both are one sorted series."""
    cols = [*key, time]
    both = left.select(*cols, F.lit(None).cast(dict(right.dtypes)[value]).alias("_v"), F.lit(None).cast(dict(right.dtypes)[time]).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l")).unionByName(
        right.select(*cols, F.col(value).alias("_v"), F.col(time).alias("_t"), F.lit(0).alias("_side")), allowMissingColumns=True
    )
    w = Window.partitionBy(*key).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.select("_side", "_l", F.last("_v", ignorenulls=True).over(w).alias(f"asof_{value}"), F.last("_t", ignorenulls=True).over(w).alias("asof_time"))
    return out.where("_side = 1").select("_l.*", f"asof_{value}", "asof_time")


def resumed(rows: DataFrame, state: DataFrame, series: list[str], time: Column) -> DataFrame:
    """Records later than the stored last time less a tenth of its step; series without a state are whole."""
    s = state.select(*series, "last_time", "last_step")
    return rows.withColumn("_t", time).join(s, series, "left").where("last_time is null or _t > last_time - last_step / 10").drop("_t", "last_time", "last_step")


def rebased(rows: DataFrame, time: str, reference: str, series: list[str], order: list[str], unit: str = "day") -> DataFrame:
    """``time`` in units since the ``reference`` timestamp of its file, as units since the reference of the series' first record."""
    from gneiss.functions.calendar import since

    first = F.first(reference).over(Window.partitionBy(*series).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("_f", first).withColumn(time, F.col(time) + since(F.col(reference), F.col("_f"), unit)).drop("_f")


def sliced(rows: DataFrame, time: Column, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Records of [lo, hi): a filter that reaches the scan; an end that is None is open."""
    out = rows if lo is None else rows.where(time >= lo)
    return out if hi is None else out.where(time < hi)


def renewed(rows: DataFrame, state: DataFrame, series: list[str], time: Column) -> DataFrame:
    """(series, last_time): series whose stored last time is among no record of theirs: the data were shortened or made anew (9_2)."""
    seen = rows.select(*series, time.alias("last_time")).distinct()
    known = rows.select(*series).distinct()
    return state.select(*series, "last_time").join(known, series, "left_semi").join(seen, [*series, "last_time"], "left_anti")


def child_start(children: DataFrame, parents: DataFrame, key: list[str], time: str, lag: float) -> DataFrame:
    """``code`` of each child series against its parent: W36 its first time is no later than the parent's first, W37 the
    parent has no record within ``lag`` before it, W38 the bounds do not meet (child tb0, parent tb1 of the record found).

    children: (key.., time, tb0), a row a series; parents: (key.., time, tb1). One sorted union, no pairs.
    """
    first = parents.groupBy(*key).agg(F.min(time).alias("_p0"))
    p = parents.select(*key, time, F.struct(F.col(time).alias("t"), "tb1").alias("p"))
    found = asof(children, p, key, time, "p").join(first, key, "left")
    code = (
        F.when(F.col(time) <= F.col("_p0"), "W36").when(F.col("asof_p").isNull() | (F.col(time) - F.col("asof_p.t") > lag), "W37").when(F.round("tb0", 5) != F.round("asof_p.tb1", 5), "W38")
    )
    return found.withColumn("code", code).select(*children.columns, "code")
