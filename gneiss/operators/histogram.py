"""Frequency distributions: sparse bins as rows, built, resized, merged and compared by groupings."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build(cells: DataFrame, keys: list[str], value: str, width: float, start: float = 0.0, weight: str | None = None) -> DataFrame:
    """(keys, bin_left, freq, n, sum_v); null and NaN cells are skipped."""
    w = F.col(weight) if weight else F.lit(1.0)
    at = F.floor((F.col(value) - start) / width) * width + start
    ok = cells.where(F.col(value).isNotNull() & ~F.isnan(value))
    return ok.groupBy(*keys, at.alias("bin_left")).agg(F.sum(w).alias("freq"), F.count("*").alias("n"), F.sum(value).alias("sum_v"))


def _wider(width: float, factor: float) -> float:
    """The next width: ten times a small one, half a unit before others are multiplied."""
    return width * 10 if width < 0.1 else 0.5 if width < 0.5 else width * factor


def resized(hist: DataFrame, keys: list[str], width: float, most: int = 50, factor: float = 2.0, start: float = 0.0) -> tuple[DataFrame, float]:
    """The histogram in wider bins, so that no series has more than ``most``, and their width. One count decides
    how often they are widened; bins then move by the mean of what they hold."""
    top = hist.groupBy(*keys).agg(((F.max("bin_left") - F.min("bin_left")) / width + 1).alias("span"), F.count("*").alias("bins")).agg(F.max("span").alias("span"), F.max("bins").alias("bins")).first()
    if not top["bins"] or top["bins"] <= most:
        return hist, width
    wide = _wider(width, factor)
    while top["span"] * width / wide > most:
        wide = _wider(wide, factor)
    at = F.floor((F.col("sum_v") / F.col("n") - start) / wide) * wide + start
    return merged(hist.withColumn("bin_left", at), keys), wide


def merged(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Histograms of equal bins added up; union several before."""
    return hist.groupBy(*keys, "bin_left").agg(F.sum("freq").alias("freq"), F.sum("n").alias("n"), F.sum("sum_v").alias("sum_v"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(bin_left, diff, percent) of ``b`` against ``a``, bin by bin; a bin missing in b is -100 %, one missing in a the greatest double."""
    x, y = a.select("bin_left", F.col("freq").alias("fa")), b.select("bin_left", F.col("freq").alias("fb"))
    j = x.join(y, "bin_left", "full")
    d = F.coalesce("fb", F.lit(0.0)) - F.coalesce("fa", F.lit(0.0))
    return j.select("bin_left", d.alias("diff"), F.when(F.col("fa").isNotNull(), 100 * d / F.col("fa")).otherwise(F.lit(sys.float_info.max)).alias("percent"))
