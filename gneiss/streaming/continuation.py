"""Series that go on: statistics and time-step tests of appended records, batch by batch.

``state`` is a table of one row a series; each micro-batch is judged with it and then added to it. Because states
merge, the result does not depend on where batches are cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.operators import statistics

SERIES_STATE = "series string, last_time double, last_step double, ref_step double, n long, s double, ss double, w double, w2 double, mn double, mx double"


def judged(batch: DataFrame, state: DataFrame, slack: float = 1.25) -> DataFrame:
    """``batch`` (series, time, value) with ``step`` and ``flag`` (1 negative, 4 identical, 2 missing), going on from ``state``."""
    w = Window.partitionBy("series").orderBy("seq")
    b = batch.join(state.select("series", "last_time", F.col("ref_step").alias("known_step")), "series", "left")
    b = b.withColumn("step", F.col("time") - F.coalesce(F.lag("time").over(w), "last_time"))
    b = b.withColumn("ref_step", F.coalesce("known_step", F.first("step", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    flag = F.when(F.col("step") < 0, 1).when(F.col("step") == 0, 4).when(F.col("step") > slack * F.col("ref_step"), 2).otherwise(0)
    return b.withColumn("flag", flag).drop("last_time", "known_step")


def advanced(state: DataFrame, batch: DataFrame) -> DataFrame:
    """The state after a judged batch: its statistics are those of any record, of valid cells only."""
    times = batch.groupBy("series").agg(F.max_by("time", "seq").alias("last_time"), F.max_by("step", "seq").alias("last_step"), F.first("ref_step", ignorenulls=True).alias("ref_step"))
    new = times.join(statistics.partial_states(batch, ["series"], "value").select("series", *statistics.STATE), "series")
    both = state.withColumn("_o", F.lit(0)).unionByName(new.withColumn("_o", F.lit(1)))
    return both.groupBy("series").agg(
        F.max_by("last_time", "_o").alias("last_time"), F.max_by("last_step", "_o").alias("last_step"), F.min_by("ref_step", F.when(F.col("ref_step").isNotNull(), F.col("_o"))).alias("ref_step"),
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum("w").alias("w"), F.sum("w2").alias("w2"), F.min("mn").alias("mn"), F.max("mx").alias("mx"),
    )


class Continuation:
    """A ``foreachBatch`` sink: flagged records under ``path``/records, and a state for each batch under ``path``/state.

    A batch that is run again overwrites what it wrote and starts from the state before it, so a restart gives the same.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def state(self, batch: int) -> DataFrame:
        if batch < 0:
            return self.spark.createDataFrame([], SERIES_STATE)
        return self.spark.read.schema(SERIES_STATE).parquet(f"{self.path}/state/batch={batch}")

    def __call__(self, batch: DataFrame, number: int) -> None:
        before = self.state(number - 1)
        judged(batch, before).write.mode("overwrite").parquet(f"{self.path}/records/batch={number}")
        told = self.spark.read.parquet(f"{self.path}/records/batch={number}")
        advanced(before, told).write.mode("overwrite").parquet(f"{self.path}/state/batch={number}")

    def records(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/records")


def run_available(source: DataFrame, sink: Continuation, checkpoint: str) -> None:
    """Process all that a stream ``source`` (series, seq, time, value) has now."""
    source.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
