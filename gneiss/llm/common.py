"""Shared helpers: shared-folder tables, Arrow slices, keyed hashes, word expressions."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space; every operator here splits words on these six characters.
SPACES = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``. Where it is unset a local session gets a temporary one;
    on a cluster no folder of one machine would do, so it is an error there."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="gneiss-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


#: Rows that Spark sends to a Python worker at once while an operator's own tables are made: texts may be long.
ARROW_ROWS = "1000"


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within, Python workers get batches of ``ARROW_ROWS`` rows, so that neither side holds many texts beside its own copy."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, ARROW_ROWS)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fresh(columns: list[str], name: str) -> str:
    """``name``, with underscores added until no column has it."""
    while name.lower() in (c.lower() for c in columns):
        name += "_"
    return name


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there,
    and what a lost executor held is read again rather than computed again."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/gneiss/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._table = at
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete what ``materialise`` wrote for ``tables``, once all that reads them has been written itself; None is nothing."""
    for df in tables:
        if at := getattr(df, "_table", None):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def indexed(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once, its rows numbered from 0 without gaps, in the order of its partitions, in ``index``.

    A row's number is its place in its part plus the rows of the parts before; the parts' sizes are one row for each
    part, so their running sum is a small window.
    """
    df = materialise(df.withColumn("index", F.monotonically_increasing_id()), name)
    part, place = F.shiftright("index", 33), F.col("index").bitwiseAND((1 << 33) - 1)
    sizes = df.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = F.broadcast(sizes.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first")))
    return df.withColumn("part", part).join(first, "part").withColumn("index", F.col("first") + place).drop("part", "first")


#: Rows of a few numbers that may be broadcast; the side of a join beyond it is shuffled.
BROADCAST_ROWS = 2_000_000


def small_side(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and marked for broadcast if it has ``BROADCAST_ROWS`` at most, so that a join with
    documents does not move their texts; else as it is, and Spark shuffles both sides."""
    df = materialise(df, name)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """``batches`` in slices of ``rows``: what a worker derives from one, and sends back, is small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_fraction(*parts: Column) -> Column:
    """A keyed draw in (0, 1): the first 13 hex digits of an MD5 digest, so that any SQL engine gives the same."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def hash_long(*parts: Column) -> Column:
    """A keyed 60-bit integer, the first 15 hex digits of an MD5 digest."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
