"""Tables in the folder that all executors share, where a loop cuts its lineage, and tables dealt out for grouping."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def dealt(df: DataFrame, keys: list[str], rows: int = 20_000) -> DataFrame:
    """``df`` dealt out by ``keys`` into parts of about ``rows`` rows, and into as many as shuffles have at least. A number of parts that is
    given is not lowered for compressed bytes being few, so that what a task holds does not grow with the table; a small file of many rows, of
    which each stands for many more, is not left to one task."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-df.count() // rows)), *keys)


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset a local session gets a temporary one, and on a cluster it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="gneiss-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back: what was lost with an executor is read again, not computed again."""
    at = f"{shared_folder(df.sparkSession)}/gneiss/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out._table = at
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete what ``written`` wrote for ``tables``, once all that reads them is written itself."""
    for df in tables:
        if at := getattr(df, "_table", None):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
