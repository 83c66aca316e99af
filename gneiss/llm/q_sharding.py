"""Query op5: all documents in shards 0 to 7, by the key law."""

from pyspark.sql import functions as F

from gneiss.llm.common import table
from gneiss.llm.sharding import assign_shards


def op5_sharding(spark, sf_dir):
    at = assign_shards(table(spark, sf_dir, "documents"))
    return at.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


QUERIES = {"op5_sharding": op5_sharding}

#: SQL has no CRC-32; tests hold the query against zlib and hashlib.
ORACLES = {}
