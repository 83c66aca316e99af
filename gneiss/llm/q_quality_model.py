"""Query op1: the quality of all documents, with their source as host and its language part as path."""

from pyspark.sql import functions as F

from gneiss.llm.common import table
from gneiss.llm.quality_model import classify


def op1_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
    return classify(docs, table(spark, sf_dir, "labels"), F.col("source"), path).withColumnRenamed("id", "doc_id")


QUERIES = {"op1_quality_classifier": op1_quality_classifier}

#: The regression is fitted, which SQL can't say; tests measure held-out accuracy and redo the shrinkage.
ORACLES = {}
